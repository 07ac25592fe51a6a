"""Repair of the share of rows that lie closer to the real table than to the test table, by swaps of near rows.

A plan says by which stages pairs are found, how they are scored, and what utility a swap may cost.  Stages, each for the rows that
the ones before left over:

* ``any``: a leaving row with any addition, each row once;
* ``same``: with additions of its target group, each row once;
* ``cross``: with additions of the other groups, each row once;
* ``fill``: the leaving rows with the largest margins, a budget of them, with any addition, each row once;
* ``again``: with any addition, which may serve several rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators import distance as J
from sievewright.operators.ranks import exact_quantiles
from sievewright.plans.workspace import materialize

#: Edges that one task matches in a pass; more are cut into slices, as many as stated at most.  The most neighbours that a later round looks at.
PASS_EDGES, MOST_SLICES, MOST_NEIGHBOURS = 1 << 21, 32, 1024
#: Rows of a side that go to every task, so that its edges needn't be shuffled to get its columns.
SHARED_ROWS = 1 << 17
#: Edges up to which one pass is quicker than thinning them first, and the edges that a task thins at a time.
FEW_EDGES, THIN_EDGES = 1 << 19, 1 << 20
#: Margins whose quantile the driver takes; of more, jobs find it.
DRIVER_ROWS = 1 << 18


@dataclass(frozen=True)
class Plan:
    """A repair variant."""

    margin: float = 0.05
    max_fraction: float = 0.5
    margin_weight: float = 0.1
    utility_weight: float = 0.1
    quality_weight: float = 0.0
    stages: tuple[str, ...] = ("any",)
    skip_in_band: bool = False
    accept_in_band_gain: bool = False
    #: Least utility gains of a pair: the wanted one, and the one where too few pairs have that.
    floors: tuple[float, float] | None = None
    mismatch: float = 4.0
    neighbours: int = 64
    #: Leaving rows that the fill stage looks at, if that is more than it needs.
    fill_budget: int = 20_000


_V4 = Plan(max_fraction=0.22, margin_weight=0.05, utility_weight=0.35)
_V5 = replace(_V4, skip_in_band=True)
_V10 = replace(_V5, max_fraction=0.30, margin_weight=0.10, utility_weight=0.55, floors=(-0.10, -0.25))
_V11 = replace(_V10, utility_weight=0.65, quality_weight=0.20, floors=(-0.08, -0.18), stages=("same", "cross"))
_V13 = replace(_V11, stages=("same", "fill"))
_V15 = replace(_V13, stages=("same", "fill", "again"))
#: The variants by number, the live one last.
PLANS = {
    "v4": _V4,
    "v5": _V5,
    "v6": replace(_V5, accept_in_band_gain=True),
    "v9": replace(_V5, max_fraction=0.26, margin_weight=0.08, utility_weight=0.50, floors=(-0.08, -0.20)),
    "v10": _V10,
    "v11": _V11,
    "v13": _V13,
    "v15": _V15,
    "v19": replace(_V15, margin=0.03),
}


def utility_scores(df: DataFrame, id_column: str, exact: DataFrame | None, surrogate: DataFrame | None, value: str = "utility") -> DataFrame:
    """Exact where there is one, else the surrogate, else 0.5; the surrogate only fills what is still exactly 0.5."""
    out = df.withColumn("__u", F.lit(0.5))
    for i, t in enumerate(x for x in (exact, surrogate) if x is not None):
        out = out.join(t.select(F.col(id_column).alias(f"__i{i}"), F.col(value).alias(f"__v{i}")), F.col(id_column) == F.col(f"__i{i}"), "left")
        out = out.withColumn("__u", F.when(F.col("__u") == 0.5, F.coalesce(f"__v{i}", "__u")).otherwise(F.col("__u"))).drop(f"__i{i}", f"__v{i}")
    return out.withColumnRenamed("__u", value)


def target_of(dcr: float, margin: float) -> tuple[float, bool]:
    """(share to reach, whether rows closer to the real table leave)."""
    return (0.5 + abs(margin), True) if dcr >= 0.5 else (0.5 - abs(margin), False)


def budgeted_candidates(rows: DataFrame, id_column: str, limit: int, reduce_dcr: bool, n: int | None = None) -> DataFrame:
    """At most ``limit`` additions; all where there are no more.  ``n``: the number of rows, where it is known.  No plan uses it.

    A quarter of those with exact quality, 45 % of those on the side that helps (by the margin's sign), 15 % of the other side, filled up with
    any; each by .55 quality, .25 utility and .20 margin over its 95 % quantile.  A row keeps the first list that takes it.
    """
    if (rows.count() if n is None else n) <= limit:
        return rows
    size = F.abs(F.coalesce("margin", F.lit(0.0)))
    if n is not None and n <= DRIVER_ROWS:
        v, x = np.sort(rows.select(size.alias("m")).toArrow()["m"].to_numpy()), 0.95 * (n - 1)
        scale = float(v[int(x)] + (v[min(int(x) + 1, n - 1)] - v[int(x)]) * (x - int(x)))
    else:
        scale = (exact_quantiles(rows.select(size.alias("m")), ["m"], [0.95])["m"] or [1.0])[0]
    scale = scale if scale > 1e-12 else 1.0
    quality = F.coalesce(_optional(rows, "exact_quality"), _optional(rows, "quality"), F.lit(0.5))
    ranked = rows.withColumn("__r", 0.55 * quality + 0.25 * F.coalesce("utility", F.lit(0.5)) + 0.20 * F.least(size / scale, F.lit(1.0)))
    helps = (F.col("margin") <= 0) if reduce_dcr else (F.col("margin") > 0)
    lists = [(ranked.where(_optional(rows, "exact_quality").isNotNull()), 0.25), (ranked.where(helps), 0.45), (ranked.where(~helps), 0.15), (ranked, 1.0)]
    out = None
    for k, (own, share) in enumerate(lists):
        part = own.orderBy(F.desc("__r"), id_column).limit(round(limit * share)).select(id_column, "__r", F.lit(k).alias("__k"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(id_column).agg(F.min("__k").alias("__k"), F.first("__r").alias("__r")).orderBy("__k", F.desc("__r"), id_column).limit(limit)
    return rows.join(_side(first.select(id_column), limit), id_column, "left_semi")


def _side(df: DataFrame, n: int) -> DataFrame:
    """``df``, which has at most ``n`` rows, as a join's side that goes to every task where it is small."""
    return F.broadcast(df) if n <= SHARED_ROWS else df


def _optional(df: DataFrame, column: str):
    return F.col(column).cast("double") if column in df.columns else F.lit(None).cast("double")


def pair_edges(leaving: DataFrame, joining: DataFrame, id_column: str, metric: J.Metric, plan: Plan, target: str | None, group: bool = False, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(remove, add, distance, utility_gain, score, same): the nearest additions of each leaving row, in its target group or in all.

    ``sizes``: the rows of both sides, or more, where they are known.
    """
    sizes = sizes or (leaving.count(), joining.count())
    # Rows that want the same additions meet in a task, which can thin their edges.
    near = J.nearest(leaving, id_column, joining, id_column, metric, plan.neighbours, group=target if group else None, sizes=sizes, ranges=sizes[0] * min(plan.neighbours, sizes[1]) > FEW_EDGES)
    near = near.select(F.col(id_column).alias("remove"), F.col("neighbour").alias("add"), "distance")
    cols = lambda df, p: [F.col(id_column).alias(f"{p}_id"), F.abs("margin").alias(f"{p}_margin"), F.col("utility").alias(f"{p}_utility"), F.coalesce(_optional(df, "quality"), F.lit(0.5)).alias(f"{p}_quality"), *([F.col(target).alias(f"{p}_target")] if target else [])]
    out = near.join(_side(leaving.select(*cols(leaving, "r")), sizes[0]), F.col("remove") == F.col("r_id")).join(_side(joining.select(*cols(joining, "a")), sizes[1]), F.col("add") == F.col("a_id"))
    gain = F.col("a_utility") - F.col("r_utility")
    same = F.col("r_target").eqNullSafe(F.col("a_target")) if target and plan.stages != ("any",) else F.lit(True)
    score = F.col("distance") - plan.margin_weight * (F.col("r_margin") + F.col("a_margin")) - plan.utility_weight * gain - plan.quality_weight * (F.col("a_quality") - F.col("r_quality"))
    return out.select("remove", "add", "distance", gain.alias("utility_gain"), (score + F.when(same, 0.0).otherwise(plan.mismatch)).alias("score"), same.alias("same"))


def _in_order(t: pa.Table) -> np.ndarray:
    """Places of the edges in the greedy order; nulls first, as Spark sorts."""
    kinds = [t["same"].cast("int8").fill_null(-1)] if "same" in t.column_names else []
    keys = [-k.to_numpy() for k in kinds]
    for c in ("score", "distance", "remove", "add"):
        keys += [t[c].is_valid().to_numpy()] if t[c].null_count else []
        keys.append(t[c].fill_null(0).to_numpy())
    return np.lexsort(keys[::-1])


def _pairs(remove: list, add: list, gone: set, taken: set, need: int | None = None) -> list[int]:
    """Places of the edges, in the greedy order, that a greedy pass takes; ``gone`` and ``taken`` are the rows that are not free."""
    out = []
    for i, (r, a) in enumerate(zip(remove, add, strict=True)):
        if r not in gone and a not in taken and (need is None or len(gone) < need):
            gone.add(r)
            taken.add(a)
            out.append(i)
    return out


def _thinned(edges: DataFrame) -> DataFrame:
    """The edges without most of those that no greedy pass over all of them takes.

    A task matches some leaving rows, of which it has all edges, among themselves.  All edges stand in one order, so that more leaving
    rows only give an addition a better one: an edge that is worse for its addition than the pair found here is never taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= THIN_EDGES:
                t = pa.Table.from_batches(held)
                ids = t["remove"].to_numpy()
                whole = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
                if whole:
                    yield from some(t.slice(0, whole))
                held, rows = t.slice(whole).to_batches(), t.num_rows - whole
        if rows:
            yield from some(pa.Table.from_batches(held))

    def some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order = _in_order(t.combine_chunks())
        remove, add = (t[c].to_numpy()[order] for c in ("remove", "add"))
        ids, a = np.unique(add, return_inverse=True)
        most = np.full(len(ids), len(order))
        pairs = _pairs(remove.tolist(), add.tolist(), set(), set())
        most[a[pairs]] = pairs
        left = np.sort(order[np.arange(len(order)) <= most[a]])  # a row's edges stay together
        yield from t.take(pa.array(left)).combine_chunks().to_batches(65536)

    return edges.mapInArrow(run, edges.schema)


def _greedy_pass(edges: DataFrame, order: list, need: int | None = None, few: bool = False) -> DataFrame:
    """The greedy pass itself, in one task, until ``need`` pairs are found.  ``few``: the task can hold the edges, else they are sorted outside its memory."""
    few = few and all(dict(edges.dtypes)[c] == "bigint" for c in ("remove", "add"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        for rows in np.array_split(_in_order(t), t.num_rows // 65536 + 1):
            yield from t.take(pa.array(rows)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, taken = set(), set()
        values = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
        for batch in ordered(batches) if few else batches:
            if need is not None and len(gone) >= need:
                continue  # the input is read to its end
            yield batch.take(pa.array(_pairs(values(batch["remove"]), values(batch["add"]), gone, taken, need), pa.int64()))

    one = edges.repartition(1) if few else edges.coalesce(1).sortWithinPartitions(*order)
    return one.mapInArrow(run, edges.schema)


def _slices(edges: DataFrame, n: int, most: int) -> tuple[list, bool]:
    """Conditions that cut the edges, in the greedy order, into slices of about ``most`` rows, and whether all have about as many; equal scores stay together."""
    same = F.col("same") if "same" in edges.columns else F.lit(True)
    cuts = min(MOST_SLICES, -(-n // max(most, 1)))
    grid = [i / cuts for i in range(1, cuts)] or [0.5]
    points = {r.s: sorted(set(r.p or [])) for r in edges.groupBy(same.alias("s")).agg(F.percentile_approx("score", grid, 10000).alias("p")).collect()}
    even = n <= cuts * max(most, 1) and all(len(p) == len(grid) for p in points.values())
    out = []
    for s in sorted(points, key=lambda x: (x is not None, x), reverse=True):
        # Scores that are null come first.  The last slice has no upper end, so each edge is in one slice.
        ends = [None, *points[s], None]
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            under = F.lit(True) if high is None else F.col("score") <= F.lit(high)
            out.append(same.eqNullSafe(F.lit(s)) & (under | F.col("score").isNull() if low is None else under & (F.col("score") > F.lit(low))))
    return out, even


def greedy_match(edges: DataFrame, reuse: bool = False, most: int = PASS_EDGES, need: int | None = None) -> DataFrame:
    """The pairs a greedy pass in the order (score, distance, remove, add) takes, each row once; where edges say ``same``, those come first.

    More than ``most`` edges are passed through slice by slice in that order, each without the rows that the slices before took.
    ``need``: only the first so many pairs are looked for.
    ``reuse``: additions may serve several removals, so each removal's best edge is final.  Otherwise the pairs come written.
    """
    order = [F.col(c).asc() for c in ("score", "distance", "remove", "add")]
    first = [F.desc("same")] if "same" in edges.columns else []
    if reuse:
        order = [*first, *order]
        return edges.withColumn("__place", F.row_number().over(W.partitionBy("remove").orderBy(*order))).where("__place = 1").drop("__place")
    left, done, found = materialize(edges), None, 0
    n = left.count()
    if n <= most:
        return materialize(_greedy_pass(left, [*first, *order], need, True))
    slices, even = _slices(left, n, most)
    for own in slices:
        part = left.where(own)
        if done is not None:
            part = part.join(done.select("remove"), "remove", "left_anti").join(done.select("add"), "add", "left_anti").select(*left.columns)
        top = materialize(_greedy_pass(part, order, None if need is None else need - found, even))
        found += top.count()
        done = top if done is None else done.unionByName(top)
        if need is not None and found >= need:
            break
    return done


def match(leaving: DataFrame, joining: DataFrame, id_column: str, metric: J.Metric, plan: Plan, target: str | None, need: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Pairs (stage, remove, add, ...) by the plan's stages, until there are ``need`` of them or the stages are done.

    Of pairs with any addition, where the plan has floors, only those that reach the wanted one count, and all found are returned.
    """
    every, found, n = joining, None, 0
    sizes = all_sizes = sizes or (leaving.count(), joining.count())
    # Plans that fill up use the lower floor while they look for pairs; the others filter the pairs afterwards.
    floor = min(plan.floors) if plan.floors and "fill" in plan.stages else None
    for place, stage in enumerate(plan.stages):
        if n >= need:
            break
        if stage == "again":
            edges = pair_edges(leaving, every, id_column, metric, plan, target, sizes=(sizes[0], all_sizes[1]))
            pairs, more, wanted = greedy_match(_over(edges, floor), reuse=True), None, None
        else:
            own, some = leaving, sizes
            if stage == "fill":
                few = max(need - n, plan.fill_budget)
                own, some = materialize(leaving.orderBy(F.desc(F.abs("margin")), id_column).limit(few)), (min(few, sizes[0]), sizes[1])
            # Pairs with any addition that don't reach the wanted gain may be filtered afterwards: others have to be there then.
            wanted = plan.floors[0] if plan.floors and stage == "any" else None
            pairs, more, good = _unique_pairs(own, joining, id_column, metric, plan, target, need - n, stage, floor, some, wanted)
        pairs = pairs.withColumn("stage", F.lit(place))
        if wanted is None:
            if more is None or more > need - n:
                pairs = materialize(pairs.orderBy(F.desc("same"), "score", "distance", "remove", "add").limit(need - n))
                more = pairs.count()
            good = more
        found = pairs if found is None else found.unionByName(pairs)
        n += good
        if n < need and place + 1 < len(plan.stages) and more:
            sizes = tuple(x - more for x in sizes)
            leaving, joining = _without(leaving, joining, id_column, pairs, more)
    return found


def _without(leaving: DataFrame, joining: DataFrame, id_column: str, pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows of ``n`` pairs; they are written as one table."""
    gone = pairs.select(F.explode(F.array(F.struct(F.lit(True).alias("__l"), F.col("remove").alias(id_column)), F.struct(F.lit(False).alias("__l"), F.col("add").alias(id_column)))).alias("g")).select("g.*")
    both = leaving.withColumn("__l", F.lit(True)).unionByName(joining.withColumn("__l", F.lit(False)))
    left = materialize(both.join(_side(gone, 2 * n), ["__l", id_column], "left_anti").select(*both.columns))
    return left.where("__l").drop("__l"), left.where("not __l").drop("__l")


def _over(edges: DataFrame, floor: float | None) -> DataFrame:
    return edges if floor is None else edges.where(F.col("utility_gain") >= floor)


def _unique_pairs(leaving: DataFrame, joining: DataFrame, id_column: str, metric: J.Metric, plan: Plan, target: str | None, need: int, stage: str, floor: float | None, sizes: tuple[int, int], wanted: float | None = None) -> tuple[DataFrame, int, int]:
    """Pairs of one stage, each row once, their number, and how many of them reach the ``wanted`` gain, which all do without one.

    Leaving rows whose nearest additions are all taken look again among the free ones, each round at twice as many, until they have
    looked at all: of those, a greedy pass leaves no pair.
    """
    pairs, n, good, k = None, 0, 0, plan.neighbours
    while True:
        edges = pair_edges(leaving, joining, id_column, metric, replace(plan, neighbours=k), target, group=stage == "same" and target is not None, sizes=sizes)
        edges = edges.where(~F.col("same")) if stage == "cross" else edges
        edges = _over(edges, floor)
        if sizes[0] * min(k, sizes[1]) > FEW_EDGES:
            # Joined to sides that every task has, a row's edges still come together, and after those of near rows.
            edges = _thinned(edges if max(sizes) <= SHARED_ROWS else edges.repartition("remove").sortWithinPartitions("remove"))
        more = greedy_match(edges, need=need if wanted is None else None)
        found, reach = more.agg(F.count("*"), F.count_if(F.lit(True) if wanted is None else F.col("utility_gain") >= wanted)).first()
        pairs, n, good = more if pairs is None else pairs.unionByName(more), n + found, good + reach
        if found in (0, sizes[0]) or good >= need or k >= sizes[1]:
            return pairs, n, good
        sizes = sizes[0] - found, sizes[1] - found
        leaving, joining = _without(leaving, joining, id_column, more, found)
        k = max(k, min(2 * k, MOST_NEIGHBOURS))


def affordable(pairs: DataFrame, floors: tuple[float, float], need: int) -> DataFrame:
    """Pairs whose utility gain reaches the first floor if they are enough, else the lower floor; all if none does."""
    strict = pairs.where(F.col("utility_gain") >= floors[0])
    if strict.count() >= need:
        return strict
    lower = pairs.where(F.col("utility_gain") >= min(floors))
    return lower if lower.head(1) else pairs


def repair(pool: DataFrame, selected: DataFrame, id_column: str, metric: J.Metric, plan: Plan, target: str | None = None) -> tuple[DataFrame, dict]:
    """(selection after swaps, report).  ``pool`` has the signal (is_real_closer, margin), utility and the metric's columns.

    The result may hold a row of the pool several times where the plan lets additions be reused.
    """
    chosen = selected.select(id_column).distinct().withColumn("__own", F.lit(True))
    pool = materialize(pool.join(chosen, id_column, "left").withColumn("__own", F.coalesce("__own", F.lit(False))).select(*pool.columns, "__own"))
    closer = F.col("is_real_closer")
    rows = {(r["__own"], r.is_real_closer): r.n for r in pool.groupBy("__own", "is_real_closer").agg(F.count("*").alias("n")).collect()}
    n_own, known = (sum(rows.get((True, c), 0) for c in of) for of in ((True, False, None), (True, False)))
    dcr = rows.get((True, True), 0) / known if known else None
    report = {"applied": False, "base_dcr": dcr, "keep": n_own}
    if not n_own:
        return selected, report | {"reason": "empty_selection"}
    aim, reduce_dcr = target_of(dcr, plan.margin)
    in_band = abs(dcr - 0.5) <= plan.margin
    desired, most = round(abs(dcr - aim) * n_own), round(n_own * plan.max_fraction)
    report |= {"target_dcr": aim, "desired_swaps": desired}
    if in_band and plan.skip_in_band and not plan.accept_in_band_gain:
        return selected, report | {"reason": "inside_band"}
    if min(desired, most) <= 0:
        return selected, report | {"reason": "already_near_target"}
    own, free = (pool.where(c).drop("__own") for c in (F.col("__own"), ~F.col("__own")))
    leaving, n_leaving, n_joining = own.where(closer == F.lit(reduce_dcr)), rows.get((True, reduce_dcr), 0), rows.get((False, not reduce_dcr), 0)
    joining = free.where(closer != F.lit(reduce_dcr))
    need = min(desired, most)
    pairs = match(leaving, joining, id_column, metric, plan, target, need, (n_leaving, n_joining))
    if plan.floors:
        pairs = affordable(pairs, plan.floors, need)
    swaps = materialize(pairs.orderBy("stage", F.desc("same"), "score", "distance", "remove", "add").limit(need))
    n, gain, adds = swaps.agg(F.count("*"), F.avg("utility_gain"), F.count_distinct("add")).first()
    if not n:
        return selected, report | {"reason": "no_feasible_pairs"}
    if in_band and plan.accept_in_band_gain and (gain or 0.0) <= 0:
        return selected, report | {"reason": "no_utility_gain_inside_band"}
    kept = own.join(_side(swaps.select(F.col("remove").alias(id_column)), n), id_column, "left_anti")
    added = pool.drop("__own").join(_side(swaps.select(F.col("add").alias("__a")), n), F.col("__a") == F.col(id_column)).drop("__a")
    # Each swap takes one row off the side that is too large.
    final = (rows.get((True, True), 0) + (-n if reduce_dcr else n)) / known
    return kept.unionByName(added), report | {"applied": True, "swaps": n, "final_dcr": final, "mean_utility_gain": gain, "duplicates": n - adds}


def signal_columns(columns: list[str], scope: str, privacy: list[str] | None = None, theta: list[str] | None = None) -> list[str]:
    """The columns that the distance signal reads: full, the privacy scope, or the theta's."""
    use = {"full": columns, "privacy": privacy or columns, "theta": theta or privacy or columns}[scope]
    return [c for c in columns if c in use]
