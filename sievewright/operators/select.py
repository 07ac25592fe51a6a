"""Choosing K rows: random, scalar, Chebyshev, quota-constrained, swaps, floors, refinement."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.functions.scalars import largest_remainders
from sievewright.operators import fidelity as D
from sievewright.operators import pareto as P
from sievewright.operators.ranks import global_row_number, running_sums
from sievewright.plans.workspace import materialize


def shuffled(id_column: str, seed: int) -> Column:
    """A fixed shuffle's key."""
    return F.xxhash64(F.lit(seed), F.col(id_column))


def keep_random(df: DataFrame, id_column: str, keep: int, seed: int, order: Column | None = None) -> DataFrame:
    return df.orderBy(shuffled(id_column, seed) if order is None else order, id_column).limit(keep)


def keep_first(df: DataFrame, id_column: str, keep: int) -> DataFrame:
    return df.orderBy(id_column).limit(keep)


def scalar_score(objectives: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted mean of objectives in [0, 1], to 12 digits, so that equal scores are ties; weights at or below 0 count 1e-6."""
    w = [x if x > 0 else 1e-6 for x in weights]
    return F.round(sum((F.col(c) * (x / sum(w)) for c, x in zip(objectives, w, strict=True)), F.lit(0.0)), 12)


def keep_scalar(df: DataFrame, id_column: str, objectives: Sequence[str], weights: Sequence[float], keep: int) -> DataFrame:
    return df.withColumn("score", scalar_score(objectives, weights)).orderBy(F.desc("score"), id_column).limit(keep)


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_mm`` by two aggregates, without a global window."""
    ends = df.agg(*[f(c).alias(f"{c}__{k}") for c in columns for k, f in (("a", F.min), ("b", F.max))]).first()
    scale = lambda c: F.lit(0.0) if (ends[f"{c}__b"] or 0) - (ends[f"{c}__a"] or 0) <= 1e-12 else (F.col(c) - ends[f"{c}__a"]) / (ends[f"{c}__b"] - ends[f"{c}__a"])
    return df.withColumns({f"{c}_mm": scale(c) for c in columns})


def keep_chebyshev(df: DataFrame, id_column: str, objectives: Sequence[str], weights: Sequence[float], keep: int, tie: str) -> DataFrame:
    """The smallest worst weighted gap to the ideal point: .85 of 1 - its scale, .10 mean, .05 tie."""
    ideal = df.agg(*[F.max(c).alias(c) for c in objectives]).first()
    gap = F.greatest(*[(F.lit(float(ideal[c])) - F.col(c)) * w for c, w in zip(objectives, weights, strict=True)])
    out = minmax(df.withColumn("gap", gap), ["gap"])
    mean = sum((F.col(c) for c in objectives[1:]), F.col(objectives[0])) / len(objectives)
    score = F.round(0.85 * (1 - F.col("gap_mm")) + 0.10 * mean + 0.05 * F.col(tie), 12)
    return out.withColumn("score", score).orderBy(F.desc("score"), id_column).limit(keep).drop("gap_mm")


#: Weights of the directions, in hundredths, for 1-D fidelity (f), 2-D fidelity (t), privacy (p), utility (u).
DIRECTIONS = (
    (100, 0, 0, 0),
    (0, 100, 0, 0),
    (0, 0, 100, 0),
    (0, 0, 0, 100),
    (50, 50, 0, 0),
    (50, 0, 50, 0),
    (0, 50, 50, 0),
    (50, 0, 0, 50),
    (0, 50, 0, 50),
    (0, 0, 50, 50),
    (25, 25, 25, 25),
)


def direction_name(weights: Sequence[int]) -> str:
    """As ``f050_t050_p000_u000``."""
    return "_".join(f"{k}{w:03d}" for k, w in zip("ftpu", weights, strict=True))


def direction_family(df: DataFrame, id_column: str, objectives: Sequence[str], keep: int, mode: str = "naive") -> DataFrame:
    """(direction, id, score, place): the best rows for each of the weightings.

    ``naive``: the objectives' weighted mean.  ``matched``: of the objectives scaled to [0, 1], with weights of 1e-6 at least.  ``pareto``: by
    fronts and crowding of the objectives that have a weight, the score being minus the front.  Scalar modes explode rows with their scores, and
    each task's top rows are cut before the shuffle by the rank limit.
    """
    if mode == "pareto":
        out = None
        for w in DIRECTIONS:
            own = [c for c, x in zip(objectives, w, strict=True) if x]
            front = P.nsga_select(df, id_column, own, keep) if len(own) > 1 else df.withColumn("front", F.dense_rank().over(W.orderBy(F.desc(own[0]))) - 1).orderBy("front", id_column).limit(keep)
            best = front.select(F.lit(direction_name(w)).alias("direction"), id_column, (-F.col("front")).cast("double").alias("score"))
            out = best if out is None else out.unionByName(best)
        return out.withColumn("place", F.row_number().over(W.partitionBy("direction").orderBy(F.desc("score"), id_column)))
    if mode == "matched":
        df, objectives = minmax(df, objectives), [f"{c}_mm" for c in objectives]
    weight = lambda x: x / 100 if mode == "naive" else max(x / 100, 1e-6)
    per = F.array(*[F.struct(F.lit(n).alias("direction"), scalar_score(objectives, [weight(x) for x in w]).alias("score")) for w in DIRECTIONS for n in [direction_name(w)]])
    rows = df.select(id_column, F.explode(per).alias("d")).select(id_column, "d.direction", "d.score")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("direction").orderBy(F.desc("score"), id_column))).where(F.col("place") <= keep)


def allocate(probs: Sequence[float], available: Sequence[int], budget: int) -> list[int]:
    """Whole numbers near probs * budget, within availability, that sum to min(budget, sum available).

    By largest remainders; what availability cuts off is shared again among the others.
    """
    out = [0] * len(probs)
    left = min(budget, sum(available))
    while left > 0:
        open_ = [i for i, most in enumerate(available) if out[i] < most]
        for i, n in zip(open_, largest_remainders([probs[i] for i in open_], left), strict=True):
            out[i] = min(out[i] + n, available[i])
        left = min(budget, sum(available)) - sum(out)
    return out


def quota_targets(codes: DataFrame, reference: D.Reference, keep: int, mode: str = "train_clipped_by_availability") -> dict[str, list[int]]:
    """Counts to reach for each column's buckets: by the pool's shares, or the train table's within what the pool has."""
    cards, out = reference.cards, {}
    have = {c: [0] * cards.size(c) for c in reference.columns}
    for r in D.code_counts(codes, reference.columns).collect():
        have[r["column"]][r["code"]] = r.n
    for c in reference.columns:
        total = max(1, sum(have[c]))
        out[c] = allocate([n / total for n in have[c]] if mode == "available_empirical" else reference.probs[c], have[c], keep)
    return out


def quota_fill(codes: DataFrame, reference: D.Reference, id_column: str, keep: int, targets: dict[str, list[int]], base: str | None = None, batches: int = 24) -> DataFrame:
    """Rows chosen in batches by their buckets' open quotas, plus .10 of a base score.

    Each batch is one projection over the pool with the open quotas as look-up expressions, a top-k, and the new counts; the quotas
    are as many numbers as there are buckets.  The chosen rows' keys are a written table.
    """
    columns = reference.columns
    counts = {c: [0] * len(t) for c, t in targets.items()}
    # A batch has at least 128 rows, or all that is asked for; small requests need few rounds.
    size = max(1, min(keep, min(1536, max(128, round(keep / batches)))))
    rest, chosen, done = materialize(codes), None, 0
    while done < keep:
        open_ = {c: [max(0.0, (t - n) / max(t, 1)) for t, n in zip(targets[c], counts[c], strict=True)] for c in columns}
        need = sum((S.lookup(F.col(c), open_[c], -1.0) for c in columns), F.lit(0.0)) / len(columns)
        score = need + (0.10 * F.col(base) if base else 0.0)
        top = materialize(rest.withColumn("__score", score).orderBy(F.desc("__score"), id_column).limit(min(size, keep - done)).drop("__score"))
        n = top.count()
        if not n:
            break
        for r in D.code_counts(top, columns).collect():
            counts[r["column"]][r["code"]] += r.n
        done += n
        chosen = top if chosen is None else chosen.unionAll(top)
        rest = rest.join(top.select(id_column), id_column, "left_anti")
        if done < keep:
            rest = materialize(rest)
    return chosen if chosen is not None else codes.limit(0)


def alignment(counts: dict[str, list[int]], targets: dict[str, list[int]]) -> float:
    """Mean over columns of 1 - half the absolute difference of shares."""
    out = []
    for c, t in targets.items():
        a, b = max(1, sum(counts[c])), max(1, sum(t))
        out.append(1 - 0.5 * sum(abs(x / a - y / b) for x, y in zip(counts[c], t, strict=True)))
    return sum(out) / len(out)


def counts_of(codes: DataFrame, reference: D.Reference) -> dict[str, list[int]]:
    out = {c: [0] * reference.cards.size(c) for c in reference.columns}
    for r in D.code_counts(codes, reference.columns).collect():
        out[r["column"]][r["code"]] = r.n
    return out


def support_scores(current: DataFrame, reference: D.Reference, targets: dict[str, list[int]] | None = None) -> dict[str, Column]:
    """remove_1d, add_1d, remove_2d, add_2d: how much a row's buckets are over, or short of, what is wanted.

    Against target counts: gaps relative to the target (at least 1).  Without targets: against the real table's shares.
    Columns count alike; pairs by their mutual information over max(its sum, 1).  ``current`` holds codes.
    """
    cards, n = reference.cards, max(1, current.count())

    def gaps(have: list[int], probs: list[float], target: list[int] | None) -> tuple[list[float], list[float]]:
        diff = [h / n - p for h, p in zip(have, probs, strict=True)] if target is None else [(h - t) / max(t, 1) for h, t in zip(have, target, strict=True)]
        return [max(0.0, d) for d in diff], [max(0.0, -d) for d in diff]

    counts, out = counts_of(current, reference), {}
    one = [(F.col(c), gaps(counts[c], reference.probs[c], targets and targets[c])) for c in reference.columns]
    for k, name in enumerate(("remove_1d", "add_1d")):
        out[name] = sum((S.lookup(code, g[k], 0.0) for code, g in one), F.lit(0.0)) / len(one)
    pairs = {(a, b): [0] * len(reference.pair_probs[a, b]) for a, b, _ in reference.edges}
    if pairs:
        for r in D.pair_counts(current, cards, list(pairs)).collect():
            pairs[r.left, r.right][r.code] = r.n
    weight = max(sum(mi for *_, mi in reference.edges), 1.0)
    two = [(S.pair_code(F.col(a), F.col(b), cards.size(b)), mi / weight, gaps(pairs[a, b], reference.pair_probs[a, b], None)) for a, b, mi in reference.edges]
    for k, name in enumerate(("remove_2d", "add_2d")):
        out[name] = sum((S.lookup(code, g[k], 0.0) * w for code, w, g in two), F.lit(0.0))
    return out


def refine_to_targets(selected: DataFrame, pool: DataFrame, reference: D.Reference, id_column: str, targets: dict[str, list[int]], rounds: int = 6, batch: int = 64) -> DataFrame:
    """Swaps of batches that bring the counts nearer to the targets; a batch that doesn't is halved, then given up.

    Removed rows hold the most oversupplied buckets and added rows the most wanted; both come from one top-k each.
    """
    now, counts = materialize(selected), counts_of(selected, reference)
    best = alignment(counts, targets)
    for _ in range(rounds):
        over = {c: [n - t for n, t in zip(counts[c], targets[c], strict=True)] for c in reference.columns}
        score = sum((S.lookup(F.col(c), [x / max(1, sum(counts[c])) for x in over[c]], 1.0) for c in reference.columns), F.lit(0.0))
        drop = now.withColumn("__s", score).orderBy(F.desc("__s"), id_column).limit(batch)
        add = pool.join(now.select(id_column), id_column, "left_anti").withColumn("__s", score).orderBy("__s", id_column).limit(batch)
        out, new = materialize(drop.drop("__s")), materialize(add.drop("__s"))
        if not new.count():
            break
        a, b = counts_of(out, reference), counts_of(new, reference)
        trial = {c: [n - x + y for n, x, y in zip(counts[c], a[c], b[c], strict=True)] for c in counts}
        if out.count() == new.count() and alignment(trial, targets) > best + 1e-12:
            now = materialize(now.join(out.select(id_column), id_column, "left_anti").unionByName(new))
            counts, best = trial, alignment(trial, targets)
        elif batch > 1:
            batch //= 2
        else:
            break
    return now


def signature_swaps(selected: DataFrame, pool: DataFrame, columns: Sequence[str], id_column: str, score: str, most: int | None = None) -> DataFrame:
    """(signature, remove_id, add_id, gain): within equal bucket vectors, the worst selected with the best available row.

    Pairs are an equi-join of two rankings; all stay, or the ``most`` best gains.  Gains fall with the rank, so ranks over ``most``
    aren't needed, and each task then cuts a large signature's rows before the shuffle.
    """
    sig = F.xxhash64(*columns)
    free = pool.join(selected.select(id_column), id_column, "left_anti")
    rank = lambda df, order: df.withColumn("sig", sig).withColumn("rn", F.row_number().over(W.partitionBy("sig", *columns).orderBy(order, id_column))).where(F.col("rn") <= (most or (1 << 31) - 1))
    a = rank(selected, F.asc(score)).select(*columns, "rn", F.col(id_column).alias("remove_id"), F.col(score).alias("__old"))
    b = rank(free, F.desc(score)).select(*columns, "rn", F.col(id_column).alias("add_id"), F.col(score).alias("__new"))
    pairs = a.join(b, [*columns, "rn"]).withColumn("gain", F.col("__new") - F.col("__old")).where("gain > 0")
    pairs = pairs.select(*columns, "remove_id", "add_id", "gain")
    return pairs if most is None else pairs.orderBy(F.desc("gain"), "remove_id").limit(most)


def guard_band(df: DataFrame, id_column: str, marginal: str, keep: int) -> DataFrame:
    """All rows with a non-negative margin if they are enough, else the best keep + max(128, a quarter)."""
    good = df.where(F.col(marginal) >= 0)
    if good.count() >= keep:
        return good
    return df.orderBy(F.desc(marginal), id_column).limit(keep + max(128, math.ceil(0.25 * keep)))


def floor_repair(selected: DataFrame, pool: DataFrame, id_column: str, value: str, floor: float, score: str, rounds: int = 6) -> DataFrame:
    """Raises the selection's mean of ``value`` to ``floor`` by swapping its lowest rows for the pool's highest.

    The number of swaps follows from running sums over both rankings, so one round is enough; ranks and sums run over range partitions.
    """
    stats = selected.agg(F.avg(value).alias("m"), F.count("*").alias("n")).first()
    if stats.m is None or stats.m >= floor:
        return selected
    free = pool.join(selected.select(id_column), id_column, "left_anti")
    ranked = lambda df, order: global_row_number(df, [order, F.desc(score), F.col(id_column)])
    a = ranked(selected, F.asc(value)).select("rn", F.col(id_column).alias("r"), F.col(value).alias("old"))
    b = ranked(free, F.desc(value)).select("rn", F.col(id_column).alias("a"), F.col(value).alias("new"))
    gains = a.join(b, "rn").withColumn("gain", F.col("new") - F.col("old")).where("gain > 0")
    summed = running_sums(gains, [], [F.col("rn")], {"upto": "gain"}).withColumn("before", F.col("upto") - F.col("gain"))
    swaps = materialize(summed.where(F.col("before") < (floor - stats.m) * stats.n - 1e-9))
    kept = selected.join(swaps.select(F.col("r").alias(id_column)), id_column, "left_anti")
    return kept.unionByName(pool.join(swaps.select(F.col("a").alias(id_column)), id_column, "left_semi"))


def constrained_subset(df: DataFrame, id_column: str, objectives: Sequence[str], floors: dict[str, float], keep: int, anchor: DataFrame | None = None) -> DataFrame:
    """K rows from three starts (an anchor, the mean of the objectives, a fidelity band of 1.75 K), each repaired to the floors.

    The best start that meets the floors wins, by the mean of the objectives; else the one with the least shortfall.
    """
    score = sum((F.col(c) for c in objectives[1:]), F.col(objectives[0])) / len(objectives)
    own = df.withColumn("__score", score)
    starts = [own.orderBy(F.desc("__score"), id_column).limit(keep)]
    band = own.orderBy(F.desc(objectives[0]), id_column).limit(math.ceil(1.75 * keep))
    starts.append(band.orderBy(F.desc("__score"), id_column).limit(keep))
    if anchor is not None:
        starts.append(own.join(anchor.select(id_column), id_column, "left_semi").limit(keep))
    best, best_key = None, None
    for start in starts:
        now = start
        for c, floor in floors.items():
            now = materialize(floor_repair(now, own, id_column, c, floor, "__score"))
        row = now.agg(*[F.avg(c).alias(c) for c in objectives], F.avg("__score").alias("__score")).first()
        short = sum(max(0.0, f - (row[c] or 0.0)) for c, f in floors.items())
        key = (-round(short, 12), row["__score"] or 0.0)
        if best is None or key > best_key:
            best, best_key = now, key
    return best.drop("__score")


def dcr_rebalance(df: DataFrame, selected: DataFrame, id_column: str, gap: str, quality: str, fraction: float = 0.5, exchange: float = 0.5) -> tuple[DataFrame, dict]:
    """Exchanges rows of the selection's majority side of ``gap`` (>= 0 counts as closer to the real rows) for the other side's.

    As many as bring the share to ``fraction``, within ``exchange`` of the selection and what the pool has; rows leave in ascending and
    join in descending order of quality, then of |gap|.
    """
    n = selected.count()
    closer = selected.where(F.col(gap) >= 0).count()
    want = round(n * fraction)
    side = closer > want
    wrong = F.col(gap) >= 0 if side else F.col(gap) < 0
    free = df.join(selected.select(id_column), id_column, "left_anti").where(~wrong)
    moves = min(abs(closer - want), int(n * exchange), free.count())
    if moves <= 0:
        return selected, {"exchange": 0, "reason": "already_balanced_or_no_exchange"}
    out = selected.where(wrong).orderBy(quality, F.desc(F.abs(gap)), id_column).limit(moves)
    new = free.orderBy(F.desc(quality), F.abs(gap), id_column).limit(moves)
    return selected.join(out.select(id_column), id_column, "left_anti").unionByName(new), {"exchange": moves, "reason": "exchanged"}


def swap_sizes(selected: DataFrame, pool: DataFrame, id_column: str, value: str, sizes: Sequence[int]) -> DataFrame:
    """(size, total): the selection's sum of ``value`` after each number of swaps, all sizes from one pair of running sums."""
    n = max(sizes)
    free = pool.join(selected.select(id_column), id_column, "left_anti")
    ranked = lambda df, order: df.orderBy(order, id_column).limit(n).withColumn("rn", F.row_number().over(W.orderBy(order, id_column)))  # noqa: E731  at most max(sizes) rows
    a = ranked(selected, F.asc(value)).select("rn", F.col(value).alias("old"))
    b = ranked(free, F.desc(value)).select("rn", F.col(value).alias("new"))
    steps = a.join(b, "rn").withColumn("gain", F.sum(F.col("new") - F.col("old")).over(W.orderBy("rn")))
    base = selected.agg(F.sum(value)).first()[0] or 0.0
    return steps.where(F.col("rn").isin(*sizes)).select(F.col("rn").alias("size"), (F.col("gain") + base).alias("total"))


def refine_for_reward(selected: DataFrame, pool: DataFrame, id_column: str, value: str, sizes: Sequence[int], means: Sequence[str], floors: dict[str, float], shift: float = 0.05) -> DataFrame:
    """(size, reward, feasible, each mean): selections after swaps of several sizes, judged together.

    A size swaps the lowest selected rows by ``value`` for the highest free ones.  Every size's means follow from the selection's sums and
    running sums over the two rankings; feasible are those that keep the ``floors``, and the reward is the shifted geometric mean of the means.
    """
    n, most = selected.count(), max(sizes)
    free = pool.join(selected.select(id_column), id_column, "left_anti")
    ranked = lambda df, order: df.orderBy(order, id_column).limit(most).withColumn("rn", F.row_number().over(W.orderBy(order, id_column)))  # noqa: E731  at most max(sizes) rows
    a = ranked(selected, F.asc(value)).select("rn", *[F.col(c).alias(f"__a_{c}") for c in means])
    b = ranked(free, F.desc(value)).select("rn", *[F.col(c).alias(f"__b_{c}") for c in means])
    base = selected.agg(*[F.sum(c).alias(c) for c in means]).first()
    by = W.orderBy("rn")
    out = a.join(b, "rn").withColumns({c: (F.sum(F.col(f"__b_{c}") - F.col(f"__a_{c}")).over(by) + F.lit(float(base[c] or 0.0))) / F.lit(float(max(n, 1))) for c in means})
    none = out.limit(0).select("rn", *means).unionByName(selected.sparkSession.createDataFrame([(0, *[float(base[c] or 0.0) / max(n, 1) for c in means])], "rn int, " + ", ".join(f"{c} double" for c in means)))
    out = none.unionByName(out.where(F.col("rn").isin(*sizes)).select("rn", *means))
    fine = F.lit(True)
    for c, least in floors.items():
        fine = fine & (F.col(c) >= least - 1e-12)
    reward = S.shifted_geomean([S.clip(F.col(c), 0, 1) for c in means], [1.0] * len(means), shift)
    return out.select(F.col("rn").alias("size"), reward.alias("reward"), fine.alias("feasible"), *means)


def best_swap_size(sizes: DataFrame) -> DataFrame:
    """The feasible size with the highest reward, ties to the smaller; no swap where none is feasible."""
    best = sizes.orderBy(F.desc("feasible"), F.when(F.col("feasible"), -F.col("reward")).otherwise(F.col("size")), "size").limit(1)
    return best


def preselect_gate(candidate: dict, baseline: dict, random: dict, thresholds: dict[str, float]) -> dict:
    """Deltas against the baseline and a random selection, and whether the candidate passes.

    Raw DCR counts as better when lower here: its gain is base - target.
    """
    def delta(a: dict, b: dict) -> dict:
        return {k: (b[k] - a[k] if k == "dcr" else a[k] - b[k]) for k in a if k in b}

    base, rand = delta(candidate, baseline), delta(candidate, random)
    failed = [k for k, t in thresholds.items() if base.get(k, 0.0) < t]
    return {"delta_baseline": base, "delta_random": rand, "failed": failed, "passed": not failed}


def rerank_finalists(finalists: list[dict], floors: dict[str, float], score: str, current: str, margin: float = 0.0) -> dict:
    """The best finalist with distinct ids that meets the floors; the current one stays unless it is beaten by ``margin``."""
    seen, unique = set(), []
    for f in finalists:
        key = frozenset(f["ids"])
        if key not in seen:
            seen.add(key)
            unique.append(f)
    ok = [f for f in unique if all(f.get(k, -math.inf) >= v for k, v in floors.items())]
    now = next((f for f in unique if f["name"] == current), None)
    best = max(ok, key=lambda f: (f[score], f["name"] == current), default=now)
    if now is not None and best is not None and best is not now and now in ok and best[score] < now[score] + margin:
        best = now
    return best


def pareto_keep(df: DataFrame, id_column: str, objectives: Sequence[str], keep: int, floors: dict[str, float] | None = None) -> DataFrame:
    """The constrained subset where floors are given, else whole fronts and crowding."""
    return constrained_subset(df, id_column, objectives, floors, keep) if floors else P.nsga_select(df, id_column, objectives, keep)
