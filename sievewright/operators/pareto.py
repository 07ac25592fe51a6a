"""Non-dominated sorting (maximising), crowding, front-wise selection, hypervolume."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions.scalars import largest_remainders
from sievewright.plans.workspace import materialize

#: Points that are compared with at a time; a front of more goes out in several waves.
WAVE = 1 << 16


def skyline(x: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row dominates; sorted by sum, a row is only compared with survivors."""
    order = np.argsort(-x.sum(axis=1), kind="stable")
    keep: list[int] = []
    front = np.empty((0, x.shape[1]))
    for low in range(0, len(order), 512):
        idx = order[low : low + 512]
        block = x[idx]
        every = np.concatenate((front, block))
        dominated = np.zeros(len(block), dtype=bool)
        for start in range(0, len(every), 4096):
            part = every[start : start + 4096]
            dominated |= ((part[None] >= block[:, None]).all(axis=2) & (part[None] > block[:, None]).any(axis=2)).any(axis=1)
        keep += idx[~dominated].tolist()
        front = np.concatenate((front, block[~dominated]))
    out = np.zeros(len(x), dtype=bool)
    out[keep] = True
    return out


def _local(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each partition's own skyline: a superset of the global one, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            x = np.column_stack([held[c].to_numpy() for c in names]) if held.num_rows else np.empty((0, len(names)))
            held = held.filter(pa.array(skyline(x)))
        if held is not None:
            yield from held.to_batches()

    return points.mapInArrow(run, points.schema)


def front_zero(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of distinct ``points`` (one column a name) that none dominates."""
    near = materialize(_local(points.select(*names), names))
    n = near.count()
    waves = max(1, -(-n // WAVE))
    out = near
    for w in range(waves):
        part = near if waves == 1 else near.where(F.pmod(F.xxhash64(*names), F.lit(waves)) == w)
        t = part.toArrow()  # at most about WAVE rows
        shared = points.sparkSession.sparkContext.broadcast(np.column_stack([t[c].to_numpy() for c in names]) if t.num_rows else np.empty((0, len(names))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ref = shared.value
            for b in batches:
                x = np.column_stack([b[c].to_numpy() for c in names]) if b.num_rows else np.empty((0, len(names)))
                keep = np.ones(len(x), dtype=bool)
                for low in range(0, len(x), 256):
                    block = x[low : low + 256]
                    for start in range(0, len(ref), 4096):
                        r = ref[start : start + 4096]
                        keep[low : low + 256] &= ~((r[None] >= block[:, None]).all(axis=2) & (r[None] > block[:, None]).any(axis=2)).any(axis=1)
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out


def fronts(df: DataFrame, id_column: str, objectives: Sequence[str], need: int | None = None) -> DataFrame:
    """(id, front): peels non-dominated fronts of the distinct points until ``need`` rows are covered; later rows have no front.

    Constant objectives decide nothing and are dropped; equal points share a front.
    """
    ends = df.agg(*[f(c).alias(f"{c}__{k}") for c in objectives for k, f in (("a", F.min), ("b", F.max))]).first()
    live = [c for c in objectives if ends[f"{c}__a"] != ends[f"{c}__b"]]
    if not live:
        return df.select(id_column, F.lit(0).alias("front"))
    points = materialize(df.groupBy(*live).agg(F.count("*").alias("__rows")))
    left, done, covered, total = points, None, 0, df.count()
    want = total if need is None else min(need, total)
    k = 0
    while covered < want:
        top = materialize(front_zero(left, live).join(points, live).withColumn("front", F.lit(k)))
        done = top if done is None else done.unionAll(top)
        covered += top.agg(F.sum("__rows")).first()[0] or 0
        left = left.join(top.select(*live), live, "left_anti")
        if k % 8 == 7:
            left = materialize(left)
        k += 1
    named = done.select(*[F.col(c).alias(f"__{c}") for c in live], "front")
    cond = F.lit(True)
    for c in live:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    return df.join(named, cond, "left").select(id_column, "front")


def front_zero_2d(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of the first front of two objectives: one row for each x, and a running maximum over the partitions' skylines."""
    best = _local(df.groupBy(x).agg(F.max(y).alias(y)), [x, y]).groupBy(x).agg(F.max(y).alias("__top"))
    above = best.withColumn("__above", F.max("__top").over(W.orderBy(F.desc(x)).rowsBetween(W.unboundedPreceding, -1)))
    top = above.where("__above is null or __top > __above").select(F.col(x).alias("__x"), "__top")
    return df.join(top, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__top"))).drop("__x", "__top")


def crowding(df: DataFrame, id_column: str, objectives: Sequence[str], front: str = "front") -> DataFrame:
    """Adds ``crowding``: the neighbours' gaps summed over objectives; the ends of a front infinite, ties by id."""
    ends, total = F.lit(False), F.lit(0.0)
    for c in objectives:
        w = W.partitionBy(front).orderBy(c, id_column)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        low, high = F.first(c).over(whole), F.last(c).over(whole)
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        ends = ends | before.isNull() | after.isNull()
        total = total + F.when(high - low <= 1e-12, F.lit(0.0)).otherwise(F.coalesce((after - before) / (high - low), F.lit(0.0)))
    return df.withColumn("crowding", F.when(ends, F.lit(float("inf"))).otherwise(F.round(total, 12)))


def priority(objectives: Sequence[str], utility: str, privacy: str, fidelity: str, id_column: str) -> list[Column]:
    """front, -sum, -crowding, -utility, -privacy, -fidelity, id."""
    total = sum((F.col(c) for c in objectives[1:]), F.col(objectives[0]))
    return [F.col("front").asc(), total.desc(), F.col("crowding").desc(), F.col(utility).desc(), F.col(privacy).desc(), F.col(fidelity).desc(), F.col(id_column).asc()]


def nsga_select(df: DataFrame, id_column: str, objectives: Sequence[str], keep: int) -> DataFrame:
    """Whole fronts while they fit; the last one by crowding, sum and objectives, all descending, then id."""
    ranked = crowding(df.join(fronts(df, id_column, objectives, keep), id_column).where("front is not null"), id_column, objectives)
    total = F.round(sum((F.col(c) for c in objectives[1:]), F.col(objectives[0])), 9)
    return ranked.orderBy("front", F.desc("crowding"), total.desc(), *[F.desc(c) for c in objectives], id_column).limit(keep)


def nsga_places(x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """``nsga_select`` of rows at hand, none with a gap: the places of the selected rows, best first."""
    live = x[:, np.ptp(x, axis=0) > 0] if len(x) else x
    points, point, rows = np.unique(live, axis=0, return_inverse=True, return_counts=True)
    point, level, left, k = point.reshape(-1), np.full(len(points), -1), np.arange(len(points)), 0
    while len(left) and rows[level >= 0].sum() < min(keep, len(x)):
        top = skyline(points[left]) if live.shape[1] else np.ones(len(left), dtype=bool)
        level[left[top]], left, k = k, left[~top], k + 1
    front = level[point]
    crowd = np.zeros(len(x))
    for f in range(k):
        own = np.flatnonzero(front == f)
        for c in x.T:
            by = own[np.lexsort((ids[own], c[own]))]
            wide = c[by[-1]] - c[by[0]]
            if wide > 1e-12:
                crowd[by[1:-1]] += (c[by[2:]] - c[by[:-2]]) / wide
            crowd[by[[0, -1]]] = np.inf
    order = np.lexsort((ids, *-x.T[::-1], -np.round(x.sum(axis=1), 9), -np.round(crowd, 12), front))
    return order[front[order] >= 0][:keep]


def stratum_caps(counts: dict, budget: int, shares: dict | None = None) -> dict:
    """Whole caps near the strata's shares of the budget, by largest remainders, between one and what a stratum has.

    ``shares`` are the training strata's probabilities; without them, the strata's own sizes.  Caps over the budget, as each stratum keeps
    one, are lowered from the largest on, but not below one.
    """
    names = sorted(counts, key=str)
    if not sum(counts.values()) or budget <= 0:
        return dict.fromkeys(counts, 0)
    wanted = largest_remainders([(shares or counts).get(k, 0.0) for k in names], min(budget, sum(counts.values())))
    caps = {k: min(counts[k], max(1, n)) for k, n in zip(names, wanted, strict=True)}
    for _ in range(sum(caps.values()) - budget):
        largest = max(caps, key=lambda k: (caps[k], str(k)))
        caps[largest] = max(1, caps[largest] - 1)
    return caps


def stratified_reduce(df: DataFrame, stratum: str, order: Sequence[Column], keep: int, shares: dict | None = None) -> DataFrame:
    """Each stratum's cap by priority, then the best of the rest up to ``keep``."""
    counts = {r[stratum]: r["count"] for r in df.groupBy(stratum).count().collect()}  # one row a stratum
    caps = stratum_caps(counts, keep, shares)
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.coalesce(F.lit(k).cast("string"), F.lit("")), F.lit(v))])
    rn = F.row_number().over(W.partitionBy(stratum).orderBy(*order))
    own = df.withColumn("__in", (rn <= cap[F.coalesce(F.col(stratum).cast("string"), F.lit(""))]).cast("int"))
    return own.orderBy(F.desc("__in"), *order).limit(keep).drop("__in")


def hypervolume_2d(df: DataFrame, x: str, y: str, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row: the area that the first front dominates above ``ref``."""
    front = front_zero_2d(df.where((F.col(x) > ref[0]) & (F.col(y) > ref[1])), x, y).select(x, y).distinct()
    nxt = F.coalesce(F.lead(x).over(W.orderBy(F.desc(x))), F.lit(float(ref[0])))
    return front.withColumn("__w", (F.col(x) - nxt) * (F.col(y) - ref[1])).agg(F.coalesce(F.sum("__w"), F.lit(0.0)).alias("hypervolume"))


def hypervolume_3d(points: np.ndarray, ref: Sequence[float] = (0.0, 0.0, 0.0)) -> float:
    """Volume by slices along the third objective, for a front on the driver."""
    p = points[(points > np.asarray(ref)).all(axis=1)]
    p = p[np.argsort(-p[:, 2], kind="stable")]
    volume, levels = 0.0, np.append(p[1:, 2], ref[2]) if len(p) else []
    for i in range(len(p)):
        if p[i, 2] > levels[i]:
            area, top = 0.0, ref[1]
            for a, b in sorted(p[: i + 1, :2].tolist(), reverse=True):
                if b > top:
                    area += (a - ref[0]) * (b - top)
                    top = b
            volume += area * (p[i, 2] - levels[i])
    return float(volume)


def dominance_certificate(a: dict, b: dict, keys: Sequence[str], tolerance: float = 1e-12) -> str:
    """"a", "b" or "none": which of two summaries dominates."""
    ge, le = all(a[k] >= b[k] - tolerance for k in keys), all(a[k] <= b[k] + tolerance for k in keys)
    gt, lt = any(a[k] > b[k] + tolerance for k in keys), any(a[k] < b[k] - tolerance for k in keys)
    return "a" if ge and gt else "b" if le and lt else "none"


def dominated_volume(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: the volume that a table's first front dominates above the origin.

    Slabs between neighbouring values of x, each times the area under the running maximum of z over the points that reach the slab:
    a join of the front with its own x values, and windows.  Only the front, not the table, is paired.
    """
    points = df.where((F.col(x) > 0) & (F.col(y) > 0) & (F.col(z) > 0)).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")).distinct()
    front = materialize(front_zero(points, ("x", "y", "z")))
    slabs = front.select(F.col("x").alias("s")).distinct()
    slabs = slabs.withColumn("dx", F.col("s") - F.coalesce(F.lag("s").over(W.orderBy("s")), F.lit(0.0)))
    reach = slabs.join(front, F.col("x") >= F.col("s")).groupBy("s", "dx", "y").agg(F.max("z").alias("z"))
    by = W.partitionBy("s").orderBy("y")
    strips = reach.withColumn("dy", F.col("y") - F.coalesce(F.lag("y").over(by), F.lit(0.0))).withColumn("top", F.max("z").over(by.rowsBetween(0, W.unboundedFollowing)))
    return strips.agg(F.coalesce(F.sum(F.col("dx") * F.col("dy") * F.col("top")), F.lit(0.0)).alias("hypervolume"))


def normalize_family(frames: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """The frames with the columns scaled to the least and the largest value over all of them; constant columns become 0."""
    every = frames[0].select(*columns)
    for f in frames[1:]:
        every = every.unionByName(f.select(*columns))
    ends = every.agg(*[f(c).alias(f"{c}__{k}") for c in columns for k, f in (("a", F.min), ("b", F.max))]).first()
    width = lambda c: d if (d := (ends[f"{c}__b"] or 0.0) - (ends[f"{c}__a"] or 0.0)) > 1e-12 else 1.0
    return [f.withColumns({c: (F.col(c) - F.lit(float(ends[f"{c}__a"] or 0.0))) / F.lit(float(width(c))) for c in columns}) for f in frames]


def igd(points: DataFrame, front: DataFrame, columns: Sequence[str]) -> float:
    """Mean distance of the reference front's points to the nearest of ``points``; infinite where either is empty."""
    from sievewright.operators import distance as J

    named = lambda df: df.select(*columns).distinct().withColumn("__id", F.monotonically_increasing_id())
    metric = J.Metric(tuple(columns), (), (0.0,) * len(columns), (1.0,) * len(columns), ())
    mean = J.nearest(materialize(named(front)), "__id", materialize(named(points)), "__id", metric).agg(F.avg("distance")).first()[0]
    return float("inf") if mean is None else mean
