"""Nearest neighbours between tables of mixed columns, and privacy scores from them.

Distances come from numbers, their scales and category codes, which Spark expressions make; no one-hot arrays are built.  An index of
at most ``WAVE_ROWS`` rows and ``WAVE_VALUES`` values goes to every task.  Beyond that, queries and index are both dealt into parts, every two parts meet in a
task of their own, and a query's best of all parts are merged by aggregation: no table passes through the driver, and a task's
memory doesn't depend on their sizes.

A task orders its index and its queries by halving along the widest column.  A group of near queries reads the index's leaves by
a lower bound of the distance to them, until the bound exceeds what each query has found: nothing is left out, and few leaves are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.plans.roles import Roles
from sievewright.plans.workspace import materialize

#: Rows of an index leaf, of a group of queries, of the queries ordered at a time, and the rows and values of an index or a part that one task holds.
LEAF, GROUP, HELD, WAVE_ROWS, WAVE_VALUES = 128, 64, 1 << 16, 1 << 20, 1 << 22
#: Tasks that queries are dealt to, and the rows below which a task isn't worth its start.
TASKS, LEAST = 24, 4096


@dataclass(frozen=True)
class Metric:
    """How columns count: centre and scale of numbers, and what a category mismatch adds."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    known: tuple[tuple[str, ...], ...]
    weight: float = 1.0
    norm: int = 2
    #: Decimal places that distances are rounded to before they are compared.
    digits: int | None = None


def fit_metric(df: DataFrame, roles: Roles, norm: int = 2, other: DataFrame | None = None, weight: float = 1.0, columns=None) -> Metric:
    """norm 2: numbers standardised (ddof 0; zero deviation divides by 1).  norm 1: divided by the range (1 if below 1e-12)."""
    use = set(columns or roles.columns)
    numeric = tuple(c for c in (*roles.numeric, *roles.discrete) if c in use)
    labels = tuple(c for c in roles.labels if c in use)
    shares = [f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in numeric for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}__known") for c in labels]
    # One pass, unless the categories of another table count too.
    own = [*shares, *(sets if other is None else [])]
    row = df.agg(*own).first() if own else {}
    if norm == 2:
        centre, scale = [row[f"{c}__mean"] or 0.0 for c in numeric], [(row[f"{c}__std"] or 0.0) or 1.0 for c in numeric]
    else:
        centre = [0.0 for _ in numeric]
        scale = [d if (d := (row[f"{c}__max"] or 0.0) - (row[f"{c}__min"] or 0.0)) >= 1e-12 else 1.0 for c in numeric]
    known = row if other is None or not labels else df.select(*labels).unionByName(other.select(*labels)).agg(*sets).first()
    return Metric(numeric, labels, tuple(map(float, centre)), tuple(map(float, scale)), tuple(tuple(known[f"{c}__known"]) for c in labels), weight, norm)


def coded(df: DataFrame, id_column: str, metric: Metric, group: str | None = None) -> DataFrame:
    """(i, x array<double>, c array<int>, g long): numbers, gaps the centre; places of the categories among the known ones, -1 for others; the group's hash.

    Numbers aren't scaled: only differences are, so that equal differences are equal distances.
    """
    numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m)) for c, m in zip(metric.numeric, metric.centre, strict=True)]
    codes = [F.coalesce(F.array_position(F.array(*[F.lit(v) for v in known]), F.col(c)).cast("int") - 1, F.lit(-1)) if known else F.lit(-1) for c, known in zip(metric.categorical, metric.known, strict=True)]
    return df.select(
        F.col(id_column).cast("long").alias("i"), (F.array(*numbers) if numbers else F.array().cast("array<double>")).alias("x"),
        (F.array(*codes) if codes else F.array().cast("array<int>")).alias("c"), (F.xxhash64(group) if group else F.lit(0).cast("long")).alias("g"),
    )


def _arrays(t: pa.RecordBatch | pa.Table, metric: Metric) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(ids, (numbers, codes), groups) of coded rows."""
    t = t.combine_chunks() if isinstance(t, pa.Table) else t
    one = lambda c: t[c].combine_chunks() if isinstance(t, pa.Table) else t[c]
    flat = lambda c, w: one(c).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, w)
    return one("i").to_numpy(zero_copy_only=False), (flat("x", len(metric.numeric)), flat("c", len(metric.categorical))), one("g").to_numpy(zero_copy_only=False)


def _total(metric: Metric, out: np.ndarray) -> np.ndarray:
    out = np.sqrt(out) if metric.norm == 2 else out
    return out if metric.digits is None else np.floor(out * 10.0**metric.digits + 0.5) / 10.0**metric.digits


def block_distances(metric: Metric, q: tuple[np.ndarray, np.ndarray], r: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distances of all queries to all references; a mismatch of known categories counts twice the weight, an unknown one once."""
    out = np.zeros((len(q[0]), len(r[0])))
    for i in range(q[0].shape[1]):
        d = (q[0][:, i, None] - r[0][None, :, i]) / metric.scale[i]
        out += d * d if metric.norm == 2 else np.abs(d)
    per = metric.weight**2 if metric.norm == 2 else metric.weight
    for i in range(q[1].shape[1]):
        a, b = q[1][:, i, None], r[1][None, :, i]
        out += np.where(a == b, 0.0, (a >= 0).astype(float) + (b >= 0)) * per
    return _total(metric, out)


FOUND = "query long, neighbour long, distance double, place int"


def _halved(x: np.ndarray, c: np.ndarray, metric: Metric, size: int) -> tuple[np.ndarray, list[int]]:
    """(order, starts of leaves and the end): rows halved along the widest column until at most ``size`` are together."""
    order, starts, todo = np.arange(len(x)), [], [(0, len(x))]
    width = 2 * metric.weight if metric.norm == 1 else np.sqrt(2) * metric.weight
    scale = np.array(metric.scale)
    while todo:
        low, high = todo.pop()
        if high - low <= size:
            starts += [low] if high > low else []
            continue
        own, at = order[low:high], (high - low) // 2
        spread = np.concatenate((np.ptp(x[own], axis=0) / scale, np.where(np.ptp(c[own], axis=0) > 0, width, 0.0)))
        widest = int(np.argmax(spread)) if len(spread) else -1
        if widest < 0 or spread[widest] <= 0:
            pass  # equal rows
        elif widest >= x.shape[1]:
            by = c[own, widest - x.shape[1]]
            place = np.argsort(by, kind="stable")
            by = by[place]
            at = int(np.searchsorted(by, by[at])) or int(np.searchsorted(by, by[at], "right"))
            order[low:high] = own[place]
        else:
            order[low:high] = own[np.argpartition(x[own, widest], at)]
        todo += [(low + at, high), (low, low + at)]
    return order, [*starts, len(x)]


def _boxes(x: np.ndarray, c: np.ndarray, starts: list[int]) -> tuple[np.ndarray, ...]:
    """Least and largest numbers and codes of each leaf."""
    at = starts[:-1]
    return tuple(f.reduceat(v, at, axis=0) for v in (x, c) for f in (np.minimum, np.maximum))


def _least(metric: Metric, boxes: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...]) -> np.ndarray:
    """A lower bound of ``block_distances`` from the group's box to each leaf's, by the same steps, so that rounding keeps it one."""
    low, high, few, most = boxes
    out = np.zeros(len(low))
    for i in range(low.shape[1]):
        d = np.maximum(np.maximum(low[:, i] - q[1][i], q[0][i] - high[:, i]), 0.0) / metric.scale[i]
        out += d * d if metric.norm == 2 else d
    per = metric.weight**2 if metric.norm == 2 else metric.weight
    for i in range(few.shape[1]):
        if q[2][i] == q[3][i]:
            apart = (few[:, i] == most[:, i]) & (few[:, i] != q[2][i])
            out += np.where(apart, (few[:, i] >= 0).astype(float) + (q[2][i] >= 0), 0.0) * per
    return _total(metric, out)


@dataclass
class Index:
    """Rows in leaves.  Of equal rows only the ``most`` smallest ids stay: no query returns more of them."""

    ids: np.ndarray
    rows: tuple[np.ndarray, np.ndarray]
    starts: list[int]
    boxes: tuple[np.ndarray, ...]


def _index(ids: np.ndarray, x: np.ndarray, c: np.ndarray, metric: Metric, most: int) -> Index:
    x = x + 0.0  # -0.0 equals 0.0
    at = np.lexsort((ids, *x.T, *c.T))
    at = at[np.isfinite(x[at]).all(axis=1)]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (x[at[1:]] != x[at[:-1]]).any(axis=1) | (c[at[1:]] != c[at[:-1]]).any(axis=1)
    run = np.flatnonzero(first)
    at = at[np.arange(len(at)) - run[np.cumsum(first) - 1] < most] if len(at) else at
    order, starts = _halved(x[at], c[at], metric, LEAF)
    at = at[order]
    return Index(ids[at], (x[at], c[at]), starts, _boxes(x[at], c[at], starts) if len(at) else ())


def _indexes(t: pa.Table, metric: Metric, most: int) -> dict[int, Index]:
    """An index for each group's hash."""
    ids, (x, c), g = _arrays(t, metric)
    at = np.argsort(g, kind="stable")
    cuts = np.flatnonzero(np.diff(g[at])) + 1
    return {int(g[own[0]]): _index(ids[own], x[own], c[own], metric, most) for own in np.split(at, cuts) if len(own)}


def _near(ids: np.ndarray, q: tuple[np.ndarray, np.ndarray], index: Index, metric: Metric, k: int, skip_self: bool) -> tuple[np.ndarray, ...]:
    """(query's place, neighbour, distance, place from 1) of one group of queries."""
    n, sizes = len(ids), np.diff(index.starts)
    row, dist, near, place = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = _least(metric, index.boxes, tuple(f(v, axis=0) for v in q for f in (np.min, np.max)))
    order = np.argsort(least, kind="stable")
    least, bound, at, wave = least[order], np.full(n, np.inf), 0, int(np.searchsorted(np.cumsum(sizes[order]), k + skip_self)) + 1
    while at < len(order) and least[at] <= (worst := bound.max()):
        some = order[at : min(at + wave, int(np.searchsorted(least, worst, "right")))]
        at, wave = at + len(some), 2 * wave
        cols = np.concatenate([np.arange(index.starts[j], index.starts[j + 1]) for j in some])
        d = block_distances(metric, q, (index.rows[0][cols], index.rows[1][cols]))
        rid = index.ids[cols]
        if skip_self:
            d[ids[:, None] == rid[None, :]] = np.inf
        # Only what is within a query's k-th distance can stay.
        within = bound
        if d.shape[1] > k:
            within = np.minimum(bound, d.min(axis=1) if k == 1 else np.partition(d, k - 1, axis=1)[:, k - 1])
        r, j = np.nonzero((d <= within[:, None]) & np.isfinite(d))
        row, dist, near = np.concatenate((row, r)), np.concatenate((dist, d[r, j])), np.concatenate((near, rid[j]))
        by = np.lexsort((near, dist, row))
        row, dist, near = row[by], dist[by], near[by]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
        row, dist, near, place = (v[place < k] for v in (row, dist, near, place))
        last = place == k - 1
        bound[row[last]] = dist[last]
    return row, near, dist, place + 1


def _search(t: pa.Table, indexes: dict[int, Index], metric: Metric, k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of the query's own index for each query; ties go to the smaller id."""
    ids, (x, c), g = _arrays(t, metric)
    at = np.argsort(g, kind="stable")
    at = at[np.isfinite(x[at]).all(axis=1)]
    for own in np.split(at, np.flatnonzero(np.diff(g[at])) + 1):
        index = indexes.get(int(g[own[0]])) if len(own) else None
        if index is None or not len(index.ids):
            continue
        order, starts = _halved(x[own], c[own], metric, GROUP)
        own, found = own[order], []
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            q = own[low:high]
            row, *rest = _near(ids[q], (x[q], c[q]), index, metric, k, skip_self)
            found.append((ids[q][row], *rest))
            if high == len(own) or sum(len(f[0]) for f in found[-256:]) > HELD:
                i, j, d, p = (np.concatenate(v) for v in zip(*found, strict=True))
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d), pa.array(p.astype(np.int32))], names=["query", "neighbour", "distance", "place"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at least ``HELD`` rows, but for the last."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= HELD:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def counts(*tables: DataFrame) -> list[int]:
    """The rows of each table, counted by one job."""
    own = [t.agg(F.count("*").alias("n")).withColumn("at", F.lit(at)) for at, t in enumerate(tables)]
    return [r.n for r in sorted(reduce(DataFrame.unionByName, own).collect(), key=lambda r: r.at)]


def nearest(queries: DataFrame, query_id: str, index: DataFrame, index_id: str, metric: Metric, k: int = 1, skip_self: bool = False, group: str | None = None, sizes: tuple[int, int] | None = None, ranges: bool = False) -> DataFrame:
    """(query id, neighbour, distance, place): the k nearest index rows of each query, ties by the smaller id.

    ``skip_self`` leaves out the row with the query's own id.  ``group``: only rows with an equal value.  ``sizes``: the rows of
    queries and index, or more, where they are known.  ``ranges``: queries are dealt by their categories and numbers, not at random.
    """
    (asks, n), most = sizes or counts(queries, index), k + skip_self
    asked, known = coded(queries, query_id, metric, group), coded(index, index_id, metric, group)
    wave = max(1, min(WAVE_ROWS, WAVE_VALUES // (2 + len(metric.numeric) + len(metric.categorical))))

    if n <= wave:
        shared = queries.sparkSession.sparkContext.broadcast(_indexes(known.toArrow(), metric, most))  # at most ``wave`` rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _held(batches):
                yield from _search(t, shared.value, metric, k, skip_self)

        tasks = min(max(TASKS, -(-asks // wave)), -(-asks // LEAST))
        if asks > LEAST:
            asked = asked.repartitionByRange(tasks, "g", "c", "x", "i") if ranges else asked.repartition(tasks)
        return asked.mapInArrow(run, FOUND).withColumnRenamed("query", query_id)

    cols = -(-n // wave)
    rows = max(1, -(-asks // wave), min(-(-asks // LEAST), -(-TASKS // cols)))
    part = lambda m: F.pmod(F.xxhash64("i", F.lit(17)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("row", part(rows)).withColumn("col", every(cols))
    right = known.withColumn("col", part(cols)).withColumn("row", every(rows))
    shape = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64()), ("place", pa.int32())])

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_search(q, _indexes(r, metric, most), metric, k, skip_self) if q.num_rows else [], shape)

    some = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(meet, FOUND)
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    return some.groupBy(F.col("query").alias(query_id)).agg(best.alias("best")).select(query_id, F.posexplode("best").alias("at", "b")).select(
        query_id, "b.neighbour", "b.distance", (F.col("at") + 1).alias("place")
    )


def dcr_signal(queries: DataFrame, query_id: str, real: DataFrame, test: DataFrame, metric: Metric, real_id: str, test_id: str) -> DataFrame:
    """(id, d_real, d_test, is_real_closer, margin): strictly closer to the real table, and d_test - d_real."""
    asks, *n = counts(queries, real, test)
    wave = max(1, min(WAVE_ROWS, WAVE_VALUES // (2 + len(metric.numeric) + len(metric.categorical))))
    if sum(n) > wave:
        a = nearest(queries, query_id, real, real_id, metric, sizes=(asks, n[0])).select(query_id, F.col("distance").alias("d_real"))
        b = nearest(queries, query_id, test, test_id, metric, sizes=(asks, n[1])).select(query_id, F.col("distance").alias("d_test"))
        out = a.join(b, query_id)
    else:
        # Both indexes fit a task, so that one pass over the queries finds both distances.
        both = queries.sparkSession.sparkContext.broadcast([_indexes(coded(t, c, metric).toArrow(), metric, 1) for t, c in ((real, real_id), (test, test_id))])

        def first(t: pa.Table, indexes: dict[int, Index]) -> tuple[np.ndarray, np.ndarray]:
            found = list(_search(t, indexes, metric, 1, False))
            column = lambda c, kind: np.concatenate([np.zeros(0, kind), *(b[c].to_numpy() for b in found)])
            return column("query", np.int64), column("distance", np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _held(batches):
                (i, d), (j, e) = (first(t, indexes) for indexes in both.value)
                _, p, q = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i[p], d[p], e[q])], names=[query_id, "d_real", "d_test"])

        # Near queries meet in a task, so that a group of them reads few leaves.
        asked = coded(queries, query_id, metric)
        asked = asked.repartitionByRange(min(max(TASKS, -(-asks // wave)), -(-asks // LEAST)), "c", "x", "i") if asks > LEAST else asked
        out = asked.mapInArrow(run, f"`{query_id}` long, d_real double, d_test double")
    return out.withColumn("is_real_closer", F.col("d_real") < F.col("d_test")).withColumn("margin", F.col("d_test") - F.col("d_real"))


def density_reference(sample: DataFrame, id_column: str, metric: Metric, strata: int = 5, k: int = 10) -> tuple[list[float], list[float], DataFrame]:
    """(density edges, expected nearest distance by stratum, sample densities) of a bounded sample: 1 / mean distance of the k nearest others."""
    from sievewright.functions.scalars import bucket_numeric
    from sievewright.operators.ranks import exact_quantiles

    near = nearest(sample, id_column, sample, id_column, metric, k, skip_self=True)
    # Read by the quantiles, the means and the result: written once.
    own = materialize(near.groupBy(id_column).agg((1 / F.greatest(F.avg("distance"), F.lit(1e-12))).alias("density"), F.min("distance").alias("first")))
    edges = sorted({round(v, 9) for v in exact_quantiles(own, ["density"], [i / strata for i in range(strata + 1)])["density"]})

    coded = own.withColumn("stratum", bucket_numeric(F.col("density"), edges))
    means = {r.stratum: r.e for r in coded.groupBy("stratum").agg(F.avg("first").alias("e")).collect()}
    return edges, [means.get(i, 0.0) for i in range(max(1, len(edges) - 1))], coded


def privacy_components(distances: DataFrame, rarity: str = "p_geomean", gamma: float = 1.0) -> DataFrame:
    """Adds v1 = ln(1 + d), v2 = max(0, d / expected - g), v3 = max(0, d * (1 - p) - g), g = gamma * max(0, d_hold - d), gap.

    Needs nn_distance_train, nn_distance_holdout, expected and the probability ``rarity``.
    """
    d, h = F.col("nn_distance_train"), F.col("nn_distance_holdout")
    g = F.lit(gamma) * F.greatest(F.lit(0.0), h - d)
    density = d / F.greatest(F.col("expected"), F.lit(1e-12))
    return (
        distances.withColumn("privacy_v1", F.log1p(d)).withColumn("density_normalized", density)
        .withColumn("privacy_v2", F.greatest(F.lit(0.0), density - g)).withColumn("privacy_v3", F.greatest(F.lit(0.0), d * (1 - F.col(rarity)) - g)).withColumn("holdout_gap", h - d)
    )
