"""Ranks and quantiles of whole tables without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.plans.workspace import materialize


def _sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range partitions, sorted and written once; ``__part`` numbers them and ``__at`` orders their rows."""
    out = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    return out.withColumn("__part", F.shiftright("__at", 33))


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Adds the row's place, from 1, in a total order of all rows.

    A row's place is its place in its range partition plus the counts of the partitions before, a table with one row a
    partition.  Heavy ties split as the order goes on to an id.
    """
    rows = _sorted(df, order)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return (
        rows.join(F.broadcast(before), "__part")  # one row a partition
        .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
        .drop("__at", "__part", "__before")
    )


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[Column], values: dict[str, str]) -> DataFrame:
    """Adds running sums {name: column} along a total order within each group, the row itself included.

    Windows run within range partitions of (group, order); what lies before a partition in its group comes from a table
    with a row for each partition and group, so one large group is summed by many tasks.
    """
    rows = _sorted(df, [*[F.col(g).asc() for g in groups], *order])
    own = W.partitionBy("__part", *groups).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("__part", *groups).agg(*[F.sum(c).alias(f"__{n}") for n, c in values.items()])
    upto = (W.partitionBy(*groups) if groups else W).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in groups], *[F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(f"__b_{n}") for n in values])
    cond = F.col("__part") == F.col("__p")
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    summed = rows.withColumns({n: F.sum(c).over(own) for n, c in values.items()})
    out = summed.join(before, cond).withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in values})
    return out.drop("__at", "__part", "__p", *[f"__g_{g}" for g in groups], *[f"__b_{n}" for n in values])


def rank_scale(df: DataFrame, column: str, id_column: str, name: str) -> DataFrame:
    """0 to 1 by ascending value, ties by id; a single row gets 1."""
    n = df.count()
    out = global_row_number(df, [F.col(column).asc(), F.col(id_column).asc()], "__rn")
    value = F.lit(1.0) if n <= 1 else (F.col("__rn") - 1) / F.lit(float(n - 1))
    return out.withColumn(name, value.cast("double")).drop("__rn")


def _search(value: Column, points: Sequence[float], low: int, high: int) -> Column:
    """Number of the points at or below the value."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value >= F.lit(float(points[mid])), _search(value, points, mid + 1, high)).otherwise(_search(value, points, low, mid))


def sketch(columns: Sequence[str], splits: int = 64) -> list[Column]:
    """Aggregates that give split points of each column, for ``exact_quantiles``; they may share a pass with others."""
    grid = [i / splits for i in range(1, splits)]
    return [F.percentile_approx(c, grid, 1000).alias(f"{c}__points") for c in columns]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], splits: int = 64, points: dict | None = None) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of the non-null values of each column, exact at any size.

    Sketched split points (bounded) cut the values into buckets; bucket counts say which
    buckets hold the wanted ranks, and only the distinct values of those are ordered.
    """
    if points is None:
        points = df.agg(*sketch(columns, splits)).first().asDict()
    points = {c: sorted(set(points[f"{c}__points"] or [])) for c in columns}
    long = None
    for c in columns:
        value = F.col(c).cast("double")
        # A binary search, as a tree of comparisons over the sorted split points.
        bucket = _search(value, points[c], 0, len(points[c]))
        part = df.where(value.isNotNull()).select(F.lit(c).alias("c"), bucket.alias("b"), value.alias("v"))
        long = part if long is None else long.unionAll(part)
    counts = {(r.c, r.b): r.n for r in long.groupBy("c", "b").agg(F.count("*").alias("n")).collect()}
    wanted: dict[str, set[int]] = {}
    picks: dict[tuple[str, int], list[int]] = {}
    for c in columns:
        n = sum(v for (k, _), v in counts.items() if k == c)
        wanted[c] = {i for p in probs for x in [p * (n - 1)] for i in (int(x), min(int(x) + 1, n - 1))} if n else set()
        at = 0
        for b in sorted(b for k, b in counts if k == c):
            mine = [i - at for i in sorted(wanted[c]) if at <= i < at + counts[c, b]]
            if mine:
                picks[c, b] = mine
            at += counts[c, b]
    out: dict[str, list[float]] = {c: [] for c in columns}
    if not picks:
        return out
    keep = F.create_map(*[x for c, b in picks for x in (F.lit(f"{c}|{b}"), F.lit(True))])
    few = long.where(keep[F.concat_ws("|", "c", "b")]).groupBy("c", "b", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("c", "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranks = F.create_map(*[x for (c, b), m in picks.items() for x in (F.lit(f"{c}|{b}"), F.array(*[F.lit(i) for i in m]))])
    hits = few.withColumn("upto", upto).withColumn("i", F.explode(ranks[F.concat_ws("|", "c", "b")])).where("i < upto and i >= upto - n")
    found = {(r.c, r.b, r.i): r.v for r in hits.select("c", "b", "i", "v").collect()}
    for c in columns:
        place, at = {}, 0
        for b in sorted(b for k, b in counts if k == c):
            place |= {at + i: found[c, b, i] for i in picks.get((c, b), [])}
            at += counts[c, b]
        for p in probs if at else []:
            x = p * (at - 1)
            low, high = place[int(x)], place[min(int(x) + 1, at - 1)]
            out[c].append(low + (high - low) * (x - int(x)))
    return out
