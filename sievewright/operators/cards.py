"""Profile cards of a real table: types, legal values, statistics, bins, frequencies, prototypes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators.ranks import exact_quantiles, sketch
from sievewright.plans.roles import Roles

STAT_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: The most legal values that a card holds on the driver; beyond it a column must be compressed first.
MOST_LEGAL = 10_000


@dataclass
class Cards:
    """What expressions over other tables need to know of the real one."""

    roles: Roles
    bins: dict[str, list[float]] = field(default_factory=dict)
    legal: dict[str, list] = field(default_factory=dict)
    stats: dict[str, dict] = field(default_factory=dict)
    missing_allowed: dict[str, bool] = field(default_factory=dict)
    most_frequent: dict[str, str] = field(default_factory=dict)

    def size(self, column: str) -> int:
        """Number of buckets."""
        return max(1, len(self.bins[column]) - 1) if column in self.roles.numeric else len(self.legal[column])


def infer_roles(df: DataFrame, numeric=(), discrete=(), categorical=(), target: str | None = None) -> Roles:
    """Explicit lists win, discrete before categorical before numeric; other columns go by their type."""
    out: dict[str, list[str]] = {"n": [], "d": [], "c": []}
    for name, kind in df.dtypes:
        if name in discrete:
            out["d"].append(name)
        elif name in categorical:
            out["c"].append(name)
        elif name in numeric or kind in ("double", "float") or kind.startswith("decimal"):
            out["n"].append(name)
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            out["d"].append(name)
        else:
            out["c"].append(name)
    return Roles(tuple(out["n"]), tuple(out["d"]), tuple(out["c"]), target)


def long_values(df: DataFrame, columns) -> DataFrame:
    """(column, value as text) of all rows, one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.column", "x.value")


def schema_card(df: DataFrame, roles: Roles) -> DataFrame:
    """(column, kind, is_target, missing_allowed, n_legal, legal_values)."""
    counts = long_values(df, roles.columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    kinds = F.create_map(*[x for c in roles.columns for x in (F.lit(c), F.lit(roles.kind(c)))])
    listed = F.when(kinds[F.col("column")] != "numerical", F.col("value"))
    by_number = F.transform(F.array_sort(F.transform(F.collect_set(listed), lambda v: F.struct(F.coalesce(v.try_cast("double"), F.lit(0.0)).alias("k"), v.alias("v")))), lambda s: s["v"])
    values = F.when(kinds[F.col("column")] == "discrete_numerical", by_number).otherwise(F.array_sort(F.collect_set(listed)))
    return counts.groupBy("column").agg(F.max(F.col("value").isNull().cast("int")).alias("gap"), values.alias("values")).select(
        "column", kinds[F.col("column")].alias("kind"), (F.col("column") == F.lit(roles.target)).alias("is_target"), (F.col("gap") == 1).alias("missing_allowed"),
        F.size("values").cast("long").alias("n_legal"), F.array_join("values", "|").alias("legal_values"),
    )


def _moments(columns) -> list:
    return [f(c).alias(f"{c}__{k}") for c in columns for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]


def _stat_rows(row, columns, quantiles: dict) -> list[tuple]:
    return [(c, *(float(row[f"{c}__{k}"]) if row[f"{c}__{k}"] is not None else None for k in ("min", "max", "mean", "std")), *(quantiles[c] or [None] * len(STAT_PROBS))) for c in columns]


def _edges(values: list[float]) -> list[float]:
    edges = sorted({round(v, 6) for v in values})
    return edges if len(edges) != 1 else [edges[0] - 0.5, edges[0] + 0.5]


def numeric_stats(df: DataFrame, columns) -> DataFrame:
    """(column, min, max, mean, std with ddof 0, p05, p25, p50, p75, p95)."""
    row = df.agg(*_moments(columns), *sketch(columns)).first()
    rows = _stat_rows(row, columns, exact_quantiles(df, columns, STAT_PROBS, points=row.asDict()))
    return df.sparkSession.createDataFrame(rows, "column string, min double, max double, mean double, std double, p05 double, p25 double, p50 double, p75 double, p95 double")


def quantile_bins(df: DataFrame, columns, n_bins: int = 8) -> dict[str, list[float]]:
    """Distinct quantile edges; a constant column gets its value -+ 0.5."""
    return {c: _edges(v) for c, v in exact_quantiles(df, columns, [i / n_bins for i in range(n_bins + 1)]).items()}


def frequencies(df: DataFrame, columns) -> DataFrame:
    """(column, value, count, freq, place): place by descending count, then value."""
    counts = long_values(df, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    return counts.withColumn("freq", F.col("count") / F.sum("count").over(W.partitionBy("column"))).withColumn(
        "place", F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))
    )


def prototypes(df: DataFrame, target: str, id_column: str, size: int = 32) -> DataFrame:
    """Target-stratified rows in the order of their ids: each label's rounded share, at least one; ``size`` at most."""
    labels = df.groupBy(target).agg(F.count("*").alias("n")).limit(max(8, size // 2) + 1).collect()
    if len(labels) > max(8, size // 2):
        return df.orderBy(id_column).limit(size)
    total = sum(r.n for r in labels)
    rn = F.row_number().over(W.partitionBy(target).orderBy(id_column))
    caps = F.create_map(*[x for r in labels for x in (F.coalesce(F.lit(r[target]).cast("string"), F.lit("")), F.lit(max(1, round(size * r.n / total))))])
    own = F.coalesce(F.col(target).cast("string"), F.lit(""))
    # The literal limit lets each task cut a label's rows before the shuffle.
    return df.withColumn("__rn", rn).where(F.col("__rn") <= size).where(F.col("__rn") <= caps[own]).orderBy("__rn", target).limit(size).drop("__rn")


def medians(df: DataFrame, columns) -> dict[str, float]:
    """Over finite values; 0 where there are none."""
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")).alias(c) for c in columns])
    return {c: (v or [0.0])[0] for c, v in exact_quantiles(clean, columns, [0.5]).items()}


def robust_limits(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> tuple[float, float]:
    """The two quantiles, or minimum and maximum if they coincide."""
    a, b = exact_quantiles(df, [column], [low, high])[column] or (0.0, 0.0)
    if b - a <= 1e-12:
        r = df.agg(F.min(column), F.max(column)).first()
        return float(r[0] or 0.0), float(r[1] or 0.0)
    return a, b


def fit(df: DataFrame, roles: Roles, n_bins: int = 8) -> Cards:
    """All that the other operators read: one pass for moments, gaps and split points, two for the quantiles, one for frequencies."""
    cards = Cards(roles)
    numeric, others = list(roles.numeric), (*roles.discrete, *roles.labels)
    row = df.agg(*_moments(numeric), *sketch(numeric), *[F.max(F.col(c).isNull()).alias(f"{c}__gap") for c in roles.columns]).first()
    cards.missing_allowed = {c: bool(row[f"{c}__gap"]) for c in roles.columns}
    if numeric:
        grid = [i / n_bins for i in range(n_bins + 1)]
        found = exact_quantiles(df, numeric, [*STAT_PROBS, *grid], points=row.asDict())
        names = ("min", "max", "mean", "std", "p05", "p25", "p50", "p75", "p95")
        rows = _stat_rows(row, numeric, {c: v[: len(STAT_PROBS)] for c, v in found.items()})
        cards.stats = {c: {"column": c, **dict(zip(names, values, strict=True))} for c, *values in rows}
        cards.bins = {c: _edges(v[len(STAT_PROBS) :]) for c, v in found.items()}
    if others:
        counts = frequencies(df, others).where(F.col("place") <= MOST_LEGAL + 1).collect()
        for c in others:
            own = [r for r in counts if r["column"] == c]
            if len(own) > MOST_LEGAL:
                raise ValueError(f"{c} has over {MOST_LEGAL} values: compress it first")
            cards.legal[c] = sorted(float(r.value) for r in own) if c in roles.discrete else sorted(r.value for r in own)
            cards.most_frequent[c] = min(own, key=lambda r: r.place).value if own else ""
    return cards


def quantile_digest(df: DataFrame, groups, value: str) -> DataFrame:
    """min, q05, q25, q50, q75, q95, max and mean of the finite values of each group."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    q = F.percentile(v, F.array(*[F.lit(p) for p in STAT_PROBS]))
    digest = df.groupBy(*groups).agg(F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    return digest.select(*groups, "min", *[F.col("q")[i].alias(f"q{int(p * 100):02d}") for i, p in enumerate(STAT_PROBS)], "max", "mean")


def mean_std(df: DataFrame, groups, metrics) -> DataFrame:
    """Mean and deviation (ddof 0) of the metrics' non-null values in each group."""
    return df.groupBy(*groups).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def worst_groups(df: DataFrame, key: str, score: str, limit: int = 5) -> DataFrame:
    """The groups with the lowest means: (key, mean, std, count)."""
    own = df.where(F.col(score).isNotNull()).groupBy(key).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("count"))
    return own.orderBy("mean", F.desc("count"), key).limit(limit)


def importance_summary(df: DataFrame, limit: int = 10) -> DataFrame:
    """(feature, mean, std, mean_rank) over reports with (report, feature, importance)."""
    rank = F.row_number().over(W.partitionBy("report").orderBy(F.desc("importance"), "feature"))
    own = df.withColumn("rank", rank).groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.avg("rank").alias("mean_rank"))
    return own.orderBy(F.desc("mean"), "feature").limit(limit)


def source_contribution(pool: DataFrame, selected_ids: DataFrame, id_column: str, source: str) -> DataFrame:
    """(source, pool_count, selected_count, pool_share, selected_share, gain)."""
    marks = selected_ids.select(F.col(id_column).alias("__s")).distinct()
    own = pool.join(marks, F.col(id_column) == F.col("__s"), "left").groupBy(source).agg(F.count("*").alias("pool_count"), F.count("__s").alias("selected_count"))
    total = W.partitionBy()
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(total), F.lit(0)), F.lit(0.0))
    return own.withColumn("pool_share", share("pool_count")).withColumn("selected_share", share("selected_count")).withColumn("gain", F.col("selected_share") - F.col("pool_share"))


def report_table(df: DataFrame, metric: str) -> DataFrame:
    """(dataset, mean, std with ddof 1) rounded to 3, and a row All over the rounded means."""
    own = df.groupBy("dataset").agg(F.round(F.avg(metric), 3).alias("mean"), F.round(F.stddev_samp(metric), 3).alias("std"))
    every = own.agg(F.round(F.avg("mean"), 3).alias("mean"), F.round(F.stddev_samp("mean"), 3).alias("std")).select(F.lit("All").alias("dataset"), "mean", "std")
    return own.unionByName(every)
