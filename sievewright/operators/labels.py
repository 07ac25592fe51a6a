"""Group labels of targets and balance columns, theta buckets, encoded matrices, rollups over reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators.cards import Cards, long_values
from sievewright.operators.distance import Metric
from sievewright.operators.ranks import exact_quantiles
from sievewright.plans.roles import Roles


def distinct_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    return sorted({round(v, 6) for v in exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]})


def sqrt_bins(n: int) -> int:
    """Two to ten bins, the rounded root of the row count between."""
    return min(10, max(2, round(math.sqrt(n))))


def regression_group(reference: DataFrame, column: str) -> Column:
    """``reg_bin_<i>`` by the reference's quantiles; missing values go with its median."""
    n = reference.where(F.col(column).isNotNull()).count()
    edges = distinct_edges(reference, column, sqrt_bins(n)) if n else []
    if len(edges) <= 2:
        return F.lit("reg_bin_0")
    middle = exact_quantiles(reference, [column], [0.5])[column][0]
    x = F.coalesce(S.finite(F.col(column)), F.lit(middle))
    return F.concat(F.lit("reg_bin_"), S.bucket_numeric(x, edges).cast("string"))


def target_group(df: DataFrame, column: str | None, numeric: bool, bins: int = 12) -> Column:
    """Exact labels, or ``target_bin_<i>`` for a numeric target with more than ``bins`` values; ``__target_missing__`` for gaps."""
    if column is None:
        return F.lit("__all__")
    x = S.finite(F.col(column))
    text = F.coalesce(F.col(column).cast("string"), F.lit("__target_missing__"))
    if not numeric or df.select(column).where(F.col(column).isNotNull()).distinct().limit(bins + 1).count() <= bins:
        return text
    edges = distinct_edges(df.select(x.alias(column)), column, bins)
    if len(edges) < 2:
        return text
    return F.when(x.isNull(), F.lit("__target_missing__")).otherwise(F.concat(F.lit("target_bin_"), S.bucket_numeric(x, edges).cast("string")))


def balance_bucket(cards: Cards, column: str, medians: dict[str, float]) -> Column:
    """``bin_<i>`` or ``value_<i>`` of a number, gaps at the training median; the text of a category, gaps ``__MISSING__``."""
    if column in cards.roles.labels:
        return F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__"))
    x = F.coalesce(F.col(column).cast("double"), F.lit(float(medians.get(column, 0.0))))
    if column in cards.roles.discrete:
        return F.concat(F.lit("value_"), S.nearest_legal(x, cards.legal[column]).cast("string"))
    return F.concat(F.lit("bin_"), S.bucket_numeric(x, cards.bins[column]).cast("string"))


def encode_target(df: DataFrame, column: str) -> tuple[Column, list[str]]:
    """(index of the label among the sorted labels, the labels)."""
    labels = sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(10_001).collect())
    if len(labels) > 10_000:
        raise ValueError(f"{column} has over 10000 labels")
    return S.bucket_category(F.col(column).cast("string"), labels), labels


def theta_codes(train: DataFrame, roles: Roles, columns: Sequence[str], keep=()) -> DataFrame:
    """Codes for theta's pair ranking: numbers by right-closed quantile cuts, discrete ones by legal value, texts by sorted order."""
    n, out = train.count(), []
    for c in columns:
        if c in roles.numeric:
            edges = distinct_edges(train, c, sqrt_bins(max(n, 1)))
            out.append((F.coalesce(S.bucket_right_closed(F.col(c), edges), F.lit(-1)) if len(edges) > 1 else F.lit(0)).alias(c))
        elif c in roles.discrete:
            legal = sorted(float(r[0]) for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect())
            out.append(S.nearest_legal(F.coalesce(F.col(c).cast("double"), F.lit(legal[(len(legal) - 1) // 2] if legal else 0.0)), legal).alias(c))
        else:
            filled = train.select(F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias(c))
            _, labels = encode_target(filled, c)
            out.append(S.bucket_category(F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")), labels).alias(c))
    return train.select(*keep, *out)


def theta_pairs(codes: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """(left, right, mi): pairs by descending normalised mutual information, then names."""
    pairs = list(combinations(sorted(set(columns)), 2))
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")) for a, b in pairs])
    own = codes.select(F.explode(cells).alias("x")).where("x.a >= 0 and x.b >= 0").groupBy("x.left", "x.right", "x.a", "x.b").agg(F.count("*").alias("n"))
    own = own.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("left", "right")))
    own = own.withColumn("pa", F.sum("p").over(W.partitionBy("left", "right", "a"))).withColumn("pb", F.sum("p").over(W.partitionBy("left", "right", "b")))
    sums = own.groupBy("left", "right").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("i"), (-F.sum(F.col("p") * F.ln("pa"))).alias("ha"), (-F.sum(F.col("p") * F.ln("pb"))).alias("hb"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"))
    mi = F.when((F.col("na") <= 1) | (F.col("nb") <= 1), F.lit(0.0)).otherwise(F.col("i") / F.sqrt(F.greatest("ha", F.lit(1e-12)) * F.greatest("hb", F.lit(1e-12))))
    return sums.select("left", "right", mi.alias("mi")).orderBy(F.desc("mi"), "left", "right").limit(most)


def encoded_matrix(df: DataFrame, metric: Metric, id_column: str) -> DataFrame:
    """(id, features array<double>): scaled numbers (gaps 0), then one-hot categories times the weight; unknown ones are all 0."""
    numbers = [F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(metric.numeric, metric.centre, metric.scale, strict=True)]
    hot = [F.when(F.col(c) == F.lit(v), F.lit(metric.weight)).otherwise(0.0) for c, known in zip(metric.categorical, metric.known, strict=True) for v in known]
    return df.select(id_column, F.array(*numbers, *hot).alias("features"))


def row_key(columns: Sequence[str]) -> Column:
    """A text that is equal for equal rows: gaps are ``__MISSING__``."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in columns])


def common_columns(frames: Sequence[DataFrame], requested: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Columns of all frames in the first one's order, or the requested ones; ValueError if one is lacking or none is left."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    lacking = [c for c in requested if c not in common]
    out = [c for c in (requested or common) if c not in exclude]
    if lacking or not out:
        raise ValueError(f"columns lacking: {lacking}" if lacking else "no columns are left")
    return out


def filter_scope(columns: Sequence[str], target: str | None, features: Sequence[str]) -> list[str]:
    """Stripped, distinct, known feature columns without the target; all features if none is left."""
    own = [c for c in dict.fromkeys(x.strip() for x in columns) if c in features and c != target]
    return own or [c for c in features if c != target]


def complete_target_only(synthetic_target: DataFrame, real: DataFrame, target: str, synthetic_order, real_order) -> DataFrame:
    """The real rows with the synthetic column as their target, row by row of the two orders; gaps where the column is shorter."""
    from sievewright.operators.ranks import global_row_number

    a = global_row_number(real.drop(target), real_order, "__rn")
    b = global_row_number(synthetic_target, synthetic_order, "__rn").select("__rn", target)
    return a.join(b, "__rn", "left").drop("__rn")


def union_one_hot(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are 0."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(0)


def reuse_all_or_none(rows: DataFrame, scores: DataFrame, id_column: str) -> DataFrame | None:
    """The scores of exactly these rows, or None if one lacks a score."""
    kept = scores.join(rows.select(id_column), id_column, "left_semi")
    return kept if kept.select(id_column).distinct().count() == rows.select(id_column).distinct().count() else None


def dcr_rollup(reports: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Means over reports of real_closer_rate, its distance from a half, and the privacy reward."""
    error = F.abs(F.col("real_closer_rate") - 0.5)
    return reports.groupBy(*groups).agg(F.avg("real_closer_rate").alias("real_closer_rate"), F.avg(error).alias("balance_error_abs"), F.avg(1 - error).alias("dcr_privacy_reward"))


def source_fraction_summary(reports: DataFrame) -> DataFrame:
    """(source_id, mean, variance with ddof 0) of the selected fractions."""
    return reports.groupBy("source_id").agg(F.avg("fraction").alias("selected_fraction_mean"), F.var_pop("fraction").alias("selected_fraction_var"))


def value_overlap(frames: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(column, value, one flag a frame)."""
    out = None
    for name, df in frames.items():
        own = long_values(df, columns).where("value is not null").distinct().withColumn(name, F.lit(True))
        out = own if out is None else out.join(own, ["column", "value"], "full")
    return out.fillna(False, subset=list(frames))


def filled(df: DataFrame, roles: Roles, medians: dict[str, float]) -> DataFrame:
    """Numbers with gaps at the medians, categories with gaps as ``__MISSING__``."""
    numbers = {c: F.coalesce(S.finite(F.col(c)), F.lit(float(medians[c]))) for c in (*roles.numeric, *roles.discrete)}
    return df.withColumns(numbers | {c: F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in roles.labels})


def audit_encoder(frames: Sequence[DataFrame], roles: Roles) -> tuple[dict[str, float], Metric]:
    """(medians, metric) of the audit's encoding: medians, deviations (ddof 0) and categories of all frames together."""
    from sievewright.operators.distance import fit_metric

    columns = [*roles.numeric, *roles.discrete, *roles.labels]
    every = frames[0].select(*columns)
    for f in frames[1:]:
        every = every.unionByName(f.select(*columns))
    numbers = [*roles.numeric, *roles.discrete]
    fine = every.select(*[S.finite(F.col(c)).alias(c) for c in numbers])
    found = exact_quantiles(fine, numbers, [0.5]) if numbers else {}
    medians = {c: (found[c] or [0.0])[0] for c in numbers}
    return medians, fit_metric(filled(every, roles, medians), roles)


def weak_feedback(shapes: DataFrame, trends: DataFrame, reports: DataFrame, limit: int = 2) -> DataFrame:
    """(part, name, value, n): the columns and the pairs with the lowest mean scores, and digests of DCR, its privacy score and its distance from a half.

    ``shapes``: (column, score).  ``trends``: (left, right, score).  ``reports``: (dcr, dcr_privacy).
    """
    def worst(df: DataFrame, part: str, name: Column) -> DataFrame:
        means = df.where(name.isNotNull() & F.col("score").isNotNull()).groupBy(name.alias("name")).agg(F.avg("score").alias("value"), F.count("*").alias("n"))
        return means.orderBy("value", "name").limit(limit).select(F.lit(part).alias("part"), "name", "value", "n")

    out = worst(shapes, "shape", F.col("column")).unionByName(worst(trends, "trend", F.concat_ws("|", "left", "right")))
    own = reports.select("dcr", "dcr_privacy", F.abs(F.col("dcr") - 0.5).alias("balance_error"))
    stats = {"min": F.min, "mean": F.avg, "max": F.max}
    row = own.agg(*[f(c).alias(f"{c}__{k}") for c in own.columns for k, f in stats.items()], *[F.count(c).alias(f"{c}__n") for c in own.columns]).first()
    middle = exact_quantiles(own, own.columns, [0.05, 0.5, 0.95])
    rows = [(c, k, float(row[f"{c}__{k}"]), row[f"{c}__n"]) for c in own.columns if row[f"{c}__n"] for k in stats]
    rows += [(c, k, float(v), row[f"{c}__n"]) for c in own.columns if middle[c] for k, v in zip(("q05", "q50", "q95"), middle[c], strict=True)]
    return out.unionByName(reports.sparkSession.createDataFrame(rows, "part string, name string, value double, n long"))
