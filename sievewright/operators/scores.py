"""Surrogate and exact scores of candidates, grouped ranks, utility combinations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators import fidelity as D
from sievewright.operators.ranks import exact_quantiles, rank_scale
from sievewright.plans.workspace import materialize


def grouped_rank(df: DataFrame, value: str, groups, name: str) -> DataFrame:
    """(average rank - 1) / max(n - 1, 1) within the group; a single row gets 1, a value that isn't finite 0.

    Ranks come from the counts of distinct values, so a hot group costs its distinct values, not its rows.
    """
    v = F.col(value).cast("double")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    counts = df.where(fine).groupBy(*groups, v.alias("__v")).agg(F.count("*").alias("__n"))
    by = W.partitionBy(*groups).orderBy("__v")
    before = F.coalesce(F.sum("__n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(W.partitionBy(*groups))
    place = F.when(total == 1, F.lit(1.0)).otherwise((before + (F.col("__n") - 1) / 2) / F.greatest(total - 1, F.lit(1)))
    ranks = counts.select(*[F.col(g).alias(f"__g_{g}") for g in groups], "__v", place.alias(name))
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups] + [v == F.col("__v")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(ranks, cond, "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop("__v", *[f"__g_{g}" for g in groups])


def surrogates(codes: DataFrame, reference: D.Reference, id_column: str, privacy: str | None = None) -> DataFrame:
    """Ranks of balance (1-D, 2-D) and support (1-D, 2-D) and their mixes; ``privacy``: a column of v2 scores to rank too."""
    one, two = D.pool_balance(codes, reference)
    df = codes.select(  # the first ranking writes this out; the others read on from there
        id_column, *([privacy] if privacy else []), F.round(one, 9).alias("balance_1d"), F.round(two, 9).alias("balance_2d"),
        F.round(D.prob_geomean(codes, reference), 9).alias("support_1d"), F.round(D.pair_geomean(reference), 9).alias("support_2d"),
    )
    for c in ("balance_1d", "balance_2d", "support_1d", "support_2d", *([privacy] if privacy else [])):
        df = rank_scale(df, c, id_column, f"{c}_rank")
    b1, b2, s1, s2 = (F.col(f"{c}_rank") for c in ("balance_1d", "balance_2d", "support_1d", "support_2d"))
    tie = 0.4 * s1 + 0.6 * s2
    return (
        df.withColumn("fidelity", 0.5 * b1 + 0.5 * b2).withColumn("tiebreak", tie).withColumn("band", 0.45 * b1 + 0.45 * b2 + 0.10 * tie)
        .withColumn("safe", 0.35 * b1 + 0.35 * b2 + 0.15 * s1 + 0.15 * s2).withColumn("stage_b", 0.40 * b1 + 0.40 * b2 + 0.20 * tie).withColumn("rarity", 1 - F.col("support_1d"))
    )


def robust_unit(df: DataFrame, column: str, name: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """q05 to q95 mapped to 0 to 1; minimum to maximum where those coincide; 0 on a constant column."""
    a, b = exact_quantiles(df, [column], [low, high])[column] or (0.0, 0.0)
    if b - a <= 1e-12:
        r = df.agg(F.min(column), F.max(column)).first()
        a, b = float(r[0] or 0.0), float(r[1] or 0.0)
    return df.withColumn(name, S.scaled(F.col(column), F.lit(a), F.lit(b)))


def exact_scores(current: DataFrame, codes: DataFrame, reference: D.Reference, id_column: str, penalty_weight: float = 1.0) -> DataFrame:
    """Add-one gains less weighted penalties, raw and scaled, and their mean."""
    # The quantiles below read the scores several times.
    out = materialize(D.add_one(current, codes, reference, id_column))
    out = out.withColumn("objective_1d", F.col("after_1d") - penalty_weight * F.col("penalty_1d")).withColumn("objective_2d", F.col("after_2d") - penalty_weight * F.col("penalty_2d"))
    out = robust_unit(robust_unit(out, "objective_1d", "scaled_1d"), "objective_2d", "scaled_2d")
    return out.withColumn("objective", 0.5 * F.col("objective_1d") + 0.5 * F.col("objective_2d")).withColumn("scaled", 0.5 * F.col("scaled_1d") + 0.5 * F.col("scaled_2d"))


def row_utility(p_true: Column, probabilities: Column, classes: int) -> Column:
    """p_true * (0.5 + 0.5 * entropy / ln classes)."""
    entropy = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return p_true * (0.5 + 0.5 * entropy / F.lit(math.log(max(2, classes))))


def regression_utility(residual: Column, deviation: float) -> Column:
    return F.exp(-F.abs(residual) / max(deviation, 1e-12))


def balanced_utility(df: DataFrame, utility: str, groups, density: str = "density_weight") -> DataFrame:
    """Rank within the group times the density weight: up to 2."""
    return grouped_rank(df, utility, groups, "utility_rank").withColumn("utility_balanced", F.col("utility_rank") * F.col(density))


def apply_source_prior(df: DataFrame, prior: dict[str, float], default: float, columns, source: str = "source_id") -> DataFrame:
    """Scores times the source's weight, clipped to [0, 1]; the old values stay as ``<column>_before``."""
    weights = F.create_map(*[x for k, v in prior.items() for x in (F.lit(k), F.lit(float(v)))]) if prior else F.create_map().cast("map<string,double>")
    w = F.coalesce(weights[F.col(source)], F.lit(float(default)))
    return df.withColumns({f"{c}_before": F.col(c) for c in columns} | {c: S.clip(F.col(c) * w, 0, 1) for c in columns} | {"prior_matched": F.col(source).isin(*prior) if prior else F.lit(False)})


def robust_block_mean(blocks: DataFrame, id_column: str, value: str) -> DataFrame:
    """Mean less half the deviation (ddof 0) of a row's blocks."""
    return blocks.groupBy(id_column).agg((F.avg(value) - 0.5 * F.coalesce(F.stddev_pop(value), F.lit(0.0))).alias(value))


def combined_utility(static: Column, dynamic: Column, coverage: Column) -> Column:
    return 0.60 * static + 0.30 * dynamic + 0.10 * coverage


def attach_scores(df: DataFrame, scores: DataFrame, id_column: str, defaults: dict[str, float]) -> DataFrame:
    """Left join of score columns with defaults, and ``matched``."""
    own = scores.select(F.col(id_column).alias("__id"), *defaults, F.lit(True).alias("__m"))
    keep = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()]
    return df.join(own, F.col(id_column) == F.col("__id"), "left").select(*[df[c] for c in df.columns], *keep, F.coalesce("__m", F.lit(False)).alias("matched"))


def fallback(df: DataFrame, id_column: str, tables: list[DataFrame], value: str, default: float) -> DataFrame:
    """The value of the first table that has the id, else the default."""
    out = df
    for i, t in enumerate(tables):
        out = out.join(t.select(F.col(id_column).alias(f"__id{i}"), F.col(value).alias(f"__v{i}")), F.col(id_column) == F.col(f"__id{i}"), "left").drop(f"__id{i}")
    names = [f"__v{i}" for i in range(len(tables))]
    return out.withColumn(value, F.coalesce(*names, F.lit(default))).drop(*names)
