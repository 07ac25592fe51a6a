"""Selection metrics and rewards."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.scalars import clip, shifted_geomean
from sievewright.operators.ranks import exact_quantiles, sketch
from sievewright.plans.workspace import materialize

#: Which way each metric is better.
DIRECTIONS = {"roc_auc": "higher", "accuracy": "higher", "balanced_accuracy": "higher", "f1": "higher", "r2": "higher", "rmse": "lower", "mae": "lower", "shape": "higher", "trend": "higher", "dcr": "closer_to_0.5", "jsd": "lower"}
CLIP_TARGET, SIGMOID_SLOPE, SHIFT = (1.0, 20000.0), 4.0, 0.05


def dcr_summary(signal: DataFrame) -> DataFrame:
    """raw = share strictly closer to the real table, error = |raw - 0.5|, reward = 1 - error."""
    raw = F.avg((F.col("d_real") < F.col("d_test")).cast("int"))
    return signal.agg(raw.alias("dcr")).withColumn("dcr_error", F.abs(F.col("dcr") - 0.5)).withColumn("dcr_reward", 1 - F.col("dcr_error"))


def dcr_quantiles(signal: DataFrame, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(name, min, quantiles, max, mean) of d_real, d_test, and of the margin as real - test."""
    names = ["d_real", "d_test", "margin"]
    # Read by the ends, the buckets' counts and the wanted values: written once.
    own = materialize(signal.select("d_real", "d_test", (F.col("d_real") - F.col("d_test")).alias("margin")))
    row = own.agg(*[f(c).alias(f"{c}__{k}") for c in names for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], *sketch(names)).first()
    found = exact_quantiles(own, names, probs, points=row.asDict())
    rows = [(c, row[f"{c}__min"], *(found[c] or [None] * len(probs)), row[f"{c}__max"], row[f"{c}__mean"]) for c in names]
    columns = ", ".join(f"{x} double" for x in ("min", *[f"q{int(p * 100):02d}" for p in probs], "max", "mean"))
    return signal.sparkSession.createDataFrame(rows, f"name string, {columns}")


def direction(metric: Column) -> Column:
    out = F.lit("higher")
    for name, way in DIRECTIONS.items():
        out = F.when(F.lower(metric) == name, F.lit(way)).otherwise(out)
    return out


def unit_score(value: Column) -> Column:
    """Clipped to [0, 1]; 0 for what isn't a finite number."""
    return F.coalesce(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), clip(value, 0, 1)), F.lit(0.0))


def privacy_score(dcr: Column) -> Column:
    return unit_score(1 - F.abs(dcr - 0.5))


def classification_utility(auc: Column) -> Column:
    return unit_score((auc - 0.5) / 0.5)


def regression_utility(rmse: Column, log_std: Column) -> Column:
    """Sigmoid of 4 (1 - RMSE / deviation), both on the log of the target clipped to [1, 20000]."""
    return unit_score(1 / (1 + F.exp(-SIGMOID_SLOPE * (1 - rmse / F.greatest(log_std, F.lit(1e-12))))))


def log_target(y: Column) -> Column:
    return F.ln(clip(y.cast("double"), *CLIP_TARGET))


def reward(df: DataFrame, shape: str, trend: str, dcr: str, utility: Column, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """Adds the four component scores and their shifted weighted geometric mean."""
    out = df.withColumn("shape_score", unit_score(F.col(shape))).withColumn("trend_score", unit_score(F.col(trend))).withColumn("privacy_score", privacy_score(F.col(dcr))).withColumn("utility_score", utility)
    mean = shifted_geomean([F.col(c) for c in ("shape_score", "trend_score", "privacy_score", "utility_score")], weights, SHIFT)
    # The geometric mean of shifted scores runs from shift / (1 + shift) to 1.
    low = SHIFT / (1 + SHIFT)
    return out.withColumn("reward", clip((mean - low) / (1 - low), 0, 1))


def search_reward(parts: Sequence[Column]) -> Column:
    """Mean of the finite parts, clipped; null without any."""
    fine = F.filter(F.array(*parts), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.size(fine) > 0, clip(F.aggregate(fine, F.lit(0.0), lambda a, x: a + x) / F.size(fine), 0, 1))


def guard(checks: dict[str, bool]) -> dict:
    return {**checks, "guard_pass": all(checks.values())}


def worst(df: DataFrame, score: str, keys: Sequence[str], limit: int = 5) -> DataFrame:
    return df.where(F.col(score).isNotNull()).orderBy(score, *keys).limit(limit)


def objectives(df: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: each name's mean of its first column that has values, else of the second."""
    return df.agg(*[F.coalesce(F.avg(a), F.avg(b)).alias(n) for n, (a, b) in names.items()])


def proxy_reward(row: dict, keys: Sequence[str]) -> float:
    """The reward's mean of equal weights, on the driver, for a summary."""
    parts = [min(1.0, max(0.0, row.get(k) or 0.0)) for k in keys]
    return math.exp(sum(math.log((x + SHIFT) / (1 + SHIFT)) for x in parts) / len(parts))


def audit_metrics(report: DataFrame) -> dict[str, float]:
    """``<attack>_auroc`` and ``<attack>_advantage`` of an audit's report (attack, auroc, advantage), and the highest AUROC as ``audit_auroc``."""
    rows = report.select("attack", "auroc", "advantage").orderBy("attack").collect()  # one row an attack
    out = {f"{r.attack}_{k}": r[k] for r in rows for k in ("auroc", "advantage") if r[k] is not None}
    known = [r.auroc for r in rows if r.auroc is not None]
    return out | ({"audit_auroc": max(known)} if known else {})


def evaluate_selection(parts: dict[str, Callable[[], dict[str, float]]], required: Sequence[str] = ()) -> dict:
    """The metrics of all parts together; a part that fails is listed with its error, unless it is required.

    ``reward``: the mean of the shape, the trend, the DCR's and the utility's score, as far as they are there.
    """
    metrics: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, run in parts.items():
        try:
            metrics |= run()
        except Exception as e:  # noqa: BLE001  the other parts' metrics stand by themselves
            if name in required:
                raise
            failed[name] = f"{type(e).__name__}: {e}"
    scores = [metrics[k] for k in ("shape", "trend") if k in metrics] + ([1 - abs(metrics["dcr"] - 0.5)] if "dcr" in metrics else []) + [metrics[k] for k in ("utility",) if k in metrics]
    reward = sum(min(1.0, max(0.0, x)) for x in scores) / len(scores) if scores else None
    return {"metrics": metrics, "failed": failed, "reward": reward}
