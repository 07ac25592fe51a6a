"""Alpha-precision and beta-recall curves of a synthetic table against a real one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators import distance as J
from sievewright.operators.ranks import exact_quantiles
from sievewright.plans.workspace import materialize


def same_size(a: DataFrame, b: DataFrame, id_column: str, most: int = 20_000, seed: int = 0, order=None) -> tuple[DataFrame, DataFrame]:
    """Equal-sized samples of both, ``most`` rows at most."""
    n = min(a.count(), b.count(), most)
    key = F.xxhash64(F.lit(seed), F.col(id_column)) if order is None else order
    return tuple(x.orderBy(key, id_column).limit(n) for x in (a, b))


def center_distances(df: DataFrame, id_column: str, columns: Sequence[str], center: Sequence[float]) -> DataFrame:
    """(id, d): Euclidean distance to a point, in expressions."""
    total = sum(((F.col(c) - F.lit(float(m))) ** 2 for c, m in zip(columns, center, strict=True)), F.lit(0.0))
    return df.select(id_column, F.sqrt(total).alias("d"))


def center_of(df: DataFrame, columns: Sequence[str]) -> list[float]:
    return [float(x) for x in df.agg(*[F.avg(c) for c in columns]).first()]


def share_within(values: DataFrame, radii: DataFrame, flag=None) -> DataFrame:
    """(point, curve): share of rows with d at most the quantile of ``radii`` at each grid point.

    ``radii``: (point, r), as many rows as grid points.  Values are counted by the first radius that covers them, and the counts run up.
    """
    n = values.count()
    grid = [(r.point, r.r) for r in radii.orderBy("point").collect()]
    edges = F.array(*[F.lit(float(r)) for _, r in grid])
    slot = F.size(F.filter(edges, lambda e: e < F.col("d")))
    hit = values.where(flag) if flag is not None else values
    counts = hit.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    points = values.sparkSession.createDataFrame([(i, p) for i, (p, _) in enumerate(grid)], "slot int, point double")
    own = points.join(counts, "slot", "left").withColumn("c", F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("slot")))
    return own.select("point", (F.col("c") / F.lit(max(n, 1))).alias("curve"))


def radii(distances: DataFrame, points: int) -> DataFrame:
    """(point, r): quantiles of d on an even grid from 0 to 1."""
    grid = [i / (points - 1) for i in range(points)]
    found = exact_quantiles(distances, ["d"], grid)["d"]
    return distances.sparkSession.createDataFrame(list(zip(grid, found, strict=False)), "point double, r double")


def summary(curve: DataFrame) -> DataFrame:
    """One row: delta to the diagonal, trapezoid area, value at .95."""
    before = F.lag(F.struct("point", "curve")).over(W.orderBy("point"))
    area = curve.withColumn("b", before).withColumn("a", (F.col("curve") + F.col("b.curve")) / 2 * (F.col("point") - F.col("b.point")))
    near = F.min_by("curve", F.struct(F.round(F.abs(F.col("point") - 0.95), 12), "point"))
    return area.agg((1 - F.sum(F.abs(F.col("point") - F.col("curve"))) / F.sum("point")).alias("delta"), F.sum("a").alias("auc"), near.alias("at_095"))


def alpha_beta(real: DataFrame, synthetic: DataFrame, id_column: str, columns: Sequence[str], points: int = 101) -> tuple[DataFrame, DataFrame]:
    """(curves: curve, point, value; scores: name, value) over numeric columns scaled beforehand."""
    real, synthetic = real.select(id_column, *columns).cache(), synthetic.select(id_column, *columns).cache()
    rc, sc = center_of(real, columns), center_of(synthetic, columns)
    to_real = radii(center_distances(real, id_column, columns, rc), points)
    alpha = share_within(center_distances(synthetic, id_column, columns, rc), to_real)
    own = center_distances(synthetic, id_column, columns, sc)
    support = share_within(center_distances(real, id_column, columns, sc), radii(own, points))
    metric = J.Metric(tuple(columns), (), (0.0,) * len(columns), (1.0,) * len(columns), ())
    rr = J.nearest(real, id_column, real, id_column, metric, 1, skip_self=True).select(id_column, F.col("distance").alias("rr"))
    rs = J.nearest(real, id_column, synthetic, id_column, metric).select(id_column, F.col("neighbour").alias("s_id"), F.col("distance").alias("rs"))
    sr = J.nearest(synthetic, id_column, real, id_column, metric).select(F.col("neighbour").alias(id_column), F.col("distance").alias("sr"))
    covered = rs.join(rr, id_column).join(own.select(F.col(id_column).alias("s_id"), "d"), "s_id").cache()
    beta = share_within(covered, radii(covered, points), F.col("rs") <= F.col("rr"))
    authenticity = sr.join(rr, id_column).agg(F.avg((F.col("sr") > F.col("rr")).cast("int"))).first()[0]
    curves, rows = None, []
    for name, curve in (("alpha_precision", alpha), ("beta_coverage", beta), ("beta_support_recall", support)):
        part = curve.select(F.lit(name).alias("curve"), "point", F.col("curve").alias("value"))
        curves = part if curves is None else curves.unionByName(part)
        s = summary(curve).first()
        rows += [(f"delta_{name}", s.delta), (f"{name}_auc", s.auc), (f"{name}_at_0.95", s.at_095)]
    rows.append(("authenticity", authenticity))
    return curves, real.sparkSession.createDataFrame(rows, "name string, value double")


def evaluate_many(datasets: dict[str, Callable[[], tuple[DataFrame, DataFrame]]], id_column: str, columns: Sequence[str], points: int = 101, most: int = 20_000, stop_on_error: bool = False) -> DataFrame:
    """(dataset, name, value, error): the summary of each dataset's curves; a dataset that fails is a row with its error, and the others go on.

    A dataset is a function that gives its real and its synthetic rows.
    """
    spark, out, failed = SparkSession.active(), None, []
    for dataset, load in datasets.items():
        try:
            real, synthetic = same_size(*load(), id_column, most)
            scores = materialize(alpha_beta(real, synthetic, id_column, columns, points)[1])
        except Exception as e:  # noqa: BLE001  the next dataset doesn't depend on this one
            if stop_on_error:
                raise
            failed.append((dataset, None, None, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}" if str(e) else type(e).__name__))
            continue
        own = scores.select(F.lit(dataset).alias("dataset"), "name", "value", F.lit(None).cast("string").alias("error"))
        out = own if out is None else out.unionByName(own)
    errors = spark.createDataFrame(failed, "dataset string, name string, value double, error string")
    return errors if out is None else out.unionByName(errors)
