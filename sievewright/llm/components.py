"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on long ids; the edges are written
to the shared folder after every round, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._util import materialize, remove, shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large star links each larger neighbour, small star
    each smaller one and the node itself, to the smallest id in the neighbourhood."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = (
            edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
            .join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); component is the smallest id reachable.

    Nulls and self loops are ignored; no edges gives no rows.  Ids without edges
    don't appear: the caller's own id is then its component.
    """
    spark = edges.sparkSession
    home = shared_dir(spark)
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct(),
        f"{home}/r0",
    )
    seen, last = None, f"{home}/r0"
    for k in range(1, max_rounds + 1):
        here = f"{home}/r{k}"
        now = materialize(_star(_star(now, True), False), here)
        remove(spark, last)
        last = here
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
