"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document rates r minimise sum(r ln r - r) subject to sum(r * size) = target in each
source and r <= ``most``: r = min(most, exp(tilt * size)), one dual variable
(the tilt) a source.  The dual is convex; its Newton steps are
computed for all sources at once from the histogram (source, size, documents), whose
two sums per step are the gradient and the Hessian's diagonal (constraints of different
sources share no document).  A step that leaves the bracket of tilts known
to be too low and too high is replaced by the bracket's middle.

Rows equal in id and text are one document with a multiplicity: they are interchangeable, and however many there are, they add one row to a
bucket.  Rates become whole copies by systematic rounding along documents in descending size, in
hash buckets of each source: copies = floor(C + 1/2) - floor(C' + 1/2) for the running sums of the
rates, which are integers (2**-20 units), so reruns agree.  What the rounding leaves of the target is
made up by single copies of documents of the source's first bucket, the largest that help first.

Cases.  Null text: size 0, never copied for tokens (taken 0).  Null source: a source of its
own, last.  Null doc_id is kept; repeated rows count as documents each.  Empty
table: no rows.  Other columns are kept by ``mix`` as they are.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.llm._util import materialize, remove, shared_dir, text_or_empty

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
UNIT = 1 << 20
#: Documents in a bucket, in expectation: what a window task sorts and what the correction looks at.
BUCKET_ROWS = 4096
#: Equal rows that are dealt out together.
DEAL_ROWS = 4096
#: Rows of three numbers that a broadcast may have.
MOST_BROADCAST = 200_000


def word_count(text) -> F.Column:
    """Number of runs of bytes other than space and 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, total_factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size, ...): the weights' shares, stopped at ``most`` times the size.

    Sharing the excess again and again ends at target = min(cap, level * weight); the
    level follows from prefix sums over the sources in order of cap / weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    capped = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(total_factor)
    level = ranked.withColumn("level", (total - capped) / open_weight)
    # The first source in this order whose cap isn't reached sets the level.
    held = level.withColumn("own", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    first = F.first("own", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return held.withColumn("first_level", first).withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.col("first_level") * F.col("weight"), F.col("cap")))
    ).drop("rank", "weight", "cap", "level", "own", "first_level")


def newton_tilts(histogram: DataFrame, aims: DataFrame, most: float, home: str, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source_key, tilt, all_in, scale): rates are min(most, exp(tilt * size / scale)); all_in: most everywhere.

    ``histogram``: (source_key, size, n), size > 0.  ``aims``: (source_key, source_size, target, n_docs).
    """
    spark = histogram.sparkSession
    ln_most = math.log(most)
    # The scale is the source's mean size; the starting tilt is that of documents of the mean size.
    scale = F.greatest(F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)), F.lit(1e-9))
    now = aims.select(
        "source_key", "target", scale.alias("scale"),
        (F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))).alias("all_in"),
        F.log(F.greatest(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1e-12))).alias("tilt"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("gap"),
    )
    last = None
    for k in range(rounds):
        here = f"{home}/newton{k}"
        x = F.col("size") / F.col("scale")
        power = F.col("tilt") * x
        rate = F.when(power >= ln_most, F.lit(most)).otherwise(F.exp(power))
        sums = histogram.join(now, "source_key").groupBy("source_key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("value"),
            F.sum(F.when(power < ln_most, F.col("n") * F.col("size") * x * F.exp(power)).otherwise(0.0)).alias("slope"),
        )
        step = now.join(sums, "source_key", "left").withColumn("off", F.coalesce(F.col("value"), F.lit(0.0)) - F.col("target"))
        step = step.withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") >= 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.col("off") / F.greatest(F.col("slope"), F.lit(1e-300))
        # Outside the bracket: its middle, or twice as far while one end is open.
        middle = (
            F.when((F.col("low") > -1e6) & (F.col("high") < 1e6), (F.col("low") + F.col("high")) / 2)
            .when(F.col("off") < 0, F.col("tilt") + F.greatest(F.abs("tilt"), F.lit(1.0)))
            .otherwise(F.col("tilt") - F.greatest(F.abs("tilt"), F.lit(1.0)))
        )
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) < 8)
        gap = F.when(F.col("all_in") | (F.col("target") <= 0), 0.0).otherwise(F.abs("off") / F.greatest(F.col("target"), F.lit(1e-9)))
        now = materialize(
            step.select("source_key", "target", "scale", "all_in", F.when(gap <= tolerance, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"), "low", "high", gap.alias("gap")),
            here,
        )
        if last:
            remove(spark, last)
        last = here
        gap = now.agg(F.max("gap")).first()[0] or 0.0
        if gap <= tolerance:
            break
    else:
        warnings.warn(f"after {rounds} rounds a source is still {gap:.2g} of its target away", stacklevel=2)
    return now


def row_key(id_column: str) -> F.Column:
    return F.xxhash64(F.col(id_column), text_or_empty())


def plan_documents(docs: DataFrame, total_factor: float = 1.5, most: int = 2, id_column: str = "doc_id") -> DataFrame:
    """A row for each distinct (id, text): doc_id, size, source_size, target, row_hash, n equal rows, copies of them together (0 to ``most`` * n)."""
    spark = docs.sparkSession
    home = shared_dir(spark)
    sized = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(word_count(text_or_empty()), F.lit(0)).cast("long").alias("size"),
            row_key(id_column).alias("row_hash"),
        ).groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("n"))
        # A null source is its own key; the letter keeps it apart from the text of a real one.
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))),
        f"{home}/sized",
    )
    histogram = materialize(sized.groupBy("source", "source_key", "size").agg(F.sum("n").alias("n")), f"{home}/histogram")
    by_source = histogram.groupBy("source", "source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    aims = materialize(targets(by_source, total_factor, float(most)), f"{home}/aims")
    tilts = newton_tilts(histogram.where("size > 0"), aims, float(most), home)
    # The rounded tilt hides the last bits of sums whose order varies between runs.
    plan = aims.join(tilts.select("source_key", "scale", "all_in", F.round("tilt", 9).alias("tilt")), "source_key").withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_ROWS))
    plan = materialize(plan.select("source_key", "source_size", F.col("target"), "scale", "all_in", "tilt", "buckets"), f"{home}/plan")
    rate = F.when(F.col("size") == 0, 0).when(F.col("all_in"), most * UNIT).otherwise(
        F.least(F.lit(most * UNIT), F.floor(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))) * UNIT + F.lit(0.5)))
    ).cast("long")
    rated = sized.join(plan, "source_key").withColumn("rate", rate).withColumn("bucket", F.pmod("row_hash", F.col("buckets")))
    rated = rated.withColumn("rate", F.col("rate") * F.col("n"))
    rated = materialize(rated.select("doc_id", "size", "n", "source_key", "source_size", "target", "row_hash", "bucket", "rate"), f"{home}/rated")
    order = W.partitionBy("source_key", "bucket").orderBy(F.desc("size"), "row_hash", "doc_id")
    # Buckets start from the rates' sum in the buckets before.
    sums = rated.groupBy("source_key", "bucket").agg(F.sum("rate").alias("sum"))
    starts = sums.select("source_key", "bucket", F.coalesce(F.sum("sum").over(W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    upto = F.sum("rate").over(order.rowsBetween(W.unboundedPreceding, 0))
    floor = lambda x: F.floor((x + UNIT // 2) / UNIT).cast("long")
    placed = rated.withColumn("upto", upto).withColumn("place", F.row_number().over(order)).join(starts, ["source_key", "bucket"])
    rounded = materialize(
        placed.withColumn("copies", floor(F.col("start") + F.col("upto")) - floor(F.col("start") + F.col("upto") - F.col("rate"))).drop("upto", "start", "rate"),
        f"{home}/rounded",
    )
    # The rest to the target, made up by documents of the first bucket: in descending size, one copy more or less
    # wherever that brings the source nearer to its target.
    rest = rounded.groupBy("source_key").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    usable = rounded.where("bucket = 0 and size > 0").join(rest.where("rest <> 0"), "source_key")
    chosen = usable.groupBy("source_key").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("size", "place", "copies", "n")), asc=False).alias("docs"))

    def step(acc, d):
        def flip(change):
            return F.struct((acc["left"] - change * d["size"]).alias("left"), F.concat(acc["done"], F.array(F.struct(d["place"].alias("place"), F.lit(change).alias("change")))).alias("done"))

        nearer = d["size"] < 2 * F.abs(acc["left"])
        return F.when(nearer & (acc["left"] > 0) & (d["copies"] < most * d["n"]), flip(1)).when(nearer & (acc["left"] < 0) & (d["copies"] > 0), flip(-1)).otherwise(acc)

    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<struct<place:int,change:int>>").alias("done"))
    fixes = chosen.select("source_key", F.lit(0).cast("long").alias("bucket"), F.explode(F.aggregate("docs", start, step)["done"]).alias("fix")).select("source_key", "bucket", "fix.place", "fix.change")
    done = rounded.join(fixes, ["source_key", "bucket", "place"], "left").withColumn("copies", F.col("copies") + F.coalesce(F.col("change"), F.lit(0)))
    return done.select("doc_id", "size", "source_size", "target", "row_hash", "n", "copies")


def share_of(copies: str, n: str, nth: str) -> F.Column:
    """Copies of the nth (from 1) of n equal rows that have ``copies`` together."""
    return F.expr(f"cast({copies} div {n} + if({nth} <= {copies} % {n}, 1, 0) as int)")


def plan_mix(docs: DataFrame, total_factor: float = 1.5, most: int = 2, id_column: str = "doc_id") -> DataFrame:
    """For every row: doc_id, size, source_size, target, copies (0 to ``most``), taken = copies * size."""
    plan = plan_documents(docs, total_factor, most, id_column)
    single = plan.where("n = 1").select("doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"))
    # Equal rows come back in lots of bounded size, spread over the tasks.
    lots = plan.where("n > 1").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {DEAL_ROWS}"))))
    lots = lots.repartition("row_hash", "lot").withColumn("nth", F.explode(F.sequence(F.expr(f"lot * {DEAL_ROWS} + 1"), F.least(F.col("n"), F.expr(f"(lot + 1) * {DEAL_ROWS}")))))
    equal = lots.select("doc_id", "size", "source_size", "target", share_of("copies", "n", "nth").alias("copies"))
    return single.unionByName(equal).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, total_factor: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its copies say, all columns kept."""
    home = shared_dir(docs.sparkSession)
    plan = plan_documents(docs, total_factor, most)
    # Equal ids and texts may have several sources, planned apart; their copies are dealt out together.
    per = plan.groupBy(F.col("row_hash").alias("__mix_hash")).agg(F.sum("copies").alias("__mix_copies"), F.sum("n").alias("__mix_n"))
    per = materialize(per, f"{home}/per")
    keyed = docs.withColumn("__mix_key", row_key("doc_id"))
    same = F.col("__mix_key") == F.col("__mix_hash")
    one = keyed.join(per.where("__mix_n = 1 and __mix_copies > 0"), same).withColumn("__mix_own", F.col("__mix_copies").cast("int"))
    # Equal rows are numbered within their tasks, and tasks by a table of (key, task); keys of over one row in 1024, at most 1024, go
    # to every task, so that none of them meets in one.
    total = per.agg(F.sum("__mix_n")).first()[0] or 0
    several, often = per.where("__mix_n > 1 and __mix_copies > 0"), F.col("__mix_n") * 1024 > total
    rest = several.where(~often)
    # Few repeated texts go to every task too, so that the others needn't be shuffled to find them.
    rest = F.broadcast(rest) if rest.count() <= MOST_BROADCAST else rest
    held = keyed.join(F.broadcast(several.where(often)), same).unionByName(keyed.join(rest, same))
    held = materialize(held.withColumn("__mix_at", F.monotonically_increasing_id()), f"{home}/several").withColumn("__mix_task", F.shiftright("__mix_at", 33))
    counts = held.groupBy(F.col("__mix_key").alias("__mix_k"), F.col("__mix_task").alias("__mix_t")).agg(F.count("*").alias("__mix_c"))
    before = F.coalesce(F.sum("__mix_c").over(W.partitionBy("__mix_k").orderBy("__mix_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__mix_k", "__mix_t", before.alias("__mix_before"))
    held = held.withColumn("__mix_nth", F.row_number().over(W.partitionBy("__mix_key", "__mix_task").orderBy("__mix_at")))
    held = held.join(counts, (F.col("__mix_key") == F.col("__mix_k")) & (F.col("__mix_task") == F.col("__mix_t")))
    held = held.withColumn("__mix_nth", F.col("__mix_nth") + F.col("__mix_before")).withColumn("__mix_own", share_of("__mix_copies", "__mix_n", "__mix_nth"))
    names = [*docs.columns, "__mix_own"]
    every = one.select(names).unionByName(held.select(names)).where("__mix_own > 0")
    return every.withColumn("__mix_c", F.explode(F.sequence(F.lit(1), F.col("__mix_own")))).select(*docs.columns)
