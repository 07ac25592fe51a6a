"""Distributions over buckets, and how near two tables' distributions are."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators.cards import Cards
from sievewright.operators.ranks import running_sums


def code_of(column: str, cards: Cards) -> Column:
    """Bucket code of a column's value; -1 for an unknown category."""
    if column in cards.roles.numeric:
        return S.bucket_numeric(F.col(column), cards.bins[column])
    if column in cards.roles.discrete:
        return S.nearest_legal(F.col(column).cast("double"), cards.legal[column])
    return S.bucket_category(F.col(column), cards.legal[column])


def encode(df: DataFrame, cards: Cards, columns=None, keep=()) -> DataFrame:
    """Columns replaced by their codes."""
    return df.select(*keep, *[code_of(c, cards).alias(c) for c in (columns or cards.roles.columns)])


def code_counts(codes: DataFrame, columns) -> DataFrame:
    """(column, code, n) of known codes; one pass over all columns, counted before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("code")) for c in columns])
    return codes.select(F.explode(cells).alias("x")).where("x.code >= 0").groupBy("x.column", "x.code").agg(F.count("*").alias("n"))


def marginals(codes: DataFrame, cards: Cards, columns) -> DataFrame:
    """(column, code, n, p) over every bucket, empty ones too.  Its size is the cards' buckets, whatever the rows."""
    spark = codes.sparkSession
    grid = spark.createDataFrame([(c, cards.size(c)) for c in columns], "column string, size int").select("column", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("code"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(code_counts(codes, columns), ["column", "code"], "left").select(
        "column", "code", n.alias("n"), (n / F.greatest(F.sum(n).over(W.partitionBy("column")), F.lit(1))).alias("p")
    )


def pair_counts(codes: DataFrame, cards: Cards, pairs) -> DataFrame:
    """(left, right, code, n); one pass over all pairs."""
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), S.pair_code(F.col(a), F.col(b), cards.size(b)).alias("code")) for a, b in pairs])
    return codes.select(F.explode(cells).alias("x")).where("x.code >= 0").groupBy("x.left", "x.right", "x.code").agg(F.count("*").alias("n"))


def pair_nmi(codes: DataFrame, cards: Cards, columns, max_edges: int = 32) -> DataFrame:
    """(left, right, mi): mutual information / sqrt of the entropies' product, the highest first, names descending on ties."""
    sizes = {c: cards.size(c) for c in columns}
    pairs = list(combinations(columns, 2))
    bins = F.create_map(*[x for c, s in sizes.items() for x in (F.lit(c), F.lit(s))])
    own = pair_counts(codes, cards, pairs).withColumn("bins", bins[F.col("right")])
    p = F.col("n") / F.sum("n").over(W.partitionBy("left", "right"))
    own = own.withColumn("p", p).withColumn("a", F.expr("code div bins")).withColumn("b", F.expr("code % bins"))
    own = own.withColumn("pa", F.sum("p").over(W.partitionBy("left", "right", "a"))).withColumn("pb", F.sum("p").over(W.partitionBy("left", "right", "b")))
    # Each row bucket's entropy share is spread over its cells, so one aggregation gives all three sums.
    sums = own.groupBy("left", "right").agg(
        F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), (-F.sum(F.col("p") * F.ln("pa"))).alias("ha"), (-F.sum(F.col("p") * F.ln("pb"))).alias("hb")
    )
    nmi = F.when((F.col("ha") <= 1e-12) | (F.col("hb") <= 1e-12), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))))
    return sums.select("left", "right", nmi.alias("mi")).orderBy(F.desc("mi"), F.desc("left"), F.desc("right")).limit(max_edges)


@dataclass
class Reference:
    """The real table's distributions on the driver: bounded by the cards' buckets and ``max_edges`` pairs."""

    cards: Cards
    columns: tuple[str, ...]
    probs: dict[str, list[float]]
    edges: list[tuple[str, str, float]]
    pair_probs: dict[tuple[str, str], list[float]]


def fit_reference(train: DataFrame, cards: Cards, columns=None, max_edges: int = 32, round_mi: int = 9) -> Reference:
    columns = tuple(columns or cards.roles.columns)
    codes = encode(train, cards, columns).cache()
    probs = {c: [0.0] * cards.size(c) for c in columns}
    for r in marginals(codes, cards, columns).collect():
        probs[r["column"]][r["code"]] = r.p
    edges = [(r.left, r.right, round(r.mi, round_mi)) for r in pair_nmi(codes, cards, columns, max_edges).collect()]
    pair_probs = {(a, b): [0.0] * (cards.size(a) * cards.size(b)) for a, b, _ in edges}
    if edges:
        rows = pair_counts(codes, cards, [(a, b) for a, b, _ in edges]).collect()
        total: dict = {}
        for r in rows:
            total[r.left, r.right] = total.get((r.left, r.right), 0) + r.n
        for r in rows:
            pair_probs[r.left, r.right][r.code] = r.n / total[r.left, r.right]
    codes.unpersist()
    return Reference(cards, columns, probs, edges, pair_probs)


def column_similarity(real: DataFrame, synthetic: DataFrame, cards: Cards, columns) -> DataFrame:
    """(column, similarity): 1 - total variation distance of the code distributions."""
    a, b = (marginals(encode(x, cards, columns), cards, columns).select("column", "code", F.col("p").alias(n)) for x, n in ((real, "p"), (synthetic, "q")))
    return a.join(b, ["column", "code"]).groupBy("column").agg((1 - 0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("similarity"))


def pair_similarity(reference: Reference, synthetic: DataFrame) -> DataFrame:
    """(left, right, mi, similarity) for the reference's pairs."""
    spark, cards = synthetic.sparkSession, reference.cards
    rows = [(a, b, mi, code, p) for a, b, mi in reference.edges for code, p in enumerate(reference.pair_probs[a, b])]
    real = spark.createDataFrame(rows, "left string, right string, mi double, code long, p double")
    counts = pair_counts(encode(synthetic, cards, reference.columns), cards, [(a, b) for a, b, _ in reference.edges])
    joined = real.join(counts, ["left", "right", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    q = F.col("n") / F.greatest(F.sum("n").over(W.partitionBy("left", "right")), F.lit(1))
    return joined.withColumn("q", q).groupBy("left", "right").agg(F.first("mi").alias("mi"), (1 - 0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("similarity"))


def pair_fidelity(pairs: DataFrame) -> DataFrame:
    """One row: the similarity weighted by max(mi, 1e-6); 1 without pairs."""
    w = F.greatest("mi", F.lit(1e-6))
    return pairs.agg(F.coalesce(F.sum(w * F.col("similarity")) / F.sum(w), F.lit(1.0)).alias("pair_fidelity"))


def prob_geomean(codes: DataFrame, reference: Reference, columns=None) -> Column:
    """Geometric mean of the row's bucket probabilities; unknown buckets count 1e-12."""
    return S.geometric_mean([S.lookup(F.col(c), reference.probs[c], 1e-12) for c in (columns or reference.columns)])


def pair_geomean(reference: Reference) -> Column:
    cards = reference.cards
    return S.geometric_mean([S.lookup(S.pair_code(F.col(a), F.col(b), cards.size(b)), reference.pair_probs[a, b], 1e-12) for a, b, _ in reference.edges])


def pool_balance(codes: DataFrame, reference: Reference) -> tuple[Column, Column]:
    """Mean over columns, and over pairs, of min(train share / pool share, 1); unknown buckets 0."""
    cards, columns = reference.cards, reference.columns
    pool = {c: [0.0] * cards.size(c) for c in columns}
    for r in marginals(codes, cards, columns).collect():
        pool[r["column"]][r["code"]] = r.p
    ratio = lambda real, own: [min(1.0, t / p) if p > 0 else 0.0 for t, p in zip(real, own, strict=True)]
    one = [S.lookup(F.col(c), ratio(reference.probs[c], pool[c]), 0.0) for c in columns]
    two = []
    if reference.edges:
        total, counts = {}, {}
        for r in pair_counts(codes, cards, [(a, b) for a, b, _ in reference.edges]).collect():
            counts[r.left, r.right, r.code] = r.n
            total[r.left, r.right] = total.get((r.left, r.right), 0) + r.n
        for a, b, _ in reference.edges:
            own = [counts.get((a, b, i), 0) / max(total.get((a, b), 0), 1) for i in range(len(reference.pair_probs[a, b]))]
            two.append(S.lookup(S.pair_code(F.col(a), F.col(b), cards.size(b)), ratio(reference.pair_probs[a, b], own), 0.0))
    mean = lambda parts: sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(1.0)
    return mean(one), mean(two)


def add_one_tables(counts: list[int], probs: list[float]) -> tuple[list[float], list[float]]:
    """For each bucket: similarity to ``probs`` after one more row there, and the penalty for going over its share."""
    size = sum(counts)
    rest = 0.5 * sum(abs(c / (size + 1) - p) for c, p in zip(counts, probs, strict=True))
    after = [1 - (rest + 0.5 * (abs((c + 1) / (size + 1) - p) - abs(c / (size + 1) - p))) for c, p in zip(counts, probs, strict=True)]
    return after, [max(0.0, (c + 1) / (size + 1) - p) for c, p in zip(counts, probs, strict=True)]


def add_one(current: DataFrame, codes: DataFrame, reference: Reference, id_column: str) -> DataFrame:
    """(id, after_1d, penalty_1d, after_2d, penalty_2d): fidelity of ``current`` with each candidate added.

    Counts of ``current`` become per-bucket tables on the driver (bounded by buckets); candidates are scored in one projection.
    An unknown bucket raises an error.
    """
    cards, columns = reference.cards, reference.columns
    own = encode(current, cards, columns)
    counts = {c: [0] * cards.size(c) for c in columns}
    for r in code_counts(own, columns).collect():
        counts[r["column"]][r["code"]] = r.n
    one = [(F.col(c), *add_one_tables(counts[c], reference.probs[c])) for c in columns]
    bad = F.greatest(*[(F.col(c) < 0).cast("int") for c in columns]) == 1 if len(columns) > 1 else F.col(columns[0]) < 0
    avg = lambda parts: sum(parts[1:], parts[0]) / len(parts)
    after1, pen1 = (avg([S.lookup(code, t[i], 0.0) for code, *t in one]) for i in (0, 1))
    if reference.edges:
        pc = {(a, b): [0] * len(reference.pair_probs[a, b]) for a, b, _ in reference.edges}
        for r in pair_counts(own, cards, list(pc)).collect():
            pc[r.left, r.right][r.code] = r.n
        weights = [max(mi, 1e-6) for *_, mi in reference.edges]
        tables = [(S.pair_code(F.col(a), F.col(b), cards.size(b)), *add_one_tables(pc[a, b], reference.pair_probs[a, b])) for a, b, _ in reference.edges]
        after2, pen2 = (sum((S.lookup(code, t[i], 0.0) * (w / sum(weights)) for (code, *t), w in zip(tables, weights, strict=True)), F.lit(0.0)) for i in (0, 1))
    else:
        after2, pen2 = F.lit(1.0), F.lit(0.0)
    checked = F.when(bad, F.raise_error(F.lit("unknown bucket")).cast("double")).otherwise(after1)
    return codes.select(id_column, checked.alias("after_1d"), pen1.alias("penalty_1d"), after2.alias("after_2d"), pen2.alias("penalty_2d"))


def jensen_shannon(real: DataFrame, synthetic: DataFrame, cards: Cards, columns, limit: float = 0.15) -> DataFrame:
    """(column, jsd, within): natural-log divergence, and whether it is at most ``limit``."""
    a, b = (marginals(encode(x, cards, columns), cards, columns).select("column", "code", F.col("p").alias(n)) for x, n in ((real, "p"), (synthetic, "q")))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    own = a.join(b, ["column", "code"]).groupBy("column").agg((0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))).alias("jsd"))
    return own.withColumn("within", F.col("jsd") <= limit)


def rare_inflation(real: DataFrame, synthetic: DataFrame, cards: Cards, columns, rare: float = 0.05) -> DataFrame:
    """(column, code, real_p, synthetic_p, diff, ratio) of buckets rare in the real table, most inflated first."""
    a, b = (marginals(encode(x, cards, columns), cards, columns).select("column", "code", F.col("p").alias(n)) for x, n in ((real, "real_p"), (synthetic, "synthetic_p")))
    own = a.join(b, ["column", "code"]).where(F.col("real_p") <= rare)
    return own.withColumn("diff", F.col("synthetic_p") - F.col("real_p")).withColumn("ratio", F.col("synthetic_p") / F.greatest("real_p", F.lit(1e-12))).orderBy(F.desc("diff"), "column", "code")


def keep_rate(pool: DataFrame, selected: DataFrame, id_column: str, stratum: str) -> DataFrame:
    """(stratum, n, kept, keep_rate)."""
    marks = selected.select(F.col(id_column).alias("__s")).distinct()
    own = pool.join(marks, F.col(id_column) == F.col("__s"), "left").groupBy(stratum).agg(F.count("*").alias("n"), F.count("__s").alias("kept"))
    return own.withColumn("keep_rate", F.col("kept") / F.col("n"))


def balance_mass(real: DataFrame, pool: DataFrame, groups) -> DataFrame:
    """(group, real_p, pool_p, density_weight in [0.5, 2], coverage_gain in [0, 1])."""
    share = lambda df, n: df.groupBy(*groups).agg(F.count("*").alias("c")).select(*groups, (F.col("c") / F.sum("c").over(W.partitionBy())).alias(n))
    own = share(pool, "pool_p").join(share(real, "real_p"), list(groups), "left").withColumn("real_p", F.coalesce("real_p", F.lit(0.0)))
    ratio = F.col("real_p") / F.greatest("pool_p", F.lit(1e-12))
    return own.withColumn("density_weight", S.clip(ratio, 0.5, 2)).withColumn("coverage_gain", S.clip((F.col("real_p") - F.col("pool_p")) / F.greatest("real_p", F.lit(1e-12)), 0, 1))


def category_overlap(real: DataFrame, synthetic: DataFrame, columns) -> DataFrame:
    """(column, raw_overlap, stripped_overlap): share of the synthetic values known to the real table."""
    from sievewright.operators.cards import long_values

    out = None
    for name, clean in (("raw", lambda c: c), ("stripped", F.trim)):
        a, b = (long_values(x, columns).where("value is not null").select("column", clean(F.col("value")).alias("value")).distinct() for x in (real, synthetic))
        own = b.join(a.withColumn("known", F.lit(1)), ["column", "value"], "left").groupBy("column").agg((F.count("known") / F.count("*")).alias(f"{name}_overlap"))
        out = own if out is None else out.join(own, "column")
    return out


def quality_report(real: DataFrame, synthetic: DataFrame, roles) -> DataFrame:
    """(property, name, score) by the public definitions: KS and TV complements, correlation and contingency similarity.

    Numeric columns: 1 - the largest gap of the two distribution functions, over distinct values.  Others: 1 - total variation distance.  Numeric pairs: 1 - |r - s| / 2.
    Pairs of categories: 1 - total variation distance of the joint shares.
    """
    numeric, labels = (*roles.numeric, *roles.discrete), roles.labels
    both = real.select(*numeric, *labels, F.lit(0).alias("__t")).unionByName(synthetic.select(*numeric, *labels, F.lit(1).alias("__t"))).cache()
    sizes = {r["__t"]: r["count"] for r in both.groupBy("__t").count().collect()}
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numeric])
    counts = both.select("__t", F.explode(cells).alias("x")).groupBy("x.name", "x.v").agg(F.sum((F.col("__t") == 0).cast("long")).alias("a"), F.sum((F.col("__t") == 1).cast("long")).alias("b"))
    gaps = running_sums(counts, ["name"], [F.col("v").asc()], {"upto_a": "a", "upto_b": "b"}).withColumn("gap", F.abs(F.col("upto_a") / F.lit(n0) - F.col("upto_b") / F.lit(n1)))
    shapes = gaps.groupBy("name").agg((1 - F.max("gap")).alias("score"))
    names = [(c,) for c in labels] + [(a, b) for a, b in combinations(labels, 2)]
    cells = F.array(*[F.struct(F.lit(",".join(k)).alias("name"), F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in k]).alias("v")) for k in names])
    counts = both.select("__t", F.explode(cells).alias("x")).groupBy("x.name", "x.v").agg(F.sum((F.col("__t") == 0).cast("long")).alias("a"), F.sum((F.col("__t") == 1).cast("long")).alias("b"))
    tv = counts.groupBy("name").agg((1 - 0.5 * F.sum(F.abs(F.col("a") / F.lit(n0) - F.col("b") / F.lit(n1)))).alias("score"))
    shape_rows = shapes.unionByName(tv.where(~F.col("name").contains(","))).select(F.lit("shape").alias("property"), "name", "score")
    trends = tv.where(F.col("name").contains(","))
    pairs = list(combinations(numeric, 2))
    if pairs:
        at = lambda t, c: F.when(F.col("__t") == t, F.col(c).cast("double"))
        corr = both.agg(*[F.corr(at(t, a), at(t, b)).alias(f"{i}_{t}") for i, (a, b) in enumerate(pairs) for t in (0, 1)])
        rows = F.array(*[F.struct(F.lit(f"{a},{b}").alias("name"), (1 - F.abs(F.col(f"{i}_0") - F.col(f"{i}_1")) / 2).alias("score")) for i, (a, b) in enumerate(pairs)])
        trends = trends.unionByName(corr.select(F.explode(rows).alias("x")).select("x.name", "x.score"))
    return shape_rows.unionByName(trends.select(F.lit("trend").alias("property"), "name", "score"))


def compress_categories(df: DataFrame, column: str, most: int = 256, top: int = 64, clusters: int = 16) -> DataFrame:
    """(value, code_text): values of a column with at least ``most`` values; all but the ``top`` become tail tokens.

    The tail goes by descending count, then value; a value's cluster is the place of its mass's middle.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("value").asc()]
    ranked = running_sums(counts.withColumn("one", F.lit(1)), [], order, {"rn": "one", "mass": "n"}).drop("one")
    total, rows = (x or 0 for x in ranked.agg(F.sum("n"), F.count("*")).first())
    head = ranked.where(F.col("rn") <= top).agg(F.sum("n")).first()[0] or 0
    # The middle of a tail value's mass, as a share of the tail's.
    middle = F.col("mass") - F.lit(head) - F.col("n") / 2
    cluster = F.least(F.floor(middle * clusters / F.lit(max(total - head, 1))), F.lit(clusters - 1))
    token = F.format_string(f"__HC_{column}_TAIL_%02d__", cluster.cast("int"))
    return ranked.select("value", F.when(F.lit(rows < most) | (F.col("rn") <= top), F.col("value")).otherwise(token).alias("code_text"))
