"""Membership audits: attack scores and the report of a binary score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators import distance as J
from sievewright.operators.ranks import running_sums
from sievewright.plans.workspace import materialize

#: Models that are fitted at a time: their jobs are short, and one alone leaves most tasks' places empty.
AT_ONCE = 5


def _all(work: Callable, items: Sequence) -> list:
    """What ``work`` gives for each item, some at a time."""
    if not items:
        return []
    spark = items[0][0].sparkSession
    with ThreadPool(min(AT_ONCE, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda x: work(*x)), items)


def _dealt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows dealt to tasks by their values, in a fixed order, so that a seed gives one forest; a small table stays as it is."""
    n = df.count()
    tasks = max(min(J.TASKS, n // J.LEAST), n // J.WAVE_ROWS)
    return df.repartition(tasks, *columns).sortWithinPartitions(*columns) if tasks > 1 else df


def _curve(df: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Per group and distinct score, highest first: running counts of members and others.  Heavy ties are one row, and the
    running counts of one attack's many scores are spread over tasks."""
    s = F.col(score).cast("double")
    fine = df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col(label).isin(0, 1))
    counts = fine.groupBy(*groups, s.alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    summed = running_sums(counts, groups, [F.col("s").desc()], {"tp": "p", "fp": "n"})
    # From the sums, which are written: the scores themselves are computed once.
    totals = summed.groupBy(*[F.col(g).alias(f"__t_{g}") for g in groups]).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.count("*").alias("values"))
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__t_{g}"))
    return summed.join(totals, cond).drop(*[f"__t_{g}" for g in groups])


def binary_report(df: DataFrame, label: str, score: str, groups: Sequence[str] = ("attack",)) -> DataFrame:
    """n_member, n_nonmember, auroc, auprc, attack_advantage, threshold, balanced_accuracy, TPR at FPR 1, 5 and 10 %.

    Null metrics with one class or a constant score.  Of equal advantages the highest threshold wins.
    """
    c = _curve(df, label, score, groups)
    tpr, fpr = F.col("tp") / F.col("pos"), F.col("fp") / F.col("neg")
    ok = (F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("values") > 1)
    best = F.max(F.struct((tpr - fpr).alias("adv"), F.col("s").alias("s"), tpr.alias("t"), fpr.alias("f")))
    at = lambda limit: F.coalesce(F.max(F.when(fpr <= limit, tpr)), F.lit(0.0))
    # Mann-Whitney: members above a score's others, and half of the ties.
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.max("pos") * F.max("neg"))
    prc = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")
    out = c.groupBy(*groups).agg(
        F.max("pos").alias("n_member"), F.max("neg").alias("n_nonmember"), F.max(ok).alias("ok"), auc.alias("auroc"), prc.alias("auprc"), best.alias("b"),
        at(0.01).alias("tpr_at_fpr_1pct"), at(0.05).alias("tpr_at_fpr_5pct"), at(0.10).alias("tpr_at_fpr_10pct"),
    )
    only = lambda c, n: F.when(F.col("ok"), c).alias(n)
    return out.select(
        *groups, "n_member", "n_nonmember", only(F.col("auroc"), "auroc"), only(F.col("auprc"), "auprc"), only(F.col("b.adv"), "attack_advantage"),
        only((F.col("b.t") + 1 - F.col("b.f")) / 2, "balanced_accuracy"), only(F.col("b.s"), "threshold"), *[only(F.col(f"tpr_at_fpr_{k}pct"), f"tpr_at_fpr_{k}pct") for k in (1, 5, 10)],
    )


def precision_recall(df: DataFrame, label: str, score: str, groups: Sequence[str] = ("attack",)) -> DataFrame:
    """(threshold, precision, recall) for each distinct score."""
    c = _curve(df, label, score, groups).where("pos > 0 and neg > 0")
    return c.select(*groups, F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))


def best_attack(reports: DataFrame) -> DataFrame:
    return reports.where("auroc is not null").orderBy(F.desc("auroc"), F.desc(F.coalesce("attack_advantage", F.lit(0.0))), "attack").limit(1)


def exact_match(target: DataFrame, synthetic: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """(id, score): 1 if an equal row is in the synthetic table; nulls equal each other.

    Membership goes over distinct rows, so copies don't multiply the join.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias(c) for c in columns]
    known = synthetic.select(*keys).distinct().withColumn("__known", F.lit(1.0))
    return target.select(id_column, *keys).join(known, list(columns), "left").select(id_column, F.coalesce("__known", F.lit(0.0)).alias("score"))


def nearest_neighbor(target: DataFrame, synthetic: DataFrame, id_column: str, synthetic_id: str, metric: J.Metric) -> DataFrame:
    """(id, score): minus the distance to the nearest synthetic row."""
    return J.nearest(target, id_column, synthetic, synthetic_id, metric).select(id_column, (-F.col("distance")).alias("score"))


def density_ratio(target: DataFrame, synthetic: DataFrame, reference: DataFrame, id_column: str, synthetic_id: str, reference_id: str, metric: J.Metric, k: int = 5, eps: float = 1e-8, near: DataFrame | None = None) -> DataFrame:
    """(id, score): ln of the k-th distance to the reference over that to the synthetic rows.  ``near``: the k nearest synthetic rows, if at hand."""
    kth = lambda found, n: found.groupBy(id_column).agg(F.max("distance").alias(n))
    near = J.nearest(target, id_column, synthetic, synthetic_id, metric, k) if near is None else near
    own = kth(J.nearest(target, id_column, reference, reference_id, metric, k), "r").join(kth(near, "s"), id_column)
    return own.select(id_column, F.ln((F.col("r") + eps) / (F.col("s") + eps)).alias("score"))


def _features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df.fillna(0.0, subset=list(columns)))


def attribute_error(target: DataFrame, synthetic: DataFrame, numeric: Sequence[str], labels: Sequence[str], id_column: str, most: int = 20, trees: int = 64, seed: int = 0) -> DataFrame:
    """(id, score): minus the mean error of forests that predict each column from the others, trained on the synthetic rows.

    Columns with the most values first, ``most`` at most.  Numbers: |error| / deviation; categories: -ln p of the true value.
    Columns with under two values are left out; without any column all scores are 0.
    """
    every = [*numeric, *labels]
    counts = synthetic.agg(*[F.approx_count_distinct(c).alias(c) for c in every]).first()
    chosen = [c for c in sorted(every, key=lambda c: (-counts[c], c))[:most] if counts[c] > 1 and len(every) > 1]
    # Every label of the synthetic rows has a code, commoner ones first; unseen ones and gaps share the last.  Adding 0 takes off the list of labels.
    named = lambda df: df.withColumns({c: F.col(c).cast("string") for c in labels})
    codes = [f"__code_{c}" for c in labels]
    indexer = StringIndexer(inputCols=list(labels), outputCols=codes, handleInvalid="keep", stringOrderType="frequencyDesc").fit(named(synthetic)) if labels else None
    coded = lambda df: indexer.transform(named(df)) if labels else df
    prep = lambda df: coded(df).select(id_column, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric], *[(F.col(x) + 0.0).alias(c) for c, x in zip(labels, codes, strict=True)])
    train, test = _dealt(prep(synthetic.withColumn(id_column, F.lit(0).cast("long"))), every).cache(), _dealt(prep(target), [id_column]).cache()
    train.count(), test.count()  # kept before several models read them at a time

    def errors_of(train: DataFrame, c: str) -> DataFrame:
        others = [x for x in every if x != c]
        a, b = _features(train, others), _features(test, others)
        if c in numeric:
            std = train.agg(F.stddev_pop(c)).first()[0] or 1.0
            got = RandomForestRegressor(featuresCol="features", labelCol=c, numTrees=trees, seed=seed).fit(a).transform(b)
            err = F.abs(F.col("prediction") - F.col(c)) / std
        else:
            got = RandomForestClassifier(featuresCol="features", labelCol=c, numTrees=trees, seed=seed).fit(a).transform(b)
            p = F.coalesce(F.try_element_at(vector_to_array("probability"), F.col(c).cast("int") + 1), F.lit(0.0))
            err = -F.ln(F.greatest(p, F.lit(1e-12)))
        return got.select(id_column, err.alias("e"))

    errors = test.select(id_column, F.lit(0.0).alias("e"))
    for own in _all(errors_of, [(train, c) for c in chosen]):
        errors = errors.unionByName(own)
    return errors.groupBy(id_column).agg((-F.sum("e") / max(len(chosen), 1)).alias("score"))


def score_frame(scores: dict[str, DataFrame], labels: DataFrame, id_column: str) -> DataFrame:
    """(id, label, one column for each attack)."""
    out = labels
    for name, df in scores.items():
        out = out.join(df.select(id_column, F.col("score").alias(name)), id_column, "left")
    return out


def long_scores(frame: DataFrame, attacks: Sequence[str]) -> DataFrame:
    """(attack, label, score) rows of a score frame."""
    cells = F.array(*[F.struct(F.lit(a).alias("attack"), F.col(a).alias("score")) for a in attacks])
    return frame.select("label", F.explode(cells).alias("x")).select("x.attack", "label", "x.score")


def supervised_profile(frame: DataFrame, attacks: Sequence[str], id_column: str, folds: int = 5, least: int = 4) -> DataFrame | None:
    """(id, score): out-of-fold probabilities of a logistic model over the attacks; None with under ``least`` rows a class.

    Folds are stratified by the place in a fixed shuffle of each label's rows.
    """
    counts = {r.label: r["count"] for r in frame.groupBy("label").count().collect()}
    few = min(counts.get(0, 0), counts.get(1, 0))
    if few < least:
        return None
    k = max(2, min(folds, few))
    own = _features(frame.withColumn("fold", F.pmod(F.xxhash64(id_column, "label"), F.lit(k))).withColumn("label", F.col("label").cast("double")), attacks).cache()
    own.count()  # kept before several models read it at a time

    def scored(own: DataFrame, i: int) -> DataFrame:
        model = LogisticRegression(maxIter=100).fit(own.where(F.col("fold") != i))
        return model.transform(own.where(F.col("fold") == i)).select(id_column, vector_to_array("probability")[1].alias("score"))

    out = None
    for part in _all(scored, [(own, i) for i in range(k)]):
        out = part if out is None else out.unionByName(part)
    return out


def shadow(frames: Sequence[DataFrame], target: DataFrame, id_column: str, trees: int = 128, seed: int = 0) -> DataFrame:
    """(id, score): a forest trained on the shadow score frames' common columns."""
    common = [c for c in target.columns if c not in (id_column, "label") and all(c in f.columns for f in frames)]
    train = None
    for k, f in enumerate(frames):
        part = f.select(F.lit(k).alias("__frame"), id_column, F.col("label").cast("double").alias("label"), *common)
        train = part if train is None else train.unionByName(part)
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(_features(_dealt(train, ["__frame", id_column, "label"]), common))
    return model.transform(_features(_dealt(target.select(id_column, *common), [id_column]), common)).select(id_column, vector_to_array("probability")[1].alias("score"))


def audit_scores(train: DataFrame, holdout: DataFrame, synthetic: DataFrame, reference: DataFrame, roles, id_column: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """The score frame of the release attacks on all rows, or on ``most`` rows of each role's own fixed shuffle; written once."""
    cut = lambda df, k: df if most is None else df.orderBy(F.xxhash64(F.lit(seed + k), F.col(id_column)), id_column).limit(most)
    members, others, syn, ref = cut(train, 0), cut(holdout, 1), cut(synthetic, 2), cut(reference, 3)
    target = members.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0))).cache()
    metric = J.fit_metric(target.unionByName(syn.withColumn("label", F.lit(0))), roles)
    # One search for both: the nearest synthetic row is the first of the nearest ones.
    near = materialize(J.nearest(target, id_column, syn, id_column, metric, 5))
    scores = {
        "exact_match": exact_match(target, syn, roles.columns, id_column),
        "nearest_neighbor": near.where("place = 1").select(id_column, (-F.col("distance")).alias("score")),
        "density_ratio": density_ratio(target, syn, ref, id_column, id_column, id_column, metric, 5, near=near),
        "attribute_error": attribute_error(target, syn, (*roles.numeric, *roles.discrete), roles.labels, id_column, seed=seed),
    }
    return materialize(score_frame(scores, target.select(id_column, "label"), id_column))


def run_audit(train: DataFrame, holdout: DataFrame, synthetic: DataFrame, reference: DataFrame, roles, id_column: str, most: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(reports, score frame) of the release attacks on all rows, or on ``most`` rows of each role's own fixed shuffle."""
    frame = audit_scores(train, holdout, synthetic, reference, roles, id_column, most, seed)
    return binary_report(long_scores(frame, [c for c in frame.columns if c not in (id_column, "label")]), "label", "score"), frame
