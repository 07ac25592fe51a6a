"""Queries over metrics, rewards, audits, curves and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import audit as A
from sievewright.operators import distance as J
from sievewright.operators import metrics as M
from sievewright.operators import prcurve as PR
from sievewright.operators import utility as UT
from sievewright.plans.queries_profile import _L1, _L2, CUSTOMER, CUSTOMER_SQL, customer_role, rounded
from sievewright.plans.roles import LINEITEM, SQL, Roles, split, table
from sievewright.plans.workspace import materialize
from sievewright.registry import query

_SIGNAL = f"""{CUSTOMER_SQL}, x as (select a.c_custkey, min({_L1}) as d_real from cp a, ct b, sc group by 1), y as (select a.c_custkey, min({_L1}) as d_test from cp a, ch b, sc group by 1), sig as (select d_real, d_test from x join y on y.c_custkey = x.c_custkey)"""


def signal(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    return J.dcr_signal(customer_role(spark, sf_dir, 8, 9), "c_custkey", train, customer_role(spark, sf_dir, 6), J.fit_metric(train, CUSTOMER, norm=1), "c_custkey", "c_custkey")


@query(f"with {_SIGNAL}, r as (select avg((d_real < d_test)::int) as dcr from sig) select round(dcr, 9) as dcr, round(abs(dcr - 0.5), 9) as dcr_error, round(1 - abs(dcr - 0.5), 9) as dcr_reward from r")
def dcr_summary(spark, sf_dir):
    return rounded(M.dcr_summary(signal(spark, sf_dir)), "dcr", "dcr_error", "dcr_reward", digits=9)


@query(f"""with {_SIGNAL}, l as (select 'd_real' as name, d_real as v from sig union all select 'd_test', d_test from sig union all select 'margin', d_real - d_test from sig)
    select name, round(min(v), 6) as min, {", ".join(f"round(quantile_cont(v, {p}), 6) as q{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))}, round(max(v), 6) as max, round(avg(v), 6) as mean from l group by 1""")
def dcr_quantiles(spark, sf_dir):
    out = M.dcr_quantiles(signal(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "name"])


_REWARD = """with b as (select event_id, value / 100 as shape, (event_id % 100) / 100 as trend, (user_id % 100) / 100 as dcr, 0.4 + (event_id % 61) / 100 as auc from events),
    s as (select event_id, coalesce(greatest(0, least(1, shape)), 0) as a, greatest(0, least(1, trend)) as b, greatest(0, least(1, 1 - abs(dcr - 0.5))) as c, greatest(0, least(1, (auc - 0.5) / 0.5)) as d from b),
    g as (select *, exp(0.25 * (ln((a + 0.05) / 1.05) + ln((b + 0.05) / 1.05) + ln((c + 0.05) / 1.05) + ln((d + 0.05) / 1.05))) as m from s)"""


@query(f"{_REWARD} select event_id, round(a, 6) as shape_score, round(c, 6) as privacy_score, round(d, 6) as utility_score, round(greatest(0, least(1, (m - 0.05 / 1.05) / (1 - 0.05 / 1.05))), 6) as reward from g")
def metric_reward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    own = e.select("event_id", (F.col("value") / 100).alias("shape"), (F.col("event_id") % 100 / 100).alias("trend"), (F.col("user_id") % 100 / 100).alias("dcr"), (0.4 + F.col("event_id") % 61 / 100).alias("auc"))
    out = M.reward(own, "shape", "trend", "dcr", M.classification_utility(F.col("auc")))
    return rounded(out.select("event_id", "shape_score", "privacy_score", "utility_score", "reward"), "shape_score", "privacy_score", "utility_score", "reward")


@query("""select event_id, round(coalesce(greatest(0, least(1, 1 / (1 + exp(-4 * (1 - value / 50))))), 0), 6) as utility, round(ln(greatest(1, least(20000, value))), 6) as log_value from events""")
def regression_utility(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(M.regression_utility(F.col("value"), F.lit(50.0)), 6).alias("utility"), F.round(M.log_target(F.col("value")), 6).alias("log_value"))


@query("""select event_id, round(greatest(0, least(1, list_avg(list_filter([value / 100, (event_id % 10) / 10, case when event_id % 3 = 0 then 0.5 end], lambda x: x is not null)))), 6) as reward from events""")
def search_reward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [F.col("value") / 100, (F.col("event_id") % 10 / 10).cast("double"), F.when(F.col("event_id") % 3 == 0, F.lit(0.5))]
    return e.select("event_id", F.round(M.search_reward(parts), 6).alias("reward"))


@query("select event_type as metric, case event_type when 'rmse' then 'lower' else 'higher' end as direction from (select distinct event_type from events)")
def metric_directions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("metric")).distinct().withColumn("direction", M.direction(F.col("metric")))


@query("select event_id, value from events where value is not null order by value, event_id limit 5")
def worst_rows(spark, sf_dir):
    return M.worst(table(spark, sf_dir, "events"), "value", ["event_id"]).select("event_id", "value")


# Audits: quality labels and document lengths as binary scores

_SCORES = """s as (select 'length' as attack, l.quality as label, d.n_chars::double as score from labels l join documents d on d.doc_id = l.doc_id union all
    select 'coarse', l.quality, floor(d.n_chars / 500)::double from labels l join documents d on d.doc_id = l.doc_id union all select 'constant', quality, 1.0 from labels),
    c as (select attack, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from s group by 1, 2),
    k as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by attack) as pos, sum(n) over (partition by attack) as neg, count(*) over (partition by attack) as v from c window w as (partition by attack order by score desc))"""


def scores(spark, sf_dir):
    own = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    cells = F.array(*[F.struct(F.lit(n).alias("attack"), v.cast("double").alias("score")) for n, v in (("length", F.col("n_chars")), ("coarse", F.floor(F.col("n_chars") / 500)), ("constant", F.lit(1.0)))])
    return own.select("label", F.explode(cells).alias("x")).select("x.attack", "label", "x.score")


@query(f"""with {_SCORES}, r as (select attack, max(pos)::bigint as n_member, max(neg)::bigint as n_nonmember, max(v) > 1 and max(pos) > 0 and max(neg) > 0 as ok, sum(n * (tp - p / 2)) / (max(pos) * max(neg)) as auroc, sum(p * tp / (tp + fp)) / max(pos) as auprc,
    max(tp / pos - fp / neg) as adv, max_by(struct_pack(s := score, b := (tp / pos + 1 - fp / neg) / 2), struct_pack(a := tp / pos - fp / neg, s := score)) as b, coalesce(max(tp / pos) filter (fp / neg <= 0.01), 0) as t1, coalesce(max(tp / pos) filter (fp / neg <= 0.05), 0) as t5, coalesce(max(tp / pos) filter (fp / neg <= 0.1), 0) as t10 from k group by 1)
    select attack, n_member, n_nonmember, case when ok then round(auroc, 9) end as auroc, case when ok then round(auprc, 9) end as auprc, case when ok then round(adv, 9) end as attack_advantage, case when ok then round(b.b, 9) end as balanced_accuracy, case when ok then b.s end as threshold,
    case when ok then round(t1, 9) end as tpr_at_fpr_1pct, case when ok then round(t5, 9) end as tpr_at_fpr_5pct, case when ok then round(t10, 9) end as tpr_at_fpr_10pct from r""")
def binary_report(spark, sf_dir):
    out = A.binary_report(scores(spark, sf_dir), "label", "score")
    return rounded(out, "auroc", "auprc", "attack_advantage", "balanced_accuracy", "tpr_at_fpr_1pct", "tpr_at_fpr_5pct", "tpr_at_fpr_10pct", digits=9)


@query(f"with {_SCORES} select attack, score as threshold, round(tp / (tp + fp), 9) as precision, round(tp / pos, 9) as recall from k where pos > 0 and neg > 0")
def precision_recall(spark, sf_dir):
    return rounded(A.precision_recall(scores(spark, sf_dir), "label", "score"), "precision", "recall", digits=9)


@query(f"""with {_SCORES}, r as (select attack, sum(n * (tp - p / 2)) / (max(pos) * max(neg)) as auroc from k group by 1 having max(v) > 1) select attack, round(auroc, 9) as auroc from r order by auroc desc limit 1""")
def best_attack(spark, sf_dir):
    return rounded(A.best_attack(A.binary_report(scores(spark, sf_dir), "label", "score")).select("attack", "auroc"), "auroc", digits=9)


@query(f"with {SQL}, k as (select distinct qty, line, flag, status from pool) select row_id, case when exists (select 1 from k where k.qty = t.qty and k.line = t.line and k.flag = t.flag and k.status = t.status) then 1.0 else 0.0 end::double as score from test t")
def exact_match_attack(spark, sf_dir):
    cols = ("qty", "line", "flag", "status")
    return A.exact_match(split(spark, sf_dir, "test"), split(spark, sf_dir, "pool"), cols, "row_id")


@query(f"with {CUSTOMER_SQL} select a.c_custkey, round(-min({_L2}), 6) as score from ch a, cp b, sc group by 1")
def nearest_neighbor_attack(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    return rounded(A.nearest_neighbor(customer_role(spark, sf_dir, 6), customer_role(spark, sf_dir, 8, 9), "c_custkey", "c_custkey", J.fit_metric(train, CUSTOMER)), "score")


@query(f"""with {CUSTOMER_SQL}, s as (select a.c_custkey, {_L2} as d from ch a, cp b, sc qualify row_number() over (partition by a.c_custkey order by d) = 5), r as (select a.c_custkey, {_L2} as d from ch a, ct b, sc qualify row_number() over (partition by a.c_custkey order by d) = 5)
    select s.c_custkey, round(ln((r.d + 1e-8) / (s.d + 1e-8)), 4) as score from s join r on r.c_custkey = s.c_custkey""")
def density_ratio_attack(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    out = A.density_ratio(customer_role(spark, sf_dir, 6), customer_role(spark, sf_dir, 8, 9), train, "c_custkey", "c_custkey", "c_custkey", J.fit_metric(train, CUSTOMER))
    return rounded(out, "score", digits=4)


@query()
def release_audit(spark, sf_dir):
    rows = lambda *folds: customer_role(spark, sf_dir, *folds)
    return A.run_audit(rows(0, 1, 2), rows(6), rows(8, 9), rows(3, 4, 5), CUSTOMER, "c_custkey")[0]


@query()
def supervised_profile(spark, sf_dir):
    rows = lambda *folds: customer_role(spark, sf_dir, *folds)
    frame = A.audit_scores(rows(0, 1, 2), rows(6), rows(8, 9), rows(3, 4, 5), CUSTOMER, "c_custkey")
    return A.supervised_profile(frame, [c for c in frame.columns if c not in ("c_custkey", "label")], "c_custkey")


@query()
def shadow_attack(spark, sf_dir):
    rows = lambda *folds: customer_role(spark, sf_dir, *folds)
    target = A.audit_scores(rows(0, 1), rows(6), rows(8, 9), rows(3, 4), CUSTOMER, "c_custkey")
    own = A.audit_scores(rows(2), rows(7), rows(8), rows(5), CUSTOMER, "c_custkey")
    return A.shadow([own], target, "c_custkey")


@query()
def attribute_error_attack(spark, sf_dir):
    return A.attribute_error(split(spark, sf_dir, "test"), split(spark, sf_dir, "pool"), ("qty", "price"), ("flag", "status"), "row_id")


def scaled(spark, sf_dir):
    one = lambda df: df.select("row_id", (F.col("qty") / 50).alias("a"), (F.col("price") / 100000).alias("b"))
    # The operator's own sample: equal sizes, at most 20000 rows a side.
    return tuple(materialize(x) for x in PR.same_size(one(split(spark, sf_dir, "test")), one(split(spark, sf_dir, "pool")), "row_id", order=F.col("row_id")))


@query(f"""with {SQL}, r as (select row_id, qty / 50 as a, price / 100000 as b from test qualify row_number() over (order by row_id) <= least(20000, (select count(*) from test), (select count(*) from pool))), s as (select row_id, qty / 50 as a, price / 100000 as b from pool qualify row_number() over (order by row_id) <= least(20000, (select count(*) from test), (select count(*) from pool))), c as (select avg(a) as a, avg(b) as b from r),
    rd as (select sqrt(pow(r.a - c.a, 2) + pow(r.b - c.b, 2)) as d from r, c), sd as (select sqrt(pow(s.a - c.a, 2) + pow(s.b - c.b, 2)) as d from s, c),
    q as (select quantile_cont(d, {[i / 20 for i in range(21)]}) as q from rd)
    select i / 20 as point, round((select avg((d <= q[i + 1])::int) from sd), 9) as curve from q, unnest(range(21)) as t(i)""")
def alpha_precision_curve(spark, sf_dir):
    real, synthetic = scaled(spark, sf_dir)
    center = PR.center_of(real, ["a", "b"])
    near = PR.radii(PR.center_distances(real, "row_id", ["a", "b"], center), 21)
    return rounded(PR.share_within(PR.center_distances(synthetic, "row_id", ["a", "b"], center), near), "curve", digits=9)


_AB = f"""{SQL}, r as (select row_id, qty / 50 as a, price / 100000 as b from test qualify row_number() over (order by row_id) <= least(20000, (select count(*) from test), (select count(*) from pool))), s as (select row_id, qty / 50 as a, price / 100000 as b from pool qualify row_number() over (order by row_id) <= least(20000, (select count(*) from test), (select count(*) from pool))),
    c as (select avg(a) as a, avg(b) as b from r), e as (select avg(a) as a, avg(b) as b from s), rd as (select sqrt(pow(r.a - c.a, 2) + pow(r.b - c.b, 2)) as d from r, c), sd as (select sqrt(pow(s.a - c.a, 2) + pow(s.b - c.b, 2)) as d from s, c),
    se as (select s.row_id, sqrt(pow(s.a - e.a, 2) + pow(s.b - e.b, 2)) as d from s, e), re as (select sqrt(pow(r.a - e.a, 2) + pow(r.b - e.b, 2)) as d from r, e),
    rr as (select x.row_id, min(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) as d from r x, r y where x.row_id <> y.row_id group by 1),
    rs as (select x.row_id, min(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) as d, min_by(y.row_id, struct_pack(d := sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)), i := y.row_id)) as s_id from r x, s y group by 1),
    sr as (select x.row_id, min(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) as d, min_by(y.row_id, struct_pack(d := sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)), i := y.row_id)) as r_id from s x, r y group by 1),
    cv as (select rs.d <= rr.d as ok, se.d from rs join rr on rr.row_id = rs.row_id join se on se.row_id = rs.s_id),
    q as (select (select quantile_cont(d, {[i / 100 for i in range(101)]}) from rd) as q1, (select quantile_cont(d, {[i / 100 for i in range(101)]}) from cv) as q2, (select quantile_cont(d, {[i / 100 for i in range(101)]}) from se) as q3), g as (select i from unnest(range(101)) as t(i)),
    cu as (select 'alpha_precision' as curve, i / 100 as point, (select avg((d <= q1[i + 1])::int) from sd) as value from g, q union all select 'beta_coverage', i / 100, (select avg((ok and d <= q2[i + 1])::int) from cv) from g, q union all select 'beta_support_recall', i / 100, (select avg((d <= q3[i + 1])::int) from re) from g, q)"""


@query(f"""with {_AB}, z as (select *, lag(point) over (partition by curve order by point) as p0, lag(value) over (partition by curve order by point) as v0 from cu),
    t as (select curve, 1 - sum(abs(point - value)) / sum(point) as delta, sum((value + v0) / 2 * (point - p0)) as auc, max(value) filter (point = 0.95) as near from z group by 1)
    select 'delta_' || curve as name, round(delta, 6) as value from t union all select curve || '_auc', round(auc, 6) from t union all select curve || '_at_0.95', round(near, 6) from t
    union all select 'authenticity', round(avg((sr.d > rr.d)::int), 6) from sr join rr on rr.row_id = sr.r_id""")
def alpha_beta_scores(spark, sf_dir):
    return rounded(PR.alpha_beta(*scaled(spark, sf_dir), "row_id", ["a", "b"], 101)[1], "value")


@query(f"with {_AB} select curve, point, round(value, 9) as value from cu")
def alpha_beta_curves(spark, sf_dir):
    return rounded(PR.alpha_beta(*scaled(spark, sf_dir), "row_id", ["a", "b"], 101)[0], "value", digits=9)


# Models


@query()
def static_utility(spark, sf_dir):
    model = UT.fit(split(spark, sf_dir, "train"), LINEITEM, "classification")
    return UT.row_scores(model, split(spark, sf_dir, "pool"), LINEITEM, "classification", "row_id")


def _one_row(spark, values: dict):
    return spark.createDataFrame([(k, float(v)) for k, v in values.items() if isinstance(v, int | float) and not isinstance(v, bool)], "name string, value double")


@query()
def subset_utility(spark, sf_dir):
    return _one_row(spark, UT.subset_utility(split(spark, sf_dir, "pool"), split(spark, sf_dir, "test"), LINEITEM))


@query()
def subset_utility_boosted(spark, sf_dir):
    return _one_row(spark, UT.subset_utility(split(spark, sf_dir, "pool"), split(spark, sf_dir, "test"), LINEITEM, "xgb"))


@query()
def subset_utility_mlp(spark, sf_dir):
    return _one_row(spark, UT.subset_utility(split(spark, sf_dir, "pool"), split(spark, sf_dir, "test"), LINEITEM, "mlp"))


@query()
def regression_subset_utility(spark, sf_dir):
    roles = Roles(("qty", "price"), ("line",), ("flag", "status"), "price", "regression")
    return _one_row(spark, UT.subset_utility(split(spark, sf_dir, "pool"), split(spark, sf_dir, "test"), roles, "ridge"))


@query()
def permutation_importance(spark, sf_dir):
    test = split(spark, sf_dir, "test")
    model = UT.fit(split(spark, sf_dir, "pool"), LINEITEM, "classification")
    return _one_row(spark, dict(UT.permutation_importance(model, test, LINEITEM, "classification", "row_id")))


@query()
def model_importance(spark, sf_dir):
    return _one_row(spark, dict(UT.model_importance(UT.fit(split(spark, sf_dir, "pool"), LINEITEM, "classification", "forest"), LINEITEM)))


@query()
def dynamic_utility(spark, sf_dir):
    anchor, pool, test = (materialize(split(spark, sf_dir, x)) for x in ("holdout", "pool", "test"))
    return UT.dynamic_blocks(anchor, pool, test, LINEITEM, "row_id", 8, 3)


@query("""with d as (select l.quality as y, n_chars::double as s, (l.doc_id % 997)::double as p from labels l join documents d on d.doc_id = l.doc_id), q as (select quantile_cont(p, 1/3) as a, quantile_cont(p, 2/3) as b from d),
    t as (select case when p <= a then 'tail' when p <= b then 'middle' else 'mode' end as part, y, s from d, q), c as (select part, s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from t where y is not null group by 1, 2),
    k as (select *, sum(p) over (partition by part order by s desc) as tp from c) select part, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 9) as auroc, (sum(p) + sum(n))::bigint as n from k group by 1""")
def tercile_auc(spark, sf_dir):
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", F.col("n_chars").cast("double").alias("s"), F.pmod("doc_id", F.lit(997)).cast("double").alias("p"))
    return rounded(UT.tercile_auc(own, "p", "quality", "s"), "auroc", digits=9)


@query()
def two_sample_detection(spark, sf_dir):
    return _one_row(spark, {"c2st": UT.c2st(split(spark, sf_dir, "test"), split(spark, sf_dir, "pool"), LINEITEM, "row_id")})
