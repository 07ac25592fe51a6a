"""Queries over column names, parsing, set-up of searches, look-ups and small rules that other queries don't reach."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators import labels as L
from sievewright.operators import metrics as M
from sievewright.operators import mix as X
from sievewright.operators import pareto as P
from sievewright.operators import prcurve as PR
from sievewright.operators import repair as RP
from sievewright.operators import scores as U
from sievewright.operators import select as K
from sievewright.operators import utility as UT
from sievewright.operators import validate as V
from sievewright.plans import search as G
from sievewright.plans.model_client import context, json_in, proposals_from
from sievewright.plans.queries_profile import rounded
from sievewright.plans.queries_select import OBJ_SQL, OBJECTIVES, objectives
from sievewright.plans.roles import DIRTY_SQL, LINEITEM, SQL, Roles, dirty_pool, split, table
from sievewright.plans.workspace import shared_dir
from sievewright.registry import query
from sievewright.sources import files as SRC

# Files and names


@query("select c_custkey, c_mktsegment from customer")
def normalized_names(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("  c_custkey"), F.col("c_mktsegment").alias(" c_mktsegment"))
    return SRC.normalize_names(own)


@query("select * from (values ('train', 'train.csv'), ('holdout', 'test.csv'), ('test', 'test.csv')) as t(split, file)")
def resolved_splits(spark, sf_dir):
    home = shared_dir(spark)
    for name in ("train", "test"):
        SRC.write_table(table(spark, sf_dir, "region").select("r_regionkey"), f"{home}/{name}.csv", "csv")
    return spark.createDataFrame([(k, v.rpartition("/")[2]) for k, v in SRC.resolve_splits(spark, home).items()], "split string, file string")


@query("select 'samples_0.csv' as source, 'samples_0.csv' as latest, 2::bigint as files")
def resolved_source(spark, sf_dir):
    home = shared_dir(spark)
    for name in ("other_0.csv", "samples_0.csv"):
        SRC.write_table(table(spark, sf_dir, "region").select("r_regionkey"), f"{home}/{name}", "csv")
    last = lambda path: path.rpartition("/")[2]
    return spark.createDataFrame([(last(SRC.resolve_source(spark, home)), last(SRC.latest(spark, f"{home}/samples*.csv")), len(SRC.list_files(spark, f"{home}/*.csv")))], "source string, latest string, files long")


@query("""select n_nationkey::bigint as n_nationkey, n_name, (select count(*) from nation) as reported from nation""")
def output_bundle(spark, sf_dir):
    home, own = shared_dir(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    SRC.write_outputs({"rows": own}, {"report": {"n": own.count()}}, home)
    report = spark.read.json(f"{home}/report.json").select(F.col("n").alias("reported"))
    return spark.read.parquet(f"{home}/rows").crossJoin(F.broadcast(report))  # one row


@query("select r_regionkey::bigint as id, r_name as name from region union all select 100 + r_regionkey, r_name from region")
def appended_archive(spark, sf_dir):
    home, rows = shared_dir(spark), table(spark, sf_dir, "region").collect()
    for first in (0, 100):
        G.write_archive(spark, [{"id": first + r.r_regionkey, "name": r.r_name} for r in rows], home)
    return spark.read.json(home, schema="id long, name string")


@query(f"with {SQL} select row_id, status, price from pool")
def aligned_columns(spark, sf_dir):
    own = split(spark, sf_dir, "pool").select(F.col("price").alias(" price"), F.col("row_id"), F.col("status").alias("status "))
    return V.align_columns(own, ["row_id", "status", "price"])


@query("select * from (values (0, 'o_orderkey'), (1, 'o_totalprice')) as t(place, name)")
def common_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    names = L.common_columns([orders, orders.drop("o_custkey"), orders.withColumn("extra", F.lit(1))])
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@query("select * from (values ('theta', 0, 'price'), ('theta', 1, 'flag'), ('empty', 0, 'qty'), ('empty', 1, 'price'), ('empty', 2, 'line'), ('empty', 3, 'flag')) as t(scope, place, name)")
def filtered_scope(spark, sf_dir):
    asked = {"theta": [" price", "nothing", "flag ", "price", "status"], "empty": ["status", "unknown"]}
    return spark.createDataFrame([(k, i, c) for k, v in asked.items() for i, c in enumerate(L.filter_scope(v, "status", LINEITEM.features))], "scope string, place int, name string")


@query("select * from (values ('full', 'a,b,c,d'), ('privacy', 'b,d'), ('theta', 'a')) as t(scope, names)")
def signal_columns(spark, sf_dir):
    names = {k: ",".join(RP.signal_columns(["a", "b", "c", "d"], k, ["d", "b"], ["a"])) for k in ("full", "privacy", "theta")}
    return spark.createDataFrame(list(names.items()), "scope string, names string")


# Parsing, keys and joins


@query(f"with {SQL}, {DIRTY_SQL} select candidate_id, case when isfinite(try_cast(qty as double)) then try_cast(qty as double) end as qty from dirty")
def finite_numbers(spark, sf_dir):
    return dirty_pool(spark, sf_dir).select("candidate_id", S.finite(F.col("qty")).alias("qty"))


@query("select source, weight::double as weight from (values ('a', 0.5), ('b:c', 2.0), ('d', 0.0)) as t(source, weight)")
def parsed_prior(spark, sf_dir):
    return spark.createDataFrame(list(S.parse_prior(" a:0.5, b:c : 2,d:0, ").items()), "source string, weight double")


@query("select distinct 'priority' as feature, o_orderpriority as value from orders union all select distinct 'status', o_orderstatus from orders")
def encoded_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = orders.select(F.concat(F.lit("priority="), "o_orderpriority").alias("n")).unionAll(orders.select(F.concat(F.lit("status="), "o_orderstatus"))).distinct()
    return names.select(S.encoded_feature(F.col("n")).alias("feature"), F.split_part("n", F.lit("="), F.lit(2)).alias("value"))


@query("select o_orderkey, o_orderstatus || chr(1) || coalesce(case when o_orderkey % 4 > 0 then o_orderpriority end, '__MISSING__') || chr(1) || o_custkey::varchar as k from orders")
def row_keys(spark, sf_dir):
    own = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")))
    return own.select("o_orderkey", L.row_key(["o_orderstatus", "p", "o_custkey"]).alias("k"))


@query(f"""with {SQL}, n as (select count(*) as n from test), d as (select 'status' as name, true as text, count(distinct status) as k from test union all select 'line', false, count(distinct line) from test
    union all select 'qty', false, count(distinct qty) from test union all select 'price', false, count(distinct price) from test)
    select name, case when text or k <= greatest(20, n // 100) then 'classification' else 'regression' end as task from d, n""")
def resolved_tasks(spark, sf_dir):
    own = split(spark, sf_dir, "test")
    return spark.createDataFrame([(c, UT.resolve_task(own, c)) for c in ("status", "line", "qty", "price")], "name string, task string")


@query("select n_nationkey as id, 1 as a, 0 as b from nation union all select 100 + r_regionkey, 0, r_regionkey from region")
def united_one_hot(spark, sf_dir):
    one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(1).alias("a"))
    return L.union_one_hot([one, table(spark, sf_dir, "region").select((100 + F.col("r_regionkey")).alias("id"), F.col("r_regionkey").alias("b"))]).select("id", "a", "b")


@query("select c_custkey, c_acctbal as score, 'whole' as case_name from customer where c_custkey % 3 = 0")
def all_or_no_scores(spark, sf_dir):
    """Scores are taken where every row has one, and not where one lacks."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    rows = customer.where("c_custkey % 3 = 0").select("c_custkey")
    whole = L.reuse_all_or_none(rows, customer, "c_custkey")
    lacking = L.reuse_all_or_none(rows, customer.where("c_custkey % 2 = 0"), "c_custkey")
    return (whole if lacking is None else lacking).withColumn("case_name", F.lit("whole" if lacking is None else "lacking"))


@query(f"""with {SQL}, a as (select row_id, case when line = 1 then 0.5 else qty / 50 end as u from pool where line <= 3), b as (select row_id, price / 100000 as u from pool where row_id % 2 = 0),
    x as (select p.row_id, coalesce(a.u, 0.5) as u, b.u as s from pool p left join a on a.row_id = p.row_id left join b on b.row_id = p.row_id)
    select row_id, round(case when u = 0.5 then coalesce(s, u) else u end, 9) as utility from x""")
def repair_utilities(spark, sf_dir):
    pool = split(spark, sf_dir, "pool")
    exact = pool.where("line <= 3").select("row_id", F.when(F.col("line") == 1, 0.5).otherwise(F.col("qty") / 50).alias("utility"))
    surrogate = pool.where("row_id % 2 = 0").select("row_id", (F.col("price") / 100000).alias("utility"))
    return rounded(RP.utility_scores(pool.select("row_id"), "row_id", exact, surrogate), "utility", digits=9)


# Scores and rewards


@query(f"""with {SQL}, {OBJ_SQL}, r as (select *, rank() over (partition by line order by o1) + (count(*) over (partition by line, o1) - 1) / 2 as k, count(*) over (partition by line) as n from obj)
    select row_id, round(case when n = 1 then 1 else (k - 1) / (n - 1) end * (1 + o2), 9) as utility_balanced from r""")
def balanced_utility(spark, sf_dir):
    own = objectives(spark, sf_dir).withColumn("density_weight", 1 + F.col("o2"))
    return rounded(U.balanced_utility(own, "o1", ["line"]).select("row_id", "utility_balanced"), "utility_balanced", digits=9)


@query(f"with {SQL}, {OBJ_SQL} select row_id, round(0.6 * o1 + 0.3 * o2 + 0.1 * o3, 9) as utility from obj")
def combined_utility(spark, sf_dir):
    return objectives(spark, sf_dir).select("row_id", F.round(U.combined_utility(F.col("o1"), F.col("o2"), F.col("o3")), 9).alias("utility"))


@query("""with p as (select o_orderkey, o_custkey % 7 as label, case when o_orderkey % 5 < 3 then o_custkey % 7 else (o_custkey + 1) % 7 end as prediction from orders), r as (select label, avg((label = prediction)::int) as recall from p group by 1)
    select round(avg(recall), 9) as balanced_accuracy from r""")
def balanced_accuracy(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = table(spark, sf_dir, "orders").select((c % 7).cast("double").alias("label"), F.when(k % 5 < 3, c % 7).otherwise((c + 1) % 7).cast("double").alias("prediction"))
    return spark.createDataFrame([(round(UT.balanced_accuracy(own), 9),)], "balanced_accuracy double")


@query("""with p as (select ln(1 + o_totalprice) as y, ln(1 + o_totalprice) + ((o_orderkey % 11) - 5) / 10.0 as p from orders), r as (select sqrt(avg((y - p) * (y - p))) as rmse, stddev_pop(y) as std from p)
    select round(1 - rmse / std, 6) as utility, round(rmse, 6) as rmse, round(1 - (rmse / std) * (rmse / std), 6) as r2 from r""")
def regression_quality(spark, sf_dir):
    y = F.log1p("o_totalprice")
    own = table(spark, sf_dir, "orders").select(y.alias("label"), (y + ((F.col("o_orderkey") % 11) - 5) / 10.0).alias("prediction"))
    got = UT.regression_quality(own)
    return spark.createDataFrame([tuple(round(got[k], 6) for k in ("utility", "rmse", "r2"))], "utility double, rmse double, r2 double")


@query("""select round(avg(value), 6) as "F1D", round(avg(user_id), 6) as "P" from events""")
def search_objectives(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("value", "user_id", F.lit(None).cast("double").alias("nothing"))
    return rounded(M.objectives(own, {"F1D": ("value", "user_id"), "P": ("nothing", "user_id")}), "F1D", "P")


@query("""with g as (select event_type, round(avg(value) / 100, 6) as a, round(avg((user_id % 10) / 10), 6) as b from events group by 1)
    select event_type, round(exp((ln((greatest(0, least(1, coalesce(a, 0))) + 0.05) / 1.05) + ln((greatest(0, least(1, b)) + 0.05) / 1.05)) / 2), 6) as reward from g""")
def proxy_rewards(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value") / 100, 6).alias("a"), F.round(F.avg((F.col("user_id") % 10) / 10), 6).alias("b"))
    return spark.createDataFrame([(r.event_type, round(M.proxy_reward(r.asDict(), ("a", "b")), 6)) for r in own.collect()], "event_type string, reward double")


@query("""with g as (select event_type, count(*) > 10 as rows, avg(user_id) >= 0 as users from events group by 1) select event_type, rows, users, rows and users as guard_pass from g""")
def guarded_types(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") > 10).alias("rows"), (F.avg("user_id") >= 0).alias("users")).collect()
    rows = [(r.event_type, *M.guard({"rows": r.rows, "users": r.users}).values()) for r in own]
    return spark.createDataFrame(rows, "event_type string, rows boolean, users boolean, guard_pass boolean")


# Mixing and selection


@query("""with c as (select source, count(*) as n, row_number() over (order by source) as place from documents where source is not null group by 1), w as (select *, n / sum(n) over () as share, count(*) over () as k from c),
    s as (select *, (24 - k) * share as want from w), f as (select *, row_number() over (order by want - floor(want) desc, place) as rn, (24 - k) - sum(floor(want)) over () as extra from s)
    select source, (1 + floor(want) + case when rn <= extra then 1 else 0 end)::int as units from f""")
def allocated_units(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").count().orderBy("source").collect()
    units = X.allocate_units({r.source: float(r["count"]) for r in counts}, [r.source for r in counts], 24)
    return spark.createDataFrame(units, "source string, units int")


@query("""select * from (values ('[{"multiplier":2,"source_id":"a"},{"multiplier":2,"source_id":"b"}]'), ('[{"multiplier":2,"source_id":"a"},{"multiplier":1,"source_id":"b"},{"multiplier":1,"source_id":"c"}]'),
    ('[{"multiplier":2,"source_id":"a"},{"multiplier":2,"source_id":"c"}]'), ('[{"multiplier":2,"source_id":"b"},{"multiplier":2,"source_id":"c"}]')) as t("key")""")
def diverse_pools(spark, sf_dir):
    return spark.createDataFrame([(X.canonical_key(p),) for p in X.diverse_pools(["a", "b", "c"], 4, 10)], "key string")


@query(f"""with {SQL}, a as (select count(*) as n, avg(qty) as m from test), b as (select avg(qty) as m from pool where row_id % 2 = 0), c as (select avg(qty) as m from pool where row_id % 2 = 1)
    select round(a.m - b.m, 9) as over_baseline, round(a.m - c.m, 9) as over_random, (a.m - b.m) >= 0.0 as passed from a, b, c""")
def preselect_gate(spark, sf_dir):
    mean = lambda df: {"q": float(df.agg(F.avg("qty")).first()[0])}
    pool = split(spark, sf_dir, "pool")
    got = K.preselect_gate(mean(split(spark, sf_dir, "test")), mean(pool.where("row_id % 2 = 0")), mean(pool.where("row_id % 2 = 1")), {"q": 0.0})
    return spark.createDataFrame([(round(got["delta_baseline"]["q"], 9), round(got["delta_random"]["q"], 9), got["passed"])], "over_baseline double, over_random double, passed boolean")


@query("""with f as (select o_orderpriority as name, avg(o_totalprice) as score, count(*) as n from orders group by 1) select name, round(score, 6) as score from f where n >= 0 order by score desc, name limit 1""")
def reranked_finalists(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("score"), F.count("*").alias("n")).orderBy("o_orderpriority").collect()
    finalists = [{"name": r.o_orderpriority, "score": r.score, "n": r.n, "ids": [i]} for i, r in enumerate(own)]
    best = K.rerank_finalists([*finalists, finalists[0]], {"n": 0}, "score", "none")
    return spark.createDataFrame([(best["name"], round(best["score"], 6))], "name string, score double")


@query(f"""with {SQL}, c as (select line, count(*) as n from pool group by 1), w as (select line, n, greatest(1, floor(20 * n / sum(n) over ())) as low, 20 * n / sum(n) over () as want from c)
    select sum(n)::bigint as rows, 20::bigint as caps, true as at_least_one from w""")
def stratum_caps(spark, sf_dir):
    counts = {r.line: r["count"] for r in split(spark, sf_dir, "pool").groupBy("line").count().collect()}
    caps = P.stratum_caps(counts, 20)
    return spark.createDataFrame([(sum(counts.values()), sum(caps.values()), min(caps.values()) >= 1)], "rows long, caps long, at_least_one boolean")


# The search


@query("""with n as (select unnest(range(0, 81)) as n),
    f as (select n, least(greatest(3, ceil(0.25 * n)), 8) as q, least(greatest(2, ceil(0.5 * n)), n - 1, 48) as p from n),
    w as (select n, 'col_1ds' as list, q as least, greatest(q, least(n, floor(0.45 * n + 0.5), 16)) as most from f where n > 4 union all select n, 'col_2ds', q, greatest(q, least(n, floor(0.5 * n + 0.5), 12)) from f where n > 4
        union all select n, 'col_ps', p, greatest(p, least(n - 1, ceil(0.85 * n), 64)) from f where n > 4 union all select n, 'col_1ds', 1, n from n where n between 1 and 4 union all select n, 'col_2ds', least(2, n), n from n where n between 1 and 4
        union all select n, 'col_ps', 1, greatest(1, n - 1) from n where n between 1 and 4 union all select * from (values (0, 'col_1ds', 1, 8), (0, 'col_2ds', 2, 8), (0, 'col_ps', 1, 6)))
    select n::int as n, list, least::int as least, most::int as most, false as target_inclusive from w
    union all select n::int, list, least::int, most::int, true from (select n, 'col_1ds' as list, ceil(0.5 * n) as least, n as most from n where n > 1 union all select n, 'col_2ds', ceil(0.5 * n), n from n where n > 1 union all select n, 'col_ps', greatest(1, ceil(0.8 * (n - 1))), n - 1 from n where n > 1)""")
def scope_bounds(spark, sf_dir):
    rows = [(n, name, *sizes, inclusive) for inclusive in (False, True) for n in range(2 * inclusive, 81) for name, sizes in G.bounds(n, inclusive).items()]
    return spark.createDataFrame(rows, "n int, list string, least int, most int, target_inclusive boolean")


@query("""with g as (select a, b, v, t from unnest([0.1, 0.5]) as x(a), unnest([0.0, 0.4]) as y(b), unnest(range(0, 20)) as z(v), unnest(range(0, 20)) as w(t))
    select a, b, v::int as v, t::int as t, round(a + 0.05 * b + greatest(b, 0.01) * sqrt(ln(t + 1) / (v + 1)), 9) as uct, round(a + 2 * b * sqrt(ln(greatest(t, 1) + 1)) / (1 + v), 9) as ucb from g""")
def tree_policies(spark, sf_dir):
    tree = G.Tree()
    ucb = lambda a, b, v, t: tree.ucb(G.Node("c", None, q=a, prior=b, n=v), G.Node("p", None, n=t), 2)
    rows = [(a, b, v, t, round(G.uct(a, b, v, t, b), 9), round(ucb(a, b, v, t), 9)) for a in (0.1, 0.5) for b in (0.0, 0.4) for v in range(20) for t in range(20)]
    return spark.createDataFrame(rows, "a double, b double, v int, t int, uct double, ucb double")


@query("""select node, q::double as q, q_self::double as q_self from (values ('leaf', 0.8, 0.8), ('inner', 0.65, 0.5), ('root', 0.525, 0.4), ('other', 0.3, 0.3)) as t(node, q, q_self)""")
def backed_up_tree(spark, sf_dir):
    tree = G.Tree()
    for name, parent, own in (("root", None, 0.4), ("inner", "root", 0.5), ("other", "root", 0.3), ("leaf", "inner", 0.8)):
        tree.add(G.Node(name, None, parent, q=own if name != "leaf" else 0.0, q_self=own))
    tree.backup("leaf")
    return tree.table(spark).select("node", F.round("q", 9).alias("q"), "q_self")


@query("""select * from (values (0, 'replace_1d', 'a', 'c'), (1, 'add_2d', null, 'd'), (2, 'replace_u', null, 'b')) as t(place, action, old, new)""")
def derived_actions(spark, sf_dir):
    a, b = G.Theta.make(["a", "b"], ["a"], ["c"], "a"), G.Theta.make(["b", "c"], ["a", "d"], ["c"], "b")
    actions = G.derive_actions(a, b)
    if G.apply_actions(a, actions) != b:
        raise ValueError("the edits don't lead to the other scope")
    return spark.createDataFrame([(i, x["action"], x.get("old"), x.get("new", x.get("column"))) for i, x in enumerate(actions)], "place int, action string, old string, new string")


@query("""select * from (values ('a', 'a,b,c', 'a,b,c', 'a,b,c,d'), ('b', 'a,b,e', 'b,e,f', 'b,c,e,f')) as t(col_u, col_1ds, col_2ds, col_ps)""")
def repaired_scopes(spark, sf_dir):
    columns = [*"abcdefgh", "y"]
    thetas = [G.Theta.make(["a", "nothing"], [], ["a"], "y"), G.Theta.make(["e", "b"], ["e", "f"], ["f", "e", "c"], "b")]
    fixed = [G.repair(thetas[0], columns, "y"), G.repair(thetas[1], columns, "y", priority=["b"])]
    if any(G.problems(t, columns, "y") for t in fixed):
        raise ValueError("a repaired scope isn't valid")
    return spark.createDataFrame([(t.col_u, ",".join(t.col_1ds), ",".join(t.col_2ds), ",".join(t.col_ps)) for t in fixed], "col_u string, col_1ds string, col_2ds string, col_ps string")


@query("""select * from (values ('c5', 2)) as t(best, stale)""")
def searched_scope(spark, sf_dir):
    """A search whose reward is one column's: it ends with a scope that has the column."""
    columns = [*(f"c{i}" for i in range(8)), "y"]
    start = G.repair(G.Theta.make(["c0", "c1"], ["c0", "c1"], ["c0", "c1", "c2", "c3"], "c0"), columns, "y")
    _, best = G.run_search(start, columns, "y", lambda t: {"reward": 0.5 + 0.1 * ("c5" in t.col_1ds), "weak": ["c5"], "guard_pass": True}, budget=8, proposals=2, patience=2)
    return spark.createDataFrame([("c5" if "c5" in best.theta.col_1ds else "none", 2)], "best string, stale int")


# Families, volumes and rollups


_GRID = f"""{SQL}, {OBJ_SQL}, c as (select distinct round(o1 * 20) / 20 as x, round(o2 * 20) / 20 as y, round(o3 * 20) / 20 as z from obj)"""


def _grid(spark, sf_dir):
    return objectives(spark, sf_dir).select(*[(F.round(F.col(c) * 20) / 20).alias(n) for c, n in zip(OBJECTIVES, "xyz", strict=True)]).distinct()


@query(f"""with {_GRID}, p as (select * from c where x > 0 and y > 0 and z > 0), s as (select s, s - coalesce(lag(s) over (order by s), 0) as dx from (select distinct x as s from p)),
    r as (select s, dx, y, max(z) as z from s join p on p.x >= s.s group by all), t as (select *, y - coalesce(lag(y) over w, 0) as dy, max(z) over (partition by s order by y rows between current row and unbounded following) as top from r window w as (partition by s order by y))
    select round(coalesce(sum(dx * dy * top), 0), 9) as hypervolume from t""")
def hypervolume_three_objectives(spark, sf_dir):
    return rounded(P.dominated_volume(_grid(spark, sf_dir), "x", "y", "z"), "hypervolume", digits=9)


@query(f"""with {_GRID}, a as (select x, y from c where z < 0.5), b as (select x, y from c where z >= 0.5), e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from (select * from a union all select * from b)),
    p as (select distinct (x - x0) / (x1 - x0) as x, (y - y0) / (y1 - y0) as y from a, e), f as (select distinct (x - x0) / (x1 - x0) as x, (y - y0) / (y1 - y0) as y from b, e)
    select round(avg(d), 6) as igd from (select f.x, f.y, min(sqrt(pow(f.x - p.x, 2) + pow(f.y - p.y, 2))) as d from f, p group by 1, 2)""")
def inverted_distance(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    a, b = P.normalize_family([grid.where("z < 0.5"), grid.where("z >= 0.5")], ["x", "y"])
    return spark.createDataFrame([(round(P.igd(a, b, ["x", "y"]), 6),)], "igd double")


@query(f"""with {SQL}, {OBJ_SQL}, e as (select min(o1) as a1, max(o1) as b1, min(o2) as a2, max(o2) as b2, min(o3) as a3, max(o3) as b3, min((line % 7) / 10) as a4, max((line % 7) / 10) as b4 from obj),
    m as (select row_id, (o1 - a1) / (b1 - a1) as o1, (o2 - a2) / (b2 - a2) as o2, (o3 - a3) / (b3 - a3) as o3, ((line % 7) / 10 - a4) / (b4 - a4) as o4 from obj, e),
    d as (select * from (values {", ".join(f"('{K.direction_name(w)}', {', '.join(repr(max(x / 100, 1e-6)) for x in w)})" for w in K.DIRECTIONS)}) as t(direction, f, t, p, u)),
    s as (select direction, row_id, round(o1 * (f::double / (f::double + t + p + u)) + o2 * (t::double / (f::double + t + p + u)) + o3 * (p::double / (f::double + t + p + u)) + o4 * (u::double / (f::double + t + p + u)), 12) as score from m, d)
    select direction, row_id, place::int as place from (select *, row_number() over (partition by direction order by score desc, row_id) as place from s) where place <= 50""")
def matched_direction_family(spark, sf_dir):
    own = objectives(spark, sf_dir).withColumn("o4", (F.col("line") % 7) / 10)
    return K.direction_family(own, "row_id", (*OBJECTIVES, "o4"), 50, "matched").select("direction", "row_id", "place")


@query(f"""with {SQL}, {OBJ_SQL}, s as (select * from obj where row_id % 10 = 3), a as (select row_number() over (order by o1, row_id) as rn, o1, o2 from s), b as (select row_number() over (order by o1 desc, row_id) as rn, o1, o2 from obj where row_id % 10 <> 3),
    n as (select count(*) as n, sum(o1) as s1, sum(o2) as s2 from s), g as (select a.rn, (sum(b.o1 - a.o1) over (order by a.rn) + s1) / n as o1, (sum(b.o2 - a.o2) over (order by a.rn) + s2) / n as o2 from a join b on a.rn = b.rn, n where a.rn <= 200),
    z as (select 0 as size, s1 / n as o1, s2 / n as o2 from n union all select rn, o1, o2 from g where rn in (20, 100, 200))
    select size::int as size, round(exp((ln((greatest(0, least(1, o1)) + 0.05) / 1.05) + ln((greatest(0, least(1, o2)) + 0.05) / 1.05)) / 2), 6) as reward, o2 >= 0.3 - 1e-12 as feasible, round(o1, 6) as o1, round(o2, 6) as o2 from z""")
def reward_refinement(spark, sf_dir):
    own = objectives(spark, sf_dir)
    out = K.refine_for_reward(own.where("row_id % 10 = 3"), own, "row_id", "o1", (20, 100, 200), ("o1", "o2"), {"o2": 0.3})
    return rounded(out, "reward", "o1", "o2")


@query("""with c as (select c_custkey, case when c_custkey % 6 > 0 then c_acctbal end as x, case when c_custkey % 5 > 0 then c_mktsegment end as s from customer), m as (select quantile_cont(x, 0.5) as mid from c),
    f as (select c_custkey, coalesce(x, mid) as x, coalesce(s, '__MISSING__') as s from c, m), z as (select avg(x) as m, stddev_pop(x) as d from f), k as (select list_sort(list(distinct s)) as k from f)
    select c_custkey, list_transform(list_concat([(x - m) / d], list_transform(k, lambda v: case when v = s then 1.0 else 0.0 end)), lambda v: round(v, 6))::varchar as features from f, z, k where c_custkey % 2 = 0""")
def audit_matrix(spark, sf_dir):
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 6 > 0, F.col("c_acctbal")).alias("x"), F.when(key % 5 > 0, F.col("c_mktsegment")).alias("s"))
    roles, members, others = Roles(("x",), (), ("s",)), own.where("c_custkey % 2 = 0"), own.where("c_custkey % 2 = 1")
    medians, metric = L.audit_encoder([members, others], roles)
    out = L.encoded_matrix(L.filled(members, roles, medians), metric, "c_custkey")
    return out.select("c_custkey", S.array_text("features", 6).alias("features"))


@query("""with s as (select event_type as name, avg(value) as value, count(*) as n from events where value is not null group by 1 order by avg(value), event_type limit 2), t as (select event_type || '|' || (user_id % 2)::varchar as name, avg(value) as value, count(*) as n from events where value is not null group by 1 order by avg(value), 1 limit 2),
    r as (select user_id, avg((event_type = 'click')::int) as dcr from events group by 1), l as (select 'dcr' as part, dcr as v from r union all select 'dcr_privacy', 1 - abs(dcr - 0.5) from r union all select 'balance_error', abs(dcr - 0.5) from r),
    g as (select part, min(v) as "min", avg(v) as "mean", max(v) as "max", quantile_cont(v, 0.05) as q05, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.95) as q95, count(*) as n from l group by 1)
    select part, name, round(value, 9) as value, n from (select 'shape' as part, * from s union all select 'trend', * from t union all select part, name, value, n from (unpivot g on "min", "mean", "max", q05, q50, q95 into name name value value))""")
def weak_feedback(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    own = events.where("value is not null")
    trends = own.select(F.col("event_type").alias("left"), (F.col("user_id") % 2).cast("string").alias("right"), F.col("value").alias("score"))
    reports = events.groupBy("user_id").agg(F.avg((F.col("event_type") == "click").cast("int")).alias("dcr")).withColumn("dcr_privacy", 1 - F.abs(F.col("dcr") - 0.5))
    return rounded(L.weak_feedback(own.select(F.col("event_type").alias("column"), F.col("value").alias("score")), trends, reports), "value", digits=9)


@query("select 'fine' as dataset, 10::bigint as metrics, false as failed union all select 'broken', 0, true")
def many_datasets(spark, sf_dir):
    """One dataset is evaluated, another one's files don't exist; the driver goes on."""
    one = lambda name: split(spark, sf_dir, name).select("row_id", (F.col("qty") / 50).alias("a"), (F.col("price") / 100000).alias("b"))
    out = PR.evaluate_many({"broken": lambda: (table(spark, f"{sf_dir}/nothing", "a"), one("pool")), "fine": lambda: (one("test"), one("pool"))}, "row_id", ["a", "b"], 21, 2000)
    return out.groupBy("dataset").agg(F.count("name").alias("metrics"), F.max(F.col("error").isNotNull()).alias("failed"))


@query(f"""with {SQL}, s as (select round(avg(qty) / 50, 6) as shape, round(avg((line > 3)::int), 6) as dcr from pool) select shape, dcr, round((shape + 1 - abs(dcr - 0.5)) / 2, 6) as reward, 'utility' as failed from s""")
def evaluated_selection(spark, sf_dir):
    pool = split(spark, sf_dir, "pool")
    mean = lambda column: round(float(pool.agg(F.avg(column)).first()[0]), 6)

    def broken():
        raise ValueError("no model")

    got = M.evaluate_selection({"shape": lambda: {"shape": mean(F.col("qty") / 50)}, "dcr": lambda: {"dcr": mean((F.col("line") > 3).cast("int"))}, "utility": broken})
    return spark.createDataFrame([(got["metrics"]["shape"], got["metrics"]["dcr"], round(got["reward"], 6), ",".join(got["failed"]))], "shape double, dcr double, reward double, failed string")


@query("select event_type || '_auroc' as name, round(least(1, avg(value) / 100), 6) as value from events group by event_type union all select 'audit_auroc', max(v) from (select round(least(1, avg(value) / 100), 6) as v from events group by event_type)")
def audit_projection(spark, sf_dir):
    report = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("attack")).agg(F.round(F.least(F.lit(1.0), F.avg("value") / 100), 6).alias("auroc")).withColumn("advantage", F.lit(None).cast("double"))
    return spark.createDataFrame(list(M.audit_metrics(report).items()), "name string, value double")


@query("select 'a' as leaf, 'b' as sibling, 2 as proposals")
def model_context(spark, sf_dir):
    """A proposal model's context, and the scopes read back from an answer with text around the JSON."""
    tree, theta = G.Tree(), G.Theta.make(["a"], ["a", "b"], ["c"], "a")
    for name, parent in (("root", None), ("a", "root"), ("b", "root")):
        tree.add(G.Node(name, theta, parent, q_self=0.5))
    said = json_in(context(tree.nodes["a"], tree, ["a", "b", "c", "y"], "y"))
    answer = json_in('Here: {not json} {"proposals": [%s, %s, %s]} done' % ((json.dumps(theta.as_dict()),) * 2 + (json.dumps(theta.as_dict() | {"col_u": "b"}),)))
    return spark.createDataFrame([(said["node"]["id"], said["siblings"][0]["id"], len(proposals_from(answer)))], "leaf string, sibling string, proposals int")
