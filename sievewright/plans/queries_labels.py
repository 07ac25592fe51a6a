"""Queries over labels, theta buckets, encoders, rollups and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators import cards as C
from sievewright.operators import distance as J
from sievewright.operators import labels as L
from sievewright.plans.queries_profile import CUSTOMER, CUSTOMER_SQL, EDGES_SQL, customer_role, fitted, rounded
from sievewright.plans.roles import LINEITEM, SQL, split, table
from sievewright.plans.workspace import shared_dir
from sievewright.registry import query
from sievewright.sources import files as SRC


def _edges_sql(name: str, column: str, source: str, bins: int) -> str:
    return f"{name} as (select list_sort(list_distinct(list_transform(quantile_cont({column}, {[i / bins for i in range(bins + 1)]}), lambda e: round(e, 6)))) as e from {source})"


@query(f"""with {SQL}, {_edges_sql("g", "price", "train", 10)} select row_id, 'reg_bin_' || len(list_filter(e[2:len(e) - 1], lambda x: x <= price)) as label from pool, g""")
def regression_target_groups(spark, sf_dir):
    label = L.regression_group(split(spark, sf_dir, "train"), "price")
    return split(spark, sf_dir, "pool").select("row_id", label.alias("label"))


@query(f"""with {SQL}, {_edges_sql("g", "price", "pool", 12)} select row_id, case when row_id % 9 = 0 then '__target_missing__' else 'target_bin_' || len(list_filter(e[2:len(e) - 1], lambda x: x <= price)) end as label
    from pool, (select list_sort(list_distinct(list_transform(quantile_cont(price, {[i / 12 for i in range(13)]}), lambda e: round(e, 6)))) as e from pool where row_id % 9 <> 0)""")
def repair_target_groups(spark, sf_dir):
    own = split(spark, sf_dir, "pool").withColumn("price", F.when(F.col("row_id") % 9 != 0, F.col("price")))
    return own.select("row_id", L.target_group(own, "price", True).alias("label"))


@query(f"""with {SQL}, {EDGES_SQL} select row_id, 'bin_' || len(list_filter(qe[2:len(qe) - 1], lambda e: e <= coalesce(case when row_id % 5 > 0 then qty end, mid))) as qty_bucket, 'value_' || (list_position(ll, line) - 1) as line_bucket,
    coalesce(case when row_id % 7 > 0 then flag end, '__MISSING__') as flag_bucket from pool, edges, legal, (select quantile_cont(qty, 0.5) as mid from train)""")
def balance_buckets(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    medians = C.medians(train, ("qty",))
    own = split(spark, sf_dir, "pool").withColumn("qty", F.when(F.col("row_id") % 5 > 0, F.col("qty"))).withColumn("flag", F.when(F.col("row_id") % 7 > 0, F.col("flag")))
    return own.select("row_id", *[L.balance_bucket(cards, c, medians).alias(f"{c}_bucket") for c in ("qty", "line", "flag")])


@query("with l as (select list_sort(list(distinct o_orderpriority)) as l from orders) select o_orderkey, (list_position(l, o_orderpriority) - 1)::int as label from orders, l")
def encode_target(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", L.encode_target(orders, "o_orderpriority")[0].alias("label"))


_THETA = f"""{SQL}, {_edges_sql("ge", "price", "train", 10)}, {_edges_sql("qe", "qty", "train", 10)}, fl as (select list_sort(list(distinct flag)) as f, list_sort(list(distinct status)) as s, list_sort(list(distinct line)) as l from train),
    th as (select row_id, len(list_filter(qe.e[2:len(qe.e) - 1], lambda x: x < qty))::int as qty, len(list_filter(ge.e[2:len(ge.e) - 1], lambda x: x < price))::int as price, (list_position(l, line) - 1)::int as line, (list_position(f, flag) - 1)::int as flag, (list_position(s, status) - 1)::int as status from train, ge, qe, fl)"""


@query(f"with {_THETA} select * from th")
def theta_codes(spark, sf_dir):
    return L.theta_codes(split(spark, sf_dir, "train"), LINEITEM, LINEITEM.columns, keep=("row_id",))


_PAIRS = " union all ".join(f"select '{a}' as l, '{b}' as r, {a} as a, {b} as b from th" for i, a in enumerate(sorted(LINEITEM.columns)) for b in sorted(LINEITEM.columns)[i + 1 :])


@query(f"""with {_THETA}, c as (select l, r, a, b, count(*) as n from ({_PAIRS}) group by all), p as (select *, n / sum(n) over (partition by l, r) as p from c),
    m as (select *, sum(p) over (partition by l, r, a) as pa, sum(p) over (partition by l, r, b) as pb from p) select l as "left", r as "right", round(sum(p * ln(p / (pa * pb))) / sqrt(-sum(p * ln(pa)) * -sum(p * ln(pb))), 6) as mi from m group by 1, 2""")
def theta_pair_ranking(spark, sf_dir):
    codes = L.theta_codes(split(spark, sf_dir, "train"), LINEITEM, LINEITEM.columns)
    return rounded(L.theta_pairs(codes, LINEITEM.columns, 32), "mi")


@query(f"""with {CUSTOMER_SQL}, k as (select list_sort(list(distinct c_mktsegment)) as k from ct) select c_custkey, list_transform(list_concat([(c_acctbal - m) / s], list_transform(k, lambda x: case when x = c_mktsegment then 1.0 else 0.0 end)), lambda x: round(x, 6))::varchar as features from cp, sc, k""")
def encoded_matrix(spark, sf_dir):
    metric = J.fit_metric(customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5), CUSTOMER)
    out = L.encoded_matrix(customer_role(spark, sf_dir, 8, 9), metric, "c_custkey")
    return out.select("c_custkey", S.array_text("features", 6).alias("features"))


@query(f"""with {SQL}, a as (select row_id, qty, row_number() over (order by row_id) as rn from test), b as (select status, row_number() over (order by row_id) as rn from pool)
    select row_id, qty, b.status from a left join b on a.rn = b.rn""")
def complete_target_only(spark, sf_dir):
    real, syn = split(spark, sf_dir, "test").select("row_id", "qty", "status"), split(spark, sf_dir, "pool").select("row_id", "status")
    return L.complete_target_only(syn, real, "status", [F.col("row_id")], [F.col("row_id")]).select("row_id", "qty", "status")


@query("""with r as (select user_id, avg((event_type = 'click')::int) as real_closer_rate from events group by 1)
    select user_id % 5 as g, round(avg(real_closer_rate), 9) as real_closer_rate, round(avg(abs(real_closer_rate - 0.5)), 9) as balance_error_abs, round(avg(1 - abs(real_closer_rate - 0.5)), 9) as dcr_privacy_reward from r group by 1""")
def dcr_rollup(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "click").cast("int")).alias("real_closer_rate")).withColumn("g", F.col("user_id") % 5)
    return rounded(L.dcr_rollup(own, ["g"]), "real_closer_rate", "balance_error_abs", "dcr_privacy_reward", digits=9)


@query("""with f as (select source as source_id, doc_id % 7 as node, avg((n_chars > 1000)::int) as fraction from documents group by all) select source_id, round(avg(fraction), 9) as selected_fraction_mean, round(var_pop(fraction), 9) as selected_fraction_var from f group by 1""")
def source_fraction_summary(spark, sf_dir):
    own = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id"), (F.col("doc_id") % 7).alias("node")).agg(F.avg((F.col("n_chars") > 1000).cast("int")).alias("fraction"))
    return rounded(L.source_fraction_summary(own), "selected_fraction_mean", "selected_fraction_var", digits=9)


@query(f"""with {SQL}, v as (select 'flag' as "column", flag as value, 1 as t from train union all select 'status', status, 1 from train union all select 'flag', flag, 0 from pool union all select 'status', status, 0 from pool)
    select "column", value, bool_or(t = 1) as train, bool_or(t = 0) as pool from v where value is not null group by 1, 2""")
def value_overlap(spark, sf_dir):
    return L.value_overlap({"train": split(spark, sf_dir, "train"), "pool": split(spark, sf_dir, "pool")}, ("flag", "status"))


# Scans and sinks


@query("select c_custkey, c_acctbal, case when c_custkey % 9 = 0 then null else c_mktsegment end as c_mktsegment from customer")
def csv_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/customers"
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 9 == 0, "?").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("c_mktsegment"))
    SRC.write_table(own, path, "csv")
    return SRC.read_csv(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string")


@query("select c_custkey, c_acctbal, c_mktsegment from customer")
def jsonl_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/customers"
    SRC.write_table(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path, "json")
    return SRC.read_json(spark, path).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("select count(*)::bigint as n_rows from customer")
def count_without_parsing(spark, sf_dir):
    path = f"{shared_dir(spark)}/customers"
    SRC.write_table(table(spark, sf_dir, "customer").coalesce(1), path, "csv")
    return spark.createDataFrame([(SRC.count_rows(spark, path),)], "n_rows long")


@query(f"""with {SQL} select row_id, qty, case when row_id % 8 = 0 then 'nan' else flag end as flag from test""")
def prepared_splits(spark, sf_dir):
    own = split(spark, sf_dir, "test").withColumn("flag", F.when(F.col("row_id") % 8 != 0, F.col("flag"))).withColumn("row_id", F.col("row_id").cast("string"))
    return SRC.prepare({"test": own}, ["qty"], ["flag", "row_id"])[0]["test"].select(F.col("row_id").cast("long").alias("row_id"), "qty", "flag")


@query("select c_custkey, c_mktsegment from customer")
def shared_table_reuse(spark, sf_dir):
    home = shared_dir(spark)
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    SRC.shared_table(own, home, "customers")
    return SRC.shared_table(own.limit(0), home, "customers")
