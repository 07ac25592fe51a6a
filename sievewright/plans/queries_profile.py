"""Queries over cards, validation, buckets, fidelity and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators import cards as C
from sievewright.operators import distance as J
from sievewright.operators import fidelity as D
from sievewright.operators import ranks as R
from sievewright.operators import validate as V
from sievewright.plans.roles import DIRTY_SQL, LINEITEM, SQL, Roles, dirty_pool, lineitem, split, table
from sievewright.registry import query
from sievewright.sources.files import fingerprint

COLUMNS = LINEITEM.columns
#: Edges and codes as SQL: eight quantile bins of the training rows.
_GRID = "[0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]"
EDGES_SQL = f"""
edges as (select list_sort(list_distinct(list_transform(quantile_cont(qty, {_GRID}), lambda e: round(e, 6)))) as qe,
    list_sort(list_distinct(list_transform(quantile_cont(price, {_GRID}), lambda e: round(e, 6)))) as pe from train),
legal as (select list_sort(list(distinct line)) as ll, list_sort(list(distinct flag)) as fl, list_sort(list(distinct status)) as sl from train)
"""


def codes_sql(source: str, name: str) -> str:
    return f"""{name} as (select row_id, len(list_filter(qe[2:len(qe) - 1], lambda e: e <= qty))::int as qty, len(list_filter(pe[2:len(pe) - 1], lambda e: e <= price))::int as price,
    (list_position(ll, line) - 1)::int as line, coalesce(list_position(fl, flag), 0)::int - 1 as flag, coalesce(list_position(sl, status), 0)::int - 1 as status from {source}, edges, legal)"""


SIZES_SQL = """
sizes as (select 'qty' as "column", len(qe) - 1 as n from edges union all select 'price', len(pe) - 1 from edges union all select 'line', len(ll) from legal
    union all select 'flag', len(fl) from legal union all select 'status', len(sl) from legal)
"""


def marginals_sql(codes: str, name: str) -> str:
    long = " union all ".join(f"""select '{c}' as "column", {c} as code from {codes}""" for c in COLUMNS)
    return f"""{name}_long as ({long}), {name} as (select s."column", g.code::int as code, count(l.code) as n, count(l.code) / sum(count(l.code)) over (partition by s."column") as p
    from sizes s, unnest(range(s.n)) as g(code) left join {name}_long l on l."column" = s."column" and l.code = g.code group by 1, 2)"""


#: Cards and references, of a size that the columns' buckets bound, by session and by the training table's fingerprint.
_FITTED: dict[tuple, object] = {}


def _once(spark, sf_dir, what: str, make):
    key = (spark.sparkContext.applicationId, what, fingerprint(spark, [f"{sf_dir}/lineitem.parquet"]))
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def fitted(spark, sf_dir):
    train = split(spark, sf_dir, "train")
    return train, _once(spark, sf_dir, "cards", lambda: C.fit(train, LINEITEM))


def reference(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    return train, cards, _once(spark, sf_dir, "reference", lambda: D.fit_reference(train, cards))


#: A current selection: a tenth of the candidates, by their ids' last digit; and its size, alone and with one more row.
CURRENT_SQL = "cur as (select * from pool where row_id % 10 = 3)"
HAVE, MORE = "(select count(*) from cur)", "(select count(*) + 1 from cur)"


def current(pool):
    return pool.where("row_id % 10 = 3")


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Cards


@query(f"""with {SQL}, l as (
    select 'qty' as "column", 'numerical' as kind, qty is null as gap, null::varchar as v, 0 as k from train union all select 'price', 'numerical', price is null, null, 0 from train
    union all select 'line', 'discrete_numerical', line is null, line::varchar, line from train union all select 'flag', 'categorical', flag is null, flag, 0 from train
    union all select 'status', 'categorical', status is null, status, 0 from train)
    select "column", kind, "column" = 'status' as is_target, bool_or(gap) as missing_allowed, count(distinct v) as n_legal,
    coalesce((select string_agg(v, '|' order by k, v) from (select distinct "column" as c, k, v from l where v is not null) where c = "column"), '') as legal_values from l group by "column", kind""")
def card_schema(spark, sf_dir):
    return C.schema_card(split(spark, sf_dir, "train"), LINEITEM)


@query(f"""with {SQL}, l as (select 'qty' as "column", qty as v from train union all select 'price', price from train)
    select "column", round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.05), 6) as p05,
    round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, round(quantile_cont(v, 0.95), 6) as p95 from l group by 1""")
def card_numeric_stats(spark, sf_dir):
    out = C.numeric_stats(split(spark, sf_dir, "train"), LINEITEM.numeric)
    return rounded(out, *[c for c in out.columns if c != "column"])


@query(f"""with {SQL}, {EDGES_SQL}, l as (select 'qty' as "column", qe as e from edges union all select 'price', pe from edges)
    select "column", (i - 1)::int as place, e[i] as edge from l, unnest(range(1, len(e) + 1)) as g(i)""")
def card_quantile_bins(spark, sf_dir):
    found = C.quantile_bins(split(spark, sf_dir, "train"), LINEITEM.numeric)
    return spark.createDataFrame([(c, i, e) for c, edges in found.items() for i, e in enumerate(edges)], "column string, place int, edge double")


@query(f"""with {SQL}, l as (select 'line' as "column", line::varchar as value from train union all select 'flag', flag from train union all select 'status', status from train),
    c as (select "column", value, count(*) as count from l group by all)
    select "column", value, count, round(count / sum(count) over (partition by "column"), 9) as freq, row_number() over (partition by "column" order by count desc, value)::int as place from c qualify place <= 10""")
def card_top_values(spark, sf_dir):
    return rounded(C.frequencies(split(spark, sf_dir, "train"), ("line", "flag", "status")).where("place <= 10"), "freq", digits=9)


@query(f"""with {SQL}, c as (select status, greatest(1, round_even(32.0 * count(*) / sum(count(*)) over (), 0)) as cap from train group by 1),
    r as (select t.*, cap, row_number() over (partition by t.status order by row_id) as rn from train t join c on c.status = t.status)
    select row_id, qty, price, line, flag, status from r where rn <= cap order by rn, status limit 32""")
def card_prototypes(spark, sf_dir):
    return C.prototypes(split(spark, sf_dir, "train"), "status", "row_id")


@query(f"""with {SQL} select 'qty' as "column", quantile_cont(qty, 0.5) as median from train union all select 'price', round(quantile_cont(price, 0.5), 6) from train""")
def card_medians(spark, sf_dir):
    found = C.medians(split(spark, sf_dir, "train"), LINEITEM.numeric)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "column string, median double")


@query("""select o_orderpriority, o_orderstatus, round(min(o_totalprice), 4) as min, round(quantile_cont(o_totalprice, 0.05), 4) as q05, round(quantile_cont(o_totalprice, 0.25), 4) as q25,
    round(quantile_cont(o_totalprice, 0.5), 4) as q50, round(quantile_cont(o_totalprice, 0.75), 4) as q75, round(quantile_cont(o_totalprice, 0.95), 4) as q95, round(max(o_totalprice), 4) as max,
    round(avg(o_totalprice), 4) as mean from orders group by all""")
def quantile_digest(spark, sf_dir):
    out = C.quantile_digest(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return rounded(out, *[c for c in out.columns if not c.startswith("o_")], digits=4)


@query("""select event_type, round(avg(value), 6) as value_mean, round(stddev_pop(value), 6) as value_std from events group by 1""")
def metric_mean_std(spark, sf_dir):
    return rounded(C.mean_std(table(spark, sf_dir, "events"), ["event_type"], ["value"]), "value_mean", "value_std")


@query("""select user_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*) as count from events where value is not null group by 1 order by avg(value), count desc, user_id limit 5""")
def worst_groups(spark, sf_dir):
    return rounded(C.worst_groups(table(spark, sf_dir, "events"), "user_id", "value"), "mean", "std")


@query("""with r as (select user_id % 7 as report, event_type as feature, round(sum(value), 2) as importance from events where value is not null group by all),
    k as (select *, row_number() over (partition by report order by importance desc, feature) as rank from r)
    select feature, round(avg(importance), 4) as mean, round(stddev_pop(importance), 4) as std, round(avg(rank), 6) as mean_rank from k group by 1 order by avg(importance) desc, feature limit 10""")
def importance_summary(spark, sf_dir):
    reports = table(spark, sf_dir, "events").where("value is not null").groupBy((F.col("user_id") % 7).alias("report"), F.col("event_type").alias("feature")).agg(F.round(F.sum("value"), 2).alias("importance"))
    return rounded(rounded(C.importance_summary(reports), "mean", "std", digits=4), "mean_rank")


@query("""with s as (select doc_id from documents where doc_id % 3 = 0 and n_chars > 500)
    select source, count(*) as pool_count, count(s.doc_id) as selected_count, round(count(*) / sum(count(*)) over (), 9) as pool_share, round(count(s.doc_id) / sum(count(s.doc_id)) over (), 9) as selected_share,
    round(count(s.doc_id) / sum(count(s.doc_id)) over () - count(*) / sum(count(*)) over (), 9) as gain from documents d left join s on s.doc_id = d.doc_id group by source""")
def source_contribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rounded(C.source_contribution(docs, docs.where("doc_id % 3 = 0 and n_chars > 500"), "doc_id", "source"), "pool_share", "selected_share", "gain", digits=9)


@query("""with d as (select o_orderpriority as dataset, round(avg(o_totalprice), 3) as mean, round(stddev_samp(o_totalprice), 3) as std from orders group by 1)
    select * from d union all select 'All', round(avg(mean), 3), round(stddev_samp(mean), 3) from d""")
def report_table(spark, sf_dir):
    return C.report_table(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "dataset"), "o_totalprice")


@query(f"""with {SQL} select row_id, ((row_number() over (order by price, row_id) - 1) / (count(*) over () - 1))::double as price_rank from pool""")
def rank_scale(spark, sf_dir):
    out = R.rank_scale(split(spark, sf_dir, "pool").select("row_id", "price"), "price", "row_id", "price_rank")
    return out.select("row_id", "price_rank")


@query(f"""with {SQL}, m as (select min(price) as a, max(price) as b, quantile_cont(price, 0.05) as q, quantile_cont(price, 0.95) as r from train)
    select row_id, round(case when b - a <= 1e-12 then 0 else (price - a) / (b - a) end, 9) as minmax, round(greatest(0, least(1, (price - q) / (r - q))), 9) as robust from pool, m""")
def minmax_and_robust_scale(spark, sf_dir):
    train = split(spark, sf_dir, "train")
    low, high = C.robust_limits(train, "price")
    ends = train.agg(F.min("price").alias("a"), F.max("price").alias("b")).first()
    price = F.col("price")
    minmax = F.lit(0.0) if ends.b - ends.a <= 1e-12 else (price - ends.a) / (ends.b - ends.a)
    return split(spark, sf_dir, "pool").select("row_id", F.round(minmax, 9).alias("minmax"), F.round(S.scaled(price, F.lit(low), F.lit(high)), 9).alias("robust"))


# Validation

_LIMITS = """lim as (select min(qty) as q0, max(qty) as q1, min(price) as p0, max(price) as p1 from train),
    top as (select (select flag from train group by 1 order by count(*) desc, flag limit 1) as tf, (select status from train group by 1 order by count(*) desc, status limit 1) as ts)"""
_VALID = f"""with {SQL}, {DIRTY_SQL}, {_LIMITS}, t as (select *, try_cast(trim(qty) as double) as x, try_cast(trim(price) as double) as y, try_cast(trim(line) as double) as z, trim(flag) as f, trim(status) as s from dirty, lim, top),
    n as (select *, case when z is not null then (select min_by(v, struct_pack(d := abs(v - z), i := v)) from (select distinct line::double as v from train)) end as snapped from t),
    v as (select candidate_id, least(greatest(x, q0), q1) as qty, least(greatest(y, p0), p1) as price, snapped as line,
        case when f is null or lower(f) in ('', 'na', 'nan', 'none', 'null') then tf when f in (select flag from train) then f when upper(f) in (select flag from train) then upper(f) end as flag,
        case when s is null or lower(s) in ('', 'na', 'nan', 'none', 'null') then ts when s in (select status from train) then s when upper(s) in (select status from train) then upper(s) end as status,
        x, y, z, f, s, q0, q1, p0, p1, snapped from n),
    w as (select *, case when x is null then 'invalid_numeric:qty' when y is null then 'invalid_numeric:price' when z is null then 'invalid_discrete:line' when flag is null then 'invalid_category:flag' when status is null then 'invalid_category:status' end as reason from v)"""
_ACTIONS = """case when reason is null then concat_ws(',', case when x < q0 or x > q1 then 'numeric_clip:qty' end, case when y < p0 or y > p1 then 'numeric_clip:price' end, case when snapped <> z then 'discrete_snap:line' end,
    case when f is null or lower(f) in ('', 'na', 'nan', 'none', 'null') then 'missing_fill:flag' when f not in (select flag from train) then 'category_case_normalize:flag' end, case when s is null then 'missing_fill:status' end) else '' end"""


@query(f"""{_VALID} select candidate_id, round(qty, 6) as qty, round(price, 6) as price, line, flag, status, reason, {_ACTIONS} as actions from w""")
def validate_rows(spark, sf_dir):
    _, cards = fitted(spark, sf_dir)
    out = V.validate(dirty_pool(spark, sf_dir), cards)
    return rounded(out.withColumn("actions", F.array_join("repair_actions", ",")).drop("repair_actions"), "qty", "price")


@query(f"""{_VALID}, a as (select unnest(string_split({_ACTIONS}, ',')) as name from w where reason is null)
    select 'reject' as kind, reason as name, count(*) as count from w where reason is not null group by 2 union all select 'repair', name, count(*) from a where name <> '' group by 2""")
def validation_histogram(spark, sf_dir):
    _, cards = fitted(spark, sf_dir)
    return V.histogram(V.validate(dirty_pool(spark, sf_dir), cards))


@query(f"""with {SQL}, {DIRTY_SQL} select candidate_id, case when qty is null and status is null then 'missing_required:qty,status' when qty is null then 'missing_required:qty' when status is null then 'missing_required:status' end as reason from dirty""")
def required_missing(spark, sf_dir):
    texts = C.Cards(Roles(categorical=COLUMNS))  # the dirty rows are all text, and no gap is allowed
    return V.required_missing(dirty_pool(spark, sf_dir), texts).select("candidate_id", "reason")


@query(f"""with {SQL} select min(row_id) as row_id, qty, line, flag, status from base group by qty, line, flag, status""")
def deduplicate_rows(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("row_id", "qty", "line", "flag", "status")
    return V.deduplicate(rows, ["qty", "line", "flag", "status"], "row_id")


@query(f"""with {SQL} select row_id as candidate_id, 'src' || (row_id % 3) as source_id from pool""")
def attach_source(spark, sf_dir):
    pool = split(spark, sf_dir, "pool").select(F.col("row_id").alias("candidate_id"))
    return V.attach_source(pool, pool.select("candidate_id", F.concat(F.lit("src"), F.col("candidate_id") % 3).alias("source_id")))


@query(f"""with {SQL}, n as (select count(*) as n from pool), r as (select row_id, row_number() over (order by row_id) as rn from pool)
    select row_id, case when rn <= least(200, greatest(1, n - least(50, n))) then 'current' else 'pool' end as part from r, n""")
def split_current(spark, sf_dir):
    current, rest = V.split_current(split(spark, sf_dir, "pool").select("row_id"), F.col("row_id"), 200, 50)
    return current.withColumn("part", F.lit("current")).unionAll(rest.withColumn("part", F.lit("pool")))


@query("""with l as (select 'o_orderkey' as "column", o_orderkey::varchar as v from orders union all select 'o_orderpriority', o_orderpriority from orders union all select 'o_totalprice', o_totalprice::varchar from orders union all select 'o_orderstatus', o_orderstatus from orders)
    select "column", round(avg((try_cast(v as double) is not null)::int), 9) as numeric_share, case when avg((try_cast(v as double) is not null)::int) >= 0.95 then 'numeric' else 'categorical' end as role from l where v is not null group by 1""")
def column_split(spark, sf_dir):
    return rounded(V.column_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")), "numeric_share", digits=9)


# Buckets


@query(f"""with {SQL}, {EDGES_SQL}, {codes_sql("pool", "c")} select * from c""")
def bucket_codes(spark, sf_dir):
    _, cards = fitted(spark, sf_dir)
    return D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))


@query(f"""with {SQL}, {EDGES_SQL}, {codes_sql("pool", "c")} select row_id, (case when qty < 0 or flag < 0 then -1 else qty * len(fl) + flag end)::bigint as qty_flag, (case when line < 0 or price < 0 then -1 else line * (len(pe) - 1) + price end)::bigint as line_price from c, legal, edges""")
def pair_codes(spark, sf_dir):
    _, cards = fitted(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    return codes.select("row_id", S.pair_code(F.col("qty"), F.col("flag"), cards.size("flag")).alias("qty_flag"), S.pair_code(F.col("line"), F.col("price"), cards.size("price")).alias("line_price"))


_FIT = f"{SQL}, {EDGES_SQL}, {SIZES_SQL}, {codes_sql('train', 'tc')}, {marginals_sql('tc', 'tm')}"
_POOL = f"{codes_sql('pool', 'pc')}, {marginals_sql('pc', 'pm')}"
_P = ", ".join(f"""coalesce((select p from tm where "column" = '{c}' and code = pc.{c}), 1e-12) as p_{c}""" for c in COLUMNS)


def _lookup_sql(measure: str) -> str:
    joins = " ".join(f"""left join tm m_{c} on m_{c}."column" = '{c}' and m_{c}.code = pc.{c} left join pm q_{c} on q_{c}."column" = '{c}' and q_{c}.code = pc.{c}""" for c in COLUMNS)
    return f"select pc.row_id, {measure} from pc {joins}"


@query(f"""with {_FIT}, {_POOL} {_lookup_sql("round(exp((" + " + ".join(f"ln(least(greatest(coalesce(m_{c}.p, 1e-12), 1e-12), 1))" for c in COLUMNS) + ") / 5), 9) as p_geomean")}""")
def prob_geomean(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    return codes.select("row_id", F.round(D.prob_geomean(codes, ref), 9).alias("p_geomean"))


@query(f"""with {_FIT}, {_POOL} {_lookup_sql("round((" + " + ".join(f"coalesce(least(m_{c}.p / q_{c}.p, 1), 0)" for c in COLUMNS) + ") / 5, 9) as balance")}""")
def pool_balance(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    return codes.select("row_id", F.round(D.pool_balance(codes, ref)[0], 9).alias("balance"))


@query("""with c as (select o_custkey::varchar as value, count(*) as n from orders group by 1), r as (select *, row_number() over (order by n desc, value) as rn, count(*) over () as total from c),
    t as (select *, sum(case when rn > 64 then n else 0 end) over (order by n desc, value rows between unbounded preceding and current row) - n / 2 as mid, sum(case when rn > 64 then n else 0 end) over () as mass from r)
    select value, case when total < 256 or rn <= 64 then value else '__HC_cust_TAIL_' || lpad(least(floor(mid * 16 / mass), 15)::int::varchar, 2, '0') || '__' end as code_text from t""")
def compress_categories(spark, sf_dir):
    return D.compress_categories(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cust")), "cust")


# Fidelity


@query(f"""with {_FIT} select "column", code, n, round(p, 9) as p from tm""")
def marginal_distribution(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    return rounded(D.marginals(D.encode(train, cards), cards, COLUMNS), "p", digits=9)


@query(f"""with {_FIT}, {_POOL}, s as (select tm."column", 1 - 0.5 * sum(abs(tm.p - pm.p)) as similarity from tm join pm on pm."column" = tm."column" and pm.code = tm.code group by 1)
    select "column", round(similarity, 9) as similarity from s union all select '__mean__', round(avg(similarity), 9) from s""")
def fidelity_marginal(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    own = D.column_similarity(train, split(spark, sf_dir, "pool"), cards, COLUMNS)
    return rounded(own.unionByName(own.agg(F.avg("similarity").alias("similarity")).select(F.lit("__mean__").alias("column"), "similarity")), "similarity", digits=9)


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


def _pairs_sql(codes: str, name: str) -> str:
    cells = " union all ".join(f"select '{a}' as l, '{b}' as r, {a} as a, {b} as b from {codes}" for a, b in _PAIRS)
    return f"""{name}_c as (select l, r, a, b, count(*) as n from ({cells}) where a >= 0 and b >= 0 group by all),
    {name}_p as (select *, n / sum(n) over (partition by l, r) as p from {name}_c)"""


_NMI = """nm as (select l, r, sum(p * ln(p / (pa * pb))) as mi, -sum(p * ln(pa)) as ha, -sum(p * ln(pb)) as hb
    from (select *, sum(p) over (partition by l, r, a) as pa, sum(p) over (partition by l, r, b) as pb from tp_p) group by 1, 2),
    nmi as (select l, r, case when ha <= 1e-12 or hb <= 1e-12 then 0 else greatest(0, mi / sqrt(ha * hb)) end as mi from nm)"""


@query(f"""with {_FIT}, {_pairs_sql("tc", "tp")}, {_NMI} select l as "left", r as "right", round(mi, 6) as mi from nmi""")
def pair_nmi(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    return rounded(D.pair_nmi(D.encode(train, cards), cards, COLUMNS), "mi")


_PAIR_SIM = f"""{_pairs_sql("tc", "tp")}, {_pairs_sql("pc", "pp")}, {_NMI},
    sim as (select coalesce(t.l, q.l) as l, coalesce(t.r, q.r) as r, 1 - 0.5 * sum(abs(coalesce(t.p, 0) - coalesce(q.p, 0))) as similarity from tp_p t full join pp_p q on t.l = q.l and t.r = q.r and t.a = q.a and t.b = q.b group by 1, 2)"""


@query(f"""with {_FIT}, {_POOL}, {_PAIR_SIM} select l as "left", r as "right", round(similarity, 9) as similarity from sim""")
def pair_similarity(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    return rounded(D.pair_similarity(ref, split(spark, sf_dir, "pool")).drop("mi"), "similarity", digits=9)


@query(f"""with {_FIT}, {_POOL}, {_PAIR_SIM} select round(sum(greatest(round(mi, 9), 1e-6) * similarity) / sum(greatest(round(mi, 9), 1e-6)), 6) as pair_fidelity from sim join nmi on nmi.l = sim.l and nmi.r = sim.r""")
def pair_fidelity(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    return rounded(D.pair_fidelity(D.pair_similarity(ref, split(spark, sf_dir, "pool"))), "pair_fidelity")


@query(f"""with {SQL}, {EDGES_SQL}, {SIZES_SQL}, {codes_sql("train", "tc")}, {marginals_sql("tc", "tm")}, {CURRENT_SQL}, {codes_sql("cur", "cc")}, {marginals_sql("cc", "cm")}, {codes_sql("pool", "pc")},
    b as (select tm."column", tm.code, tm.p, cm.n, 0.5 * sum(abs(cm.n / {MORE} - tm.p)) over (partition by tm."column") as rest from tm join cm on cm."column" = tm."column" and cm.code = tm.code),
    f as (select "column", code, 1 - (rest + 0.5 * (abs((n + 1) / {MORE} - p) - abs(n / {MORE} - p))) as after, greatest(0, (n + 1) / {MORE} - p) as pen from b)
    select pc.row_id, round(({" + ".join(f"f_{c}.after" for c in COLUMNS)}) / 5, 9) as after_1d, round(({" + ".join(f"f_{c}.pen" for c in COLUMNS)}) / 5, 9) as penalty_1d
    from pc {" ".join(f'''join f f_{c} on f_{c}."column" = '{c}' and f_{c}.code = pc.{c}''' for c in COLUMNS)}""")
def add_one_fidelity(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    pool = split(spark, sf_dir, "pool")
    out = D.add_one(current(pool), D.encode(pool, cards, keep=("row_id",)), ref, "row_id")
    return rounded(out.select("row_id", "after_1d", "penalty_1d"), "after_1d", "penalty_1d", digits=9)


@query(f"""with {_FIT}, {_POOL}, j as (select tm."column", 0.5 * sum(case when tm.p > 0 then tm.p * ln(tm.p / ((tm.p + pm.p) / 2)) else 0 end) + 0.5 * sum(case when pm.p > 0 then pm.p * ln(pm.p / ((tm.p + pm.p) / 2)) else 0 end) as jsd
    from tm join pm on pm."column" = tm."column" and pm.code = tm.code group by 1) select "column", round(jsd, 9) as jsd, jsd <= 0.15 as within from j""")
def jensen_shannon(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    return rounded(D.jensen_shannon(train, split(spark, sf_dir, "pool"), cards, COLUMNS), "jsd", digits=9)


@query(f"""with {_FIT}, {_POOL} select tm."column", tm.code, round(tm.p, 9) as real_p, round(pm.p, 9) as synthetic_p, round(pm.p - tm.p, 9) as diff, round(pm.p / greatest(tm.p, 1e-12), 6) as ratio
    from tm join pm on pm."column" = tm."column" and pm.code = tm.code where tm.p <= 0.125""")
def rare_inflation(spark, sf_dir):
    train, cards = fitted(spark, sf_dir)
    out = D.rare_inflation(train, split(spark, sf_dir, "pool"), cards, COLUMNS, 0.125)
    return rounded(rounded(out, "real_p", "synthetic_p", "diff", digits=9), "ratio")


@query(f"""with {SQL}, s as (select row_id from pool where row_id % 4 = 0 and qty > 10) select line, count(*) as n, count(s.row_id) as kept, round(count(s.row_id) / count(*), 9) as keep_rate from pool p left join s on s.row_id = p.row_id group by 1""")
def keep_rate(spark, sf_dir):
    pool = split(spark, sf_dir, "pool")
    return rounded(D.keep_rate(pool, pool.where("row_id % 4 = 0 and qty > 10"), "row_id", "line"), "keep_rate", digits=9)


@query(f"""with {SQL}, a as (select flag, status, count(*) / sum(count(*)) over () as real_p from train group by 1, 2), b as (select flag, status, count(*) / sum(count(*)) over () as pool_p from pool group by 1, 2)
    select b.flag, b.status, round(pool_p, 9) as pool_p, round(coalesce(real_p, 0), 9) as real_p, round(greatest(0.5, least(2, coalesce(real_p, 0) / greatest(pool_p, 1e-12))), 9) as density_weight,
    round(greatest(0, least(1, (coalesce(real_p, 0) - pool_p) / greatest(coalesce(real_p, 0), 1e-12))), 9) as coverage_gain from b left join a on a.flag = b.flag and a.status = b.status""")
def balance_mass(spark, sf_dir):
    out = D.balance_mass(split(spark, sf_dir, "train"), split(spark, sf_dir, "pool"), ["flag", "status"])
    return rounded(out, "pool_p", "real_p", "density_weight", "coverage_gain", digits=9)


@query(f"""with {SQL}, {DIRTY_SQL}, a as (select distinct 'flag' as "column", flag as v from train where flag is not null union select distinct 'status', status from train where status is not null),
    b as (select distinct 'flag' as "column", flag as v from dirty where flag is not null union select distinct 'status', status from dirty where status is not null),
    c as (select distinct "column", trim(v) as v from b), a2 as (select distinct "column", trim(v) as v from a),
    r as (select "column", round(avg(((("column", v) in (select ("column", v) from a)))::int), 9) as raw_overlap from b group by 1), s as (select "column", round(avg(((("column", v) in (select ("column", v) from a2)))::int), 9) as stripped_overlap from c group by 1)
    select r."column", raw_overlap, stripped_overlap from r join s on s."column" = r."column" """)
def category_overlap(spark, sf_dir):
    return rounded(D.category_overlap(split(spark, sf_dir, "train"), dirty_pool(spark, sf_dir), ("flag", "status")), "raw_overlap", "stripped_overlap", digits=9)


def _ks_sql(c: str) -> str:
    return f"""select 'shape' as property, '{c}' as name, 1 - max(abs(fa - fb)) as score from (select sum(sum(t)) over (order by v) / (select count(*) from train) as fa, sum(sum(1 - t)) over (order by v) / (select count(*) from pool) as fb
    from (select {c} as v, 1 as t from train union all select {c}, 0 from pool) group by v)"""


def _tv_sql(kind: str, name: str, *cols: str) -> str:
    key = " || '|' || ".join(cols)
    return f"""select '{kind}' as property, '{name}' as name, 1 - 0.5 * sum(abs(a / (select count(*) from train) - b / (select count(*) from pool))) as score from (select {key} as v, count(*) filter (t = 1) as a, count(*) filter (t = 0) as b
    from (select {", ".join(cols)}, 1 as t from train union all select {", ".join(cols)}, 0 from pool) group by 1)"""


_CORR = " union all ".join(f"select 'trend' as property, '{a},{b}' as name, 1 - abs((select corr({a}, {b}) from train) - (select corr({a}, {b}) from pool)) / 2 as score" for a, b in (("qty", "price"), ("qty", "line"), ("price", "line")))


@query(f"""with {SQL} select property, name, round(score, 9) as score from ({" union all ".join(map(_ks_sql, ("qty", "price", "line")))} union all {_tv_sql("shape", "flag", "flag")} union all {_tv_sql("shape", "status", "status")}
    union all {_tv_sql("trend", "flag,status", "flag", "status")} union all {_CORR})""")
def quality_report(spark, sf_dir):
    return rounded(D.quality_report(split(spark, sf_dir, "train"), split(spark, sf_dir, "pool"), LINEITEM), "score", digits=9)


# Distances

CUSTOMER = Roles(("c_acctbal",), (), ("c_mktsegment",), None)


def customer_role(spark, sf_dir, *folds, limit: int | None = None):
    """Customers of some residues modulo 10."""
    own = table(spark, sf_dir, "customer").where(F.pmod("c_custkey", F.lit(10)).isin(*folds)).select("c_custkey", "c_acctbal", "c_mktsegment")
    return own if limit is None else own.orderBy("c_custkey").limit(limit)


CUSTOMER_SQL = """ct as (select * from customer where c_custkey % 10 < 6), ch as (select * from customer where c_custkey % 10 = 6), cp as (select * from customer where c_custkey % 10 > 7),
    sc as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s, max(c_acctbal) - min(c_acctbal) as r from ct)"""
_L2 = "sqrt(pow((a.c_acctbal - b.c_acctbal) / s, 2) + case when a.c_mktsegment = b.c_mktsegment then 0 else 2 end)"
_L1 = "abs(a.c_acctbal - b.c_acctbal) / r + case when a.c_mktsegment = b.c_mktsegment then 0 else 2 end"


@query(f"""with {CUSTOMER_SQL} select a.c_custkey, round(min({_L2}), 6) as distance from cp a, ct b, sc group by 1""")
def nearest_l2(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    out = J.nearest(customer_role(spark, sf_dir, 8, 9), "c_custkey", train, "c_custkey", J.fit_metric(train, CUSTOMER))
    return out.select("c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""with {CUSTOMER_SQL}, d as (select a.c_custkey, b.c_custkey as neighbour, {_L2} as d from cp a, ct b, sc), k as (select *, row_number() over (partition by c_custkey order by d, neighbour)::int as place from d qualify place <= 3)
    select c_custkey, place, round(d, 6) as distance from k""")
def nearest_k_l2(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    out = J.nearest(customer_role(spark, sf_dir, 8, 9), "c_custkey", train, "c_custkey", J.fit_metric(train, CUSTOMER), 3)
    return out.select("c_custkey", "place", F.round("distance", 6).alias("distance"))


@query(f"""with {CUSTOMER_SQL}, x as (select a.c_custkey, min({_L1}) as d_real from cp a, ct b, sc group by 1), y as (select a.c_custkey, min({_L1}) as d_test from cp a, ch b, sc group by 1)
    select x.c_custkey, round(d_real, 6) as d_real, round(d_test, 6) as d_test, d_real < d_test as is_real_closer, round(d_test - d_real, 6) as margin from x join y on y.c_custkey = x.c_custkey""")
def dcr_signal(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    out = J.dcr_signal(customer_role(spark, sf_dir, 8, 9), "c_custkey", train, customer_role(spark, sf_dir, 6), J.fit_metric(train, CUSTOMER, norm=1), "c_custkey", "c_custkey")
    return rounded(out, "d_real", "d_test", "margin")


@query(f"""with {CUSTOMER_SQL}, g as (select a.c_custkey, a.c_mktsegment, b.c_custkey as n, abs(a.c_acctbal - b.c_acctbal) as d from cp a join ct b on a.c_mktsegment = b.c_mktsegment)
    select c_custkey, round(min(d) / s, 6) as distance from g, sc group by c_custkey, s""")
def nearest_in_group(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    metric = J.fit_metric(train, CUSTOMER)
    out = J.nearest(customer_role(spark, sf_dir, 8, 9), "c_custkey", train, "c_custkey", metric, group="c_mktsegment")
    return out.select("c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""with {CUSTOMER_SQL}, d as (select a.c_custkey, {_L2} as d from ct a, ct b, sc where a.c_custkey <> b.c_custkey qualify row_number() over (partition by a.c_custkey order by d) <= 10),
    o as (select c_custkey, 1 / greatest(avg(d), 1e-12) as density, min(d) as first from d group by 1)
    select c_custkey, round(density, 4) as density, round(first, 6) as first from o""")
def density_reference(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    own = J.density_reference(train, "c_custkey", J.fit_metric(train, CUSTOMER))[2]
    return own.select("c_custkey", F.round("density", 4).alias("density"), F.round("first", 6).alias("first"))


@query(f"""with {CUSTOMER_SQL}, x as (select a.c_custkey, min({_L2}) as d from cp a, ct b, sc group by 1), y as (select a.c_custkey, min({_L2}) as h from cp a, ch b, sc group by 1),
    p as (select c_mktsegment, count(*) / sum(count(*)) over () as p from ct group by 1)
    select x.c_custkey, round(ln(1 + d), 6) as privacy_v1, round(greatest(0, d / 0.01 - greatest(0, h - d)), 4) as privacy_v2, round(greatest(0, d * (1 - p) - greatest(0, h - d)), 6) as privacy_v3, round(h - d, 6) as holdout_gap
    from x join y on y.c_custkey = x.c_custkey join cp on cp.c_custkey = x.c_custkey join p on p.c_mktsegment = cp.c_mktsegment""")
def privacy_components(spark, sf_dir):
    train = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5)
    pool, metric = customer_role(spark, sf_dir, 8, 9), J.fit_metric(train, CUSTOMER)
    near = lambda other, n: J.nearest(pool, "c_custkey", other, "c_custkey", metric).select("c_custkey", F.col("distance").alias(n))
    shares = {r.c_mktsegment: r["count"] for r in train.groupBy("c_mktsegment").count().collect()}
    total = sum(shares.values())
    p = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v / total))])[F.col("c_mktsegment")]
    own = near(train, "nn_distance_train").join(near(customer_role(spark, sf_dir, 6), "nn_distance_holdout"), "c_custkey").join(pool.select("c_custkey", p.alias("p_geomean")), "c_custkey")
    out = J.privacy_components(own.withColumn("expected", F.lit(0.01)))
    return rounded(rounded(out.select("c_custkey", "privacy_v1", "privacy_v2", "privacy_v3", "holdout_gap"), "privacy_v1", "privacy_v3", "holdout_gap"), "privacy_v2", digits=4)
