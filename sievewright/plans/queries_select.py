"""Queries over scores, selection, fronts, repair, mixing, the archive and the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators import distance as J
from sievewright.operators import fidelity as D
from sievewright.operators import mix as X
from sievewright.operators import pareto as P
from sievewright.operators import repair as RP
from sievewright.operators import scores as U
from sievewright.operators import select as K
from sievewright.operators import validate as V
from sievewright.plans.queries_profile import _FIT, _PAIRS, _POOL, COLUMNS, CURRENT_SQL, CUSTOMER, CUSTOMER_SQL, HAVE, MORE, _lookup_sql, codes_sql, current, customer_role, marginals_sql, reference, rounded
from sievewright.plans.roles import SQL, lineitem, split, table
from sievewright.plans.search import final_choice, guidance
from sievewright.plans.workspace import materialize
from sievewright.registry import query
from sievewright.streaming.archive import Archive, run_chunks

#: Three objectives of the candidates in whole hundredths, so that ties and sums are exact in any engine.
OBJECTIVES = ("o1", "o2", "o3")
OBJ_SQL = """obj as (select row_id, line, status, (round(qty * 2) / 100)::double as o1, (round(price / 1100) / 100)::double as o2, ((row_id % 101) / 100.0)::double as o3 from pool)"""


def objectives(spark, sf_dir):
    return split(spark, sf_dir, "pool").select(
        "row_id", "line", "status", (F.round(F.col("qty") * 2) / 100).alias("o1"), (F.round(F.col("price") / 1100) / 100).alias("o2"), (F.pmod("row_id", F.lit(101)) / 100.0).cast("double").alias("o3")
    )


# Scores


@query(f"""with {SQL}, r as (select *, rank() over (partition by flag, status order by price) + (count(*) over (partition by flag, status, price) - 1) / 2 as k, count(*) over (partition by flag, status) as n from pool)
    select row_id, round(case when n = 1 then 1 else (k - 1) / greatest(n - 1, 1) end, 9) as price_rank from r""")
def grouped_rank(spark, sf_dir):
    out = U.grouped_rank(split(spark, sf_dir, "pool"), "price", ["flag", "status"], "price_rank")
    return out.select("row_id", F.round("price_rank", 9).alias("price_rank"))


def _ranked(name: str) -> str:
    return f"(row_number() over (order by {name}, row_id) - 1) / (count(*) over () - 1)"


_GEO = "round(exp((" + " + ".join(f"ln(least(greatest(coalesce(m_{c}.p, 1e-12), 1e-12), 1))" for c in COLUMNS) + ") / 5), 6)"
_BAL = "round((" + " + ".join(f"coalesce(least(m_{c}.p / q_{c}.p, 1), 0)" for c in COLUMNS) + ") / 5, 6)"


@query(f"""with {_FIT}, {_POOL}, s as ({_lookup_sql(f"{_GEO} as support, {_BAL} as balance")})
    select row_id, support, balance, round(0.5 * {_ranked("balance")} + 0.5 * {_ranked("support")}, 9) as mixed from s""")
def surrogate_one_dimensional(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    own = codes.select("row_id", F.round(D.prob_geomean(codes, ref), 6).alias("support"), F.round(D.pool_balance(codes, ref)[0], 6).alias("balance"))
    for c in ("balance", "support"):
        own = U.rank_scale(own, c, "row_id", f"{c}_rank")
    return own.select("row_id", "support", "balance", F.round(0.5 * F.col("balance_rank") + 0.5 * F.col("support_rank"), 9).alias("mixed"))


def _pair_tables_sql() -> str:
    cells = lambda codes: " union all ".join(f"select '{a}' as l, '{b}' as r, {a} as a, {b} as b from {codes}" for a, b in _PAIRS)
    return f"""pt as (select l, r, a, b, count(*) as n from ({cells("tc")}) group by all), pp as (select *, n / sum(n) over (partition by l, r) as p from pt),
    qt as (select l, r, a, b, count(*) as n from ({cells("pc")}) group by all), qp as (select *, n / sum(n) over (partition by l, r) as p from qt),
    both2 as (select qp.l, qp.r, qp.a, qp.b, ln(least(greatest(coalesce(pp.p, 0), 1e-12), 1)) as s, least(coalesce(pp.p, 0) / qp.p, 1) as w from qp left join pp on pp.l = qp.l and pp.r = qp.r and pp.a = qp.a and pp.b = qp.b)"""


_TWO_JOINS = " ".join(f"join both2 h_{a}_{b} on h_{a}_{b}.l = '{a}' and h_{a}_{b}.r = '{b}' and h_{a}_{b}.a = z.{a} and h_{a}_{b}.b = z.{b}" for a, b in _PAIRS)
_G9, _B9 = _GEO.replace(", 6)", ", 9)"), _BAL.replace(", 6)", ", 9)")


@query(f"""with {_FIT}, {_POOL}, {_pair_tables_sql()}, one as ({_lookup_sql(f"{_G9} as support_1d, {_B9} as balance_1d")}),
    two as (select z.row_id, round(exp(({" + ".join(f"h_{a}_{b}.s" for a, b in _PAIRS)}) / 10), 9) as support_2d, round(({" + ".join(f"h_{a}_{b}.w" for a, b in _PAIRS)}) / 10, 9) as balance_2d from pc z {_TWO_JOINS}),
    r as (select one.*, support_2d, balance_2d, {", ".join(f"(row_number() over (order by {c}, one.row_id) - 1) / (count(*) over () - 1) as {c}_rank" for c in ("balance_1d", "balance_2d", "support_1d", "support_2d"))} from one join two on two.row_id = one.row_id),
    t as (select *, 0.4 * support_1d_rank + 0.6 * support_2d_rank as tie from r)
    select row_id, balance_1d, balance_2d, support_1d, support_2d, round(0.5 * balance_1d_rank + 0.5 * balance_2d_rank, 6) as fidelity, round(tie, 6) as tiebreak, round(0.45 * balance_1d_rank + 0.45 * balance_2d_rank + 0.1 * tie, 6) as band,
    round(0.35 * balance_1d_rank + 0.35 * balance_2d_rank + 0.15 * support_1d_rank + 0.15 * support_2d_rank, 6) as safe, round(0.4 * balance_1d_rank + 0.4 * balance_2d_rank + 0.2 * tie, 6) as stage_b from t""")
def surrogates(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    out = U.surrogates(codes, ref, "row_id").select("row_id", "balance_1d", "balance_2d", "support_1d", "support_2d", "fidelity", "tiebreak", "band", "safe", "stage_b")
    return rounded(out, "fidelity", "tiebreak", "band", "safe", "stage_b")


def _add_one_sql() -> str:
    """Tables f (1-D) and g (pairs): similarity after one more row and penalty, by bucket."""
    cells = lambda codes: " union all ".join(f"select '{a}' as l, '{b}' as r, {a} as a, {b} as b from {codes}" for a, b in _PAIRS)
    return f"""{CURRENT_SQL}, {codes_sql("cur", "cc")}, {marginals_sql("cc", "cm")}, b1 as (select tm."column", tm.code, tm.p, cm.n, 0.5 * sum(abs(cm.n / {MORE} - tm.p)) over (partition by tm."column") as rest from tm join cm on cm."column" = tm."column" and cm.code = tm.code),
    f as (select "column", code, 1 - (rest + 0.5 * (abs((n + 1) / {MORE} - p) - abs(n / {MORE} - p))) as after, greatest(0, (n + 1) / {MORE} - p) as pen from b1),
    pt as (select l, r, a, b, count(*) as n from ({cells("tc")}) group by all), pp as (select *, n / sum(n) over (partition by l, r) as p from pt), pq as (select l, r, a, b, count(*) as n from ({cells("cc")}) group by all),
    nm as (select l, r, sum(p * ln(p / (pa * pb))) / sqrt(-sum(p * ln(pa)) * -sum(p * ln(pb))) as mi from (select *, sum(p) over (partition by l, r, a) as pa, sum(p) over (partition by l, r, b) as pb from pp) group by 1, 2),
    w as (select l, r, greatest(round(mi, 9), 1e-6) / sum(greatest(round(mi, 9), 1e-6)) over () as w from nm), grid as (select w.l, w.r, w.w, x.code::int as a, y.code::int as b from w join tm x on x."column" = w.l join tm y on y."column" = w.r),
    j as (select grid.*, coalesce(pp.p, 0) as p, coalesce(pq.n, 0) as n from grid left join pp on pp.l = grid.l and pp.r = grid.r and pp.a = grid.a and pp.b = grid.b left join pq on pq.l = grid.l and pq.r = grid.r and pq.a = grid.a and pq.b = grid.b),
    b2 as (select *, 0.5 * sum(abs(n / {MORE} - p)) over (partition by l, r) as rest from j), g as (select l, r, a, b, w * (1 - (rest + 0.5 * (abs((n + 1) / {MORE} - p) - abs(n / {MORE} - p)))) as after, w * greatest(0, (n + 1) / {MORE} - p) as pen from b2)"""


_ONE = " ".join(f"""join f f_{c} on f_{c}."column" = '{c}' and f_{c}.code = pc.{c}""" for c in COLUMNS)
_TWO = " ".join(f"join g g_{a}_{b} on g_{a}_{b}.l = '{a}' and g_{a}_{b}.r = '{b}' and g_{a}_{b}.a = pc.{a} and g_{a}_{b}.b = pc.{b}" for a, b in _PAIRS)


@query(f"""with {_FIT}, {codes_sql("pool", "pc")}, {_add_one_sql()}, s as (select pc.row_id, ({" + ".join(f"f_{c}.after" for c in COLUMNS)}) / 5 as a1, ({" + ".join(f"f_{c}.pen" for c in COLUMNS)}) / 5 as p1, {" + ".join(f"g_{a}_{b}.after" for a, b in _PAIRS)} as a2, {" + ".join(f"g_{a}_{b}.pen" for a, b in _PAIRS)} as p2 from pc {_ONE} {_TWO}),
    q as (select quantile_cont(a1 - p1, 0.05) as l1, quantile_cont(a1 - p1, 0.95) as h1, quantile_cont(a2 - p2, 0.05) as l2, quantile_cont(a2 - p2, 0.95) as h2 from s)
    select row_id, round(a1, 8) as after_1d, round(p1, 8) as penalty_1d, round(a2, 8) as after_2d, round(p2, 8) as penalty_2d, round(greatest(0, least(1, (a1 - p1 - l1) / (h1 - l1))), 5) as scaled_1d, round(greatest(0, least(1, (a2 - p2 - l2) / (h2 - l2))), 5) as scaled_2d from s, q""")
def exact_scores(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    pool = split(spark, sf_dir, "pool")
    out = U.exact_scores(current(pool), D.encode(pool, cards, keep=("row_id",)), ref, "row_id")
    out = out.select("row_id", "after_1d", "penalty_1d", "after_2d", "penalty_2d", "scaled_1d", "scaled_2d")
    return rounded(rounded(out, "after_1d", "penalty_1d", "after_2d", "penalty_2d", digits=8), "scaled_1d", "scaled_2d", digits=5)


@query(f"""with {SQL} select row_id, 's' || (line % 3) as source_id, round(greatest(0, least(1, (row_id % 100) / 100 * case line % 3 when 0 then 1.0 when 1 then 0.5 else 0.25 end)), 9) as u, (row_id % 100) / 100 as u_before, line % 3 < 2 as prior_matched from pool""")
def source_prior(spark, sf_dir):
    own = split(spark, sf_dir, "pool").select("row_id", F.concat(F.lit("s"), F.col("line") % 3).alias("source_id"), (F.pmod("row_id", F.lit(100)) / 100).alias("u"))
    return rounded(U.apply_source_prior(own, S.parse_prior("s0:1.0,s1:0.5"), 0.25, ["u"]), "u", digits=9)


@query("""select user_id, round(avg(value) - 0.5 * stddev_pop(value), 6) as value from events where value is not null group by 1""")
def robust_block_mean(spark, sf_dir):
    return rounded(U.robust_block_mean(table(spark, sf_dir, "events").where("value is not null"), "user_id", "value"), "value")


@query(f"""with {SQL}, a as (select row_id, qty / 100 as v from pool where row_id % 3 = 0), b as (select row_id, price / 200000 as v from pool where row_id % 2 = 0)
    select p.row_id, round(coalesce(a.v, b.v, 0.5), 9) as v from pool p left join a on a.row_id = p.row_id left join b on b.row_id = p.row_id""")
def fallback_scores(spark, sf_dir):
    pool = split(spark, sf_dir, "pool")
    a = pool.where("row_id % 3 = 0").select("row_id", (F.col("qty") / 100).alias("v"))
    b = pool.where("row_id % 2 = 0").select("row_id", (F.col("price") / 200000).alias("v"))
    return rounded(U.fallback(pool.select("row_id"), "row_id", [a, b], "v", 0.5), "v", digits=9)


# Selection


@query(f"with {SQL} select row_id from pool order by (row_id::hugeint * 7919 + 42) % 104729, row_id limit 500")
def keep_random(spark, sf_dir):
    pool = split(spark, sf_dir, "pool").select("row_id")
    key = F.expr("cast((cast(row_id as decimal(38,0)) * 7919 + 42) % 104729 as long)")
    return K.keep_random(pool, "row_id", 500, 42, key)


@query(f"with {SQL} select row_id from pool order by row_id limit 500")
def keep_first(spark, sf_dir):
    return K.keep_first(split(spark, sf_dir, "pool").select("row_id"), "row_id", 500)


@query(f"with {SQL}, {OBJ_SQL} select row_id, round(0.5 * o1 + 0.3 * o2 + 0.2 * o3, 12) as score from obj order by round(0.5 * o1 + 0.3 * o2 + 0.2 * o3, 12) desc, row_id limit 500")
def keep_scalar(spark, sf_dir):
    return K.keep_scalar(objectives(spark, sf_dir), "row_id", OBJECTIVES, (0.5, 0.3, 0.2), 500).select("row_id", "score")


@query(f"""with {SQL}, {OBJ_SQL}, i as (select max(o1) as m1, max(o2) as m2, max(o3) as m3 from obj), g as (select *, greatest(m1 - o1, m2 - o2, m3 - o3) as gap from obj, i), e as (select min(gap) as a, max(gap) as b from g),
    s as (select row_id, gap, round(0.85 * (1 - (gap - a) / (b - a)) + 0.1 * (o1 + o2 + o3) / 3 + 0.05 * o3, 12) as score from g, e) select row_id, round(gap, 9) as gap, score from s order by score desc, row_id limit 500""")
def keep_chebyshev(spark, sf_dir):
    return K.keep_chebyshev(objectives(spark, sf_dir), "row_id", OBJECTIVES, (1.0, 1.0, 1.0), 500, "o3").select("row_id", F.round("gap", 9).alias("gap"), "score")


_FAMILY = " union all ".join(f"select '{K.direction_name(w)}' as direction, row_id, {' + '.join(f'{(x / 100 or 1e-6)} / {sum(v / 100 or 1e-6 for v in w)} * {c}' for x, c in zip(w, ('o1', 'o2', 'o3', 'o4'), strict=True))} as s from o" for w in K.DIRECTIONS)


@query(f"""with {SQL}, {OBJ_SQL}, o as (select *, (line % 7) / 10 as o4 from obj), f as ({_FAMILY}), k as (select direction, row_id, round(s, 12) as score from f),
    r as (select *, row_number() over (partition by direction order by score desc, row_id)::int as place from k) select * from r where place <= 50""")
def direction_family(spark, sf_dir):
    own = objectives(spark, sf_dir).withColumn("o4", (F.col("line") % 7) / 10)
    return K.direction_family(own, "row_id", (*OBJECTIVES, "o4"), 50)


@query(f"with {SQL}, {OBJ_SQL}, p as (select distinct o1, o2 from obj) select row_id, o1, o2 from obj o where not exists (select 1 from p where p.o1 >= o.o1 and p.o2 >= o.o2 and (p.o1 > o.o1 or p.o2 > o.o2))")
def front_zero_two_objectives(spark, sf_dir):
    return P.front_zero_2d(objectives(spark, sf_dir), "o1", "o2").select("row_id", "o1", "o2")


@query(f"""with {SQL}, {OBJ_SQL}, p as (select distinct o1, o2, o3 from obj), f as (select * from p a where not exists (select 1 from p b where b.o1 >= a.o1 and b.o2 >= a.o2 and b.o3 >= a.o3 and (b.o1 > a.o1 or b.o2 > a.o2 or b.o3 > a.o3)))
    select row_id, obj.o1, obj.o2, obj.o3 from obj join f on f.o1 = obj.o1 and f.o2 = obj.o2 and f.o3 = obj.o3""")
def front_zero_three_objectives(spark, sf_dir):
    own = objectives(spark, sf_dir)
    top = P.front_zero(own.select(*OBJECTIVES).distinct(), OBJECTIVES)
    return own.join(top, list(OBJECTIVES)).select("row_id", *OBJECTIVES)


#: Coarse objectives, so that the fronts are few and SQL can peel them by recursion.
FRONTS_SQL = """cobj as (select row_id, floor(qty / 5) / 10 as c1, floor(price / 11000) / 10 as c2 from pool), cp as (select distinct c1, c2 from cobj),
    lv(c1, c2, k) as (select c1, c2, 0 from cp union select p.c1, p.c2, lv.k + 1 from cp p join lv on lv.c1 >= p.c1 and lv.c2 >= p.c2 and (lv.c1 > p.c1 or lv.c2 > p.c2)),
    fr as (select c1, c2, max(k)::int as front from lv group by 1, 2), cf as (select row_id, cobj.c1, cobj.c2, front from cobj join fr on fr.c1 = cobj.c1 and fr.c2 = cobj.c2)"""


def coarse(spark, sf_dir):
    return split(spark, sf_dir, "pool").select("row_id", (F.floor(F.col("qty") / 5) / 10).alias("c1"), (F.floor(F.col("price") / 11000) / 10).alias("c2"))


@query(f"with recursive {SQL}, {FRONTS_SQL} select row_id, front from cf")
def pareto_fronts(spark, sf_dir):
    return P.fronts(coarse(spark, sf_dir), "row_id", ("c1", "c2"))


@query(f"""with {SQL}, {OBJ_SQL}, a as (select *, lag(o1) over w1 as b1, lead(o1) over w1 as a1, min(o1) over (partition by line) as l1, max(o1) over (partition by line) as h1, lag(o2) over w2 as b2, lead(o2) over w2 as a2, min(o2) over (partition by line) as l2, max(o2) over (partition by line) as h2
    from obj window w1 as (partition by line order by o1, row_id), w2 as (partition by line order by o2, row_id))
    select row_id, case when b1 is null or a1 is null or b2 is null or a2 is null then -1 else round(case when h1 - l1 <= 1e-12 then 0 else (a1 - b1) / (h1 - l1) end + case when h2 - l2 <= 1e-12 then 0 else (a2 - b2) / (h2 - l2) end, 9) end as crowding from a""")
def crowding_distance(spark, sf_dir):
    out = P.crowding(objectives(spark, sf_dir), "row_id", ("o1", "o2"), "line")
    return out.select("row_id", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 9)).alias("crowding"))


@query(f"""with recursive {SQL}, {FRONTS_SQL}, a as (select *, lag(c1) over w1 as b1, lead(c1) over w1 as a1, min(c1) over (partition by front) as l1, max(c1) over (partition by front) as h1, lag(c2) over w2 as b2, lead(c2) over w2 as a2, min(c2) over (partition by front) as l2, max(c2) over (partition by front) as h2
    from cf window w1 as (partition by front order by c1, row_id), w2 as (partition by front order by c2, row_id)),
    k as (select row_id, front, c1, c2, case when b1 is null or a1 is null or b2 is null or a2 is null then 1e9 else round(case when h1 - l1 <= 1e-12 then 0 else (a1 - b1) / (h1 - l1) end + case when h2 - l2 <= 1e-12 then 0 else (a2 - b2) / (h2 - l2) end, 12) end as cd from a)
    select row_id, front from k order by front, cd desc, round(c1 + c2, 9) desc, c1 desc, c2 desc, row_id limit 200""")
def nsga_selection(spark, sf_dir):
    return P.nsga_select(coarse(spark, sf_dir), "row_id", ("c1", "c2"), 200).select("row_id", "front")


@query(f"""with {SQL}, {OBJ_SQL}, t as (select line, count(*) as m from train group by 1), c as (select line, count(*) as n, 300 * m / sum(m) over () as share from obj join t using (line) group by line, m),
    f as (select *, row_number() over (order by share - floor(share) desc, line::varchar) as k, 300 - sum(floor(share)) over () as extra from c), p as (select line, floor(share) + case when k <= extra then 1 else 0 end as cap from f), r as (select o.row_id, o.line, o.o1, cap, row_number() over (partition by o.line order by o1 desc, row_id) as rn from obj o join p on p.line = o.line)
    select row_id, line, o1 from r where rn <= cap""")
def stratified_reduction(spark, sf_dir):
    shares = {r.line: float(r["count"]) for r in split(spark, sf_dir, "train").groupBy("line").count().collect()}
    return P.stratified_reduce(objectives(spark, sf_dir), "line", [F.desc("o1"), F.asc("row_id")], 300, shares).select("row_id", "line", "o1")


@query(f"""with {SQL}, {OBJ_SQL}, p as (select distinct o1, o2 from obj where o1 > 0 and o2 > 0), f as (select * from p a where not exists (select 1 from p b where b.o1 >= a.o1 and b.o2 >= a.o2 and (b.o1 > a.o1 or b.o2 > a.o2)))
    select round(coalesce(sum((o1 - n) * o2), 0), 9) as hypervolume from (select o1, o2, coalesce(lead(o1) over (order by o1 desc), 0) as n from f)""")
def hypervolume(spark, sf_dir):
    return rounded(P.hypervolume_2d(objectives(spark, sf_dir), "o1", "o2"), "hypervolume", digits=9)


@query()
def quota_selection(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    return K.quota_fill(codes, ref, "row_id", 500, K.quota_targets(codes, ref, 500))


@query()
def refined_selection(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    codes = D.encode(split(spark, sf_dir, "pool"), cards, keep=("row_id",))
    own = current(codes)
    return K.refine_to_targets(own, codes, ref, "row_id", K.quota_targets(codes, ref, own.count()))


_GAPS = f"s as (select tm.\"column\", tm.code, greatest(0, cm.n / {HAVE} - tm.p) as over, greatest(0, tm.p - cm.n / {HAVE}) as short from tm join cm on cm.\"column\" = tm.\"column\" and cm.code = tm.code)"


@query(f"""with {_FIT}, {codes_sql("pool", "pc")}, {CURRENT_SQL}, {codes_sql("cur", "cc")}, {marginals_sql("cc", "cm")}, {_GAPS}
    select pc.row_id, round(({" + ".join(f"s_{c}.over" for c in COLUMNS)}) / 5, 9) as remove_1d, round(({" + ".join(f"s_{c}.short" for c in COLUMNS)}) / 5, 9) as add_1d
    from pc {" ".join(f"""join s s_{c} on s_{c}."column" = '{c}' and s_{c}.code = pc.{c}""" for c in COLUMNS)}""")
def support_scores(spark, sf_dir):
    _, cards, ref = reference(spark, sf_dir)
    pool = split(spark, sf_dir, "pool")
    scores = K.support_scores(D.encode(current(pool), cards), ref)
    codes = D.encode(pool, cards, keep=("row_id",))
    return codes.select("row_id", F.round(scores["remove_1d"], 9).alias("remove_1d"), F.round(scores["add_1d"], 9).alias("add_1d"))


@query(f"""with {SQL}, {OBJ_SQL}, s as (select * from obj where row_id % 10 = 3), a as (select *, row_number() over (partition by line, status order by o1, row_id) as rn from s),
    b as (select *, row_number() over (partition by line, status order by o1 desc, row_id) as rn from obj where row_id not in (select row_id from s))
    select a.line, a.status, a.row_id as remove_id, b.row_id as add_id, round(b.o1 - a.o1, 9) as gain from a join b on a.line = b.line and a.status = b.status and a.rn = b.rn where b.o1 > a.o1""")
def signature_swaps(spark, sf_dir):
    own = objectives(spark, sf_dir)
    return rounded(K.signature_swaps(current(own), own, ["line", "status"], "row_id", "o1"), "gain", digits=9)


@query(f"""with {SQL}, {OBJ_SQL}, s as (select row_id, o1 - 0.5 as gap, o2 from obj where row_id % 10 = 3), c as (select count(*) as n, count(*) filter (gap >= 0) as closer from s),
    k as (select n, closer, round_even(n * 0.5, 0)::bigint as want from c), free as (select row_id, o1 - 0.5 as gap, o2 from obj where row_id not in (select row_id from s)),
    m as (select closer > want as side, least(abs(closer - want), floor(n * 0.5)::bigint, (select count(*) from free, k where (free.gap >= 0) <> (closer > want))) as moves from k),
    o as (select s.row_id, row_number() over (order by o2, abs(gap) desc, s.row_id) as rn from s, m where (gap >= 0) = side), a as (select free.row_id, row_number() over (order by o2 desc, abs(gap), free.row_id) as rn from free, m where (gap >= 0) <> side)
    select row_id from s where row_id not in (select row_id from o, m where rn <= moves) union all select row_id from a, m where rn <= moves""")
def dcr_rebalance(spark, sf_dir):
    own = objectives(spark, sf_dir).select("row_id", (F.col("o1") - 0.5).alias("gap"), "o2")
    return K.dcr_rebalance(own, current(own), "row_id", "gap", "o2")[0].select("row_id")


@query(f"""with {SQL}, {OBJ_SQL}, s as (select * from obj where row_id % 10 = 3), a as (select o1, row_number() over (order by o1, row_id) as rn from s), b as (select o1, row_number() over (order by o1 desc, row_id) as rn from obj where row_id not in (select row_id from s)),
    g as (select a.rn, sum(b.o1 - a.o1) over (order by a.rn) + (select sum(o1) from s) as total from a join b on a.rn = b.rn where a.rn <= 250) select rn::int as size, round(total, 6) as total from g where rn in (10, 50, 100, 250)""")
def swap_sizes(spark, sf_dir):
    own = objectives(spark, sf_dir)
    return rounded(K.swap_sizes(current(own), own, "row_id", "o1", (10, 50, 100, 250)), "total")


@query(f"""with {SQL}, {OBJ_SQL}, g as (select * from obj where o1 - 0.9 >= 0) select row_id, o1 from g where (select count(*) from g) >= 400
    union all (select row_id, o1 from obj where (select count(*) from g) < 400 order by o1 desc, row_id limit 528)""")
def guard_band(spark, sf_dir):
    own = objectives(spark, sf_dir).withColumn("m", F.col("o1") - 0.9)
    return K.guard_band(own, "row_id", "m", 400).select("row_id", "o1")


@query(f"""with {SQL}, {OBJ_SQL}, s as (select * from obj where row_id % 10 = 3), m as (select avg(o1) as m from s), a as (select row_id, o1, row_number() over (order by o1, o2 desc, row_id) as rn from s),
    b as (select row_id, o1, row_number() over (order by o1 desc, o2 desc, row_id) as rn from obj where row_id not in (select row_id from s)), g as (select a.rn, a.row_id as r, b.row_id as n, b.o1 - a.o1 as gain from a join b on a.rn = b.rn where b.o1 > a.o1),
    k as (select *, coalesce(sum(gain) over (order by rn rows between unbounded preceding and 1 preceding), 0) as before from g), x as (select k.* from k, m where before < (0.6 - m) * (select count(*) from s) - 1e-9)
    select row_id, o1 from s where row_id not in (select r from x) union all select row_id, o1 from obj where row_id in (select n from x)""")
def floor_repair(spark, sf_dir):
    own = objectives(spark, sf_dir)
    return K.floor_repair(current(own), own, "row_id", "o1", 0.6, "o2").select("row_id", "o1")


@query()
def constrained_selection(spark, sf_dir):
    return K.constrained_subset(objectives(spark, sf_dir), "row_id", OBJECTIVES, {"o1": 0.6, "o2": 0.5}, 300).select("row_id", *OBJECTIVES)


# Repair


@query(f"""with {CUSTOMER_SQL}, e as (select a.c_custkey as remove, b.c_custkey as add, abs(a.c_acctbal - b.c_acctbal) as d from cp a join cp b on a.c_custkey % 10 = 8 and b.c_custkey % 10 = 9 and a.c_mktsegment = b.c_mktsegment)
    select remove, min_by(add, struct_pack(s := round(d, 2), a := add)) as add, round(min(d), 2) as score from e group by 1""")
def reusable_matches(spark, sf_dir):
    every = customer_role(spark, sf_dir, 8, 9).where("c_mktsegment is not null")
    own = every.where("c_acctbal is not null")
    key, metric = F.col("c_custkey"), J.Metric(("c_acctbal",), (), (0.0,), (1.0,), (), norm=1, digits=2)
    # Additions may be reused, so a removal's best edge, the nearest of its group, is the only one that can be taken.
    near = J.nearest(own.where(key % 10 == 8), "c_custkey", own.where(key % 10 == 9), "c_custkey", metric, group="c_mktsegment")
    edges = near.select(key.alias("remove"), F.col("neighbour").alias("add"), F.col("distance").alias("score"), F.lit(0.0).alias("distance"))
    # Without a balance on either side no distance is known: the smallest addition of the segment, without a score.
    found = RP.greedy_match(edges, reuse=True).select("remove", "add", "score")
    first = every.where(key % 10 == 9).groupBy("c_mktsegment").agg(F.min(key).alias("add"), F.count("c_acctbal").alias("n"))
    rest = every.where(key % 10 == 8).join(F.broadcast(first), "c_mktsegment").where("c_acctbal is null or n = 0")
    return found.unionByName(rest.select(key.alias("remove"), "add", F.lit(None).cast("double").alias("score")))


def repaired(spark, sf_dir, version: str):
    train, test = customer_role(spark, sf_dir, 0, 1, 2, 3, 4, 5), customer_role(spark, sf_dir, 6)
    metric = J.fit_metric(train, CUSTOMER, norm=1)
    pool = customer_role(spark, sf_dir, 7, 8, 9)
    signal = J.dcr_signal(pool, "c_custkey", train, test, metric, "c_custkey", "c_custkey")
    own = materialize(pool.join(signal, "c_custkey").withColumn("utility", F.pmod("c_custkey", F.lit(97)) / 97))
    selected = own.where(F.pmod("c_custkey", F.lit(10)) == 9)
    return RP.repair(own, selected.select("c_custkey"), "c_custkey", metric, RP.PLANS[version], "c_mktsegment")[0].select("c_custkey", "is_real_closer", "utility")


def _register_repairs():
    for version in RP.PLANS:
        def run(spark, sf_dir, version=version):
            return repaired(spark, sf_dir, version)

        run.__name__ = f"dcr_repair_{version}"
        query()(run)


_register_repairs()


# Mixing and sets


@query(f"""with {SQL}, d as (select s as source_id, row_id, row_number() over (partition by s order by row_id) as rn from (select *, 's' || (line % 2) as s from pool)), u as (select 's0' as source_id, 300 as rows, 0 as draw_index, 0 as start union all select 's1', 600, 1, 300)
    select d.source_id, row_id as source_row_id, draw_index, rn - 1 as draw_local_index, rn - 1 + start as pool_row_id from d join u on d.source_id = u.source_id where rn <= rows""")
def mixed_pool(spark, sf_dir):
    pool, out, start = split(spark, sf_dir, "pool").select("row_id", "line"), None, 0
    for i, (name, rows) in enumerate((("s0", 300), ("s1", 600))):
        part = X.draw(pool.where(F.col("line") % 2 == i), name, "row_id", rows, 42, i, F.col("row_id")).withColumn("pool_row_id", F.col("draw_local_index") + start)
        out = part if out is None else out.unionByName(part)
        start += rows
    return out.select("source_id", "source_row_id", "draw_index", "draw_local_index", "pool_row_id")


@query()
def mixed_pool_with_replacement(spark, sf_dir):
    pool = split(spark, sf_dir, "pool").select("row_id", "line")
    # A unit of the whole pool's size is more than either source holds.
    return X.build_pool({"a": pool.where("line <= 3"), "b": pool.where("line > 3")}, [("a", 1), ("b", 2)], pool.count(), "row_id").drop("line")


@query(f"with {SQL}, s as (select row_id from pool where line = 1) select row_id from pool where row_id not in (select row_id from s)")
def except_selected(spark, sf_dir):
    pool = split(spark, sf_dir, "pool").select("row_id", "line")
    return X.except_ids(pool, pool.where("line = 1"), "row_id").select("row_id")


@query(f"with {SQL}, s as (select row_id from pool where line = 1) select row_id, 0 as part from s union all select row_id, 1 from pool where row_id not in (select row_id from s)")
def selected_then_pool(spark, sf_dir):
    pool = split(spark, sf_dir, "pool").select("row_id", "line")
    return X.selected_then_pool(pool.where("line = 1").select("row_id"), pool.select("row_id"), "row_id")


@query(f"with {SQL} select distinct qty from train where line = 1 intersect select qty from pool where line = 7")
def common_values(spark, sf_dir):
    return X.common_values(split(spark, sf_dir, "train").where("line = 1"), split(spark, sf_dir, "pool").where("line = 7"), "qty")


@query(f"with {SQL} select flag, status, min(row_id) as row_id from base group by all")
def first_by_key(spark, sf_dir):
    return V.first_by_key(lineitem(spark, sf_dir).select("flag", "status", "row_id"), ["flag", "status"], ["row_id"])


# The archive and the search


@query()
def chunked_archive(spark, sf_dir):
    own = table(spark, sf_dir, "events").where("value is not null").select("event_id", (F.round("value") / 100).alias("o1"), (F.pmod("user_id", F.lit(100)) / 100).alias("o2"))
    archive = Archive(spark, "event_id", ("o1", "o2"), 100, own.count())
    return run_chunks(own, archive, 4096, [F.col("event_id")]).rows()


@query("""with a as (select case o_orderkey % 3 when 0 then 'final' when 1 then 'best_rollout' else 'best_artifact' end as kind, round(o_totalprice, 0) as reward, o_orderkey as id from orders)
    select kind, reward, id from a order by reward desc, case kind when 'final' then 3 when 'best_rollout' then 2 else 1 end desc, id desc limit 1""")
def theta_guidance(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "final").when(F.col("o_orderkey") % 3 == 1, "best_rollout").otherwise("best_artifact")
    return guidance(table(spark, sf_dir, "orders").select(kind.alias("kind"), F.round("o_totalprice").alias("reward"), F.col("o_orderkey").alias("id")))


@query("""with a as (select o_orderkey as id, o_orderkey % 50 = 0 as g, case when o_orderkey % 3 = 0 then o_totalprice end as e, case when o_orderkey % 2 = 0 then o_totalprice / 2 end as s, o_custkey::double as u from orders),
    t as (select *, case when g then 3 when e is not null then 2 when s is not null then 1 else 0 end as tier from a) select id, tier from t order by tier desc, coalesce(e, s, 0) desc, u desc, id desc limit 1""")
def final_choice_of_nodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return final_choice(o.select(k.alias("id"), (k % 50 == 0).alias("guard_pass"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("exact"), F.when(k % 2 == 0, F.col("o_totalprice") / 2).alias("search"), F.col("o_custkey").cast("double").alias("utility")))
