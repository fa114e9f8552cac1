"""Joins, ranking, set algebra, nested audits, calibration, calendars, text and store queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import calendars, calibration, nested, quality, shapes, store, texts
from ..sources import panels
from .base import SUPPLIER_MONTH, USER_DAY, query, rounded, table

# --- joins -----------------------------------------------------------------------------------------------------------


@query("join_asof", """select p.event_id, p.user_id, e.event_id::varchar as error_id, e.value as error_value from (select * from events where event_type = 'purchase') p
 asof left join (select * from events where event_type = 'error') e on p.user_id = e.user_id and p.ts >= e.ts""")
def join_asof(spark, sf_dir):
    """The last error of the user before each purchase."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").cast("string").alias("error_id"), F.col("value").alias("error_value"))
    return shapes.asof(left, right, ["user_id"], "ts", "ts", ["error_id", "error_value"]).select("event_id", "user_id", "error_id", "error_value")


@query("join_left_enrich", """select o_orderkey, o_custkey, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 5) as revenue
 from orders left join customer on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by all""")
def left_enrich(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 5).alias("revenue"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey", "left").join(li, "o_orderkey", "left").select("o_orderkey", "o_custkey", "c_mktsegment", "revenue")


@query("join_sector_map", """with m as (select median(s_acctbal) as mid from supplier where s_acctbal > 0) select p.k as symbol, coalesce(n_name, 'unknown') as sector, coalesce(case when s_acctbal > 0 then s_acctbal end, mid) as market_cap
 from (select distinct l_suppkey as k from lineitem) p left join supplier on s_suppkey = k left join nation on n_nationkey = s_nationkey, m""")
def sector_map(spark, sf_dir):
    """A dimension with defaults: unknown sector, median cap."""
    s = table(spark, sf_dir, "supplier").withColumn("cap", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    mid = s.agg(F.percentile("cap", F.lit(0.5)).alias("mid"))  # one row
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol")).distinct()
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = p.join(s, p.symbol == s.s_suppkey, "left").join(n, "s_nationkey", "left").crossJoin(F.broadcast(mid))
    return out.select("symbol", F.coalesce("n_name", F.lit("unknown")).alias("sector"), F.coalesce("cap", "mid").alias("market_cap"))


_PERIOD = "select c_mktsegment as segment, o_orderpriority as priority, avg(o_totalprice) as mean_price, median(o_totalprice) as mid_price from orders join customer on o_custkey = c_custkey where {w} group by 1, 2"


@query("join_compare_periods", f"""with a as ({_PERIOD.format(w="year(o_orderdate) = 1995 and o_orderpriority < '4'")}), b as ({_PERIOD.format(w="year(o_orderdate) = 1996 and o_orderpriority > '2'")})
 select coalesce(a.segment, b.segment) as segment, coalesce(a.priority, b.priority) as priority, round(a.mean_price, 4) as mean_price_y1, round(b.mean_price, 4) as mean_price_y2, round(a.mid_price, 4) as mid_price_y1, round(b.mid_price, 4) as mid_price_y2,
 round(coalesce(b.mean_price, 0) - coalesce(a.mean_price, 0), 4) as mean_price_change, round(coalesce(b.mid_price, 0) - coalesce(a.mid_price, 0), 4) as mid_price_change from a full join b on a.segment = b.segment and a.priority = b.priority""")
def compare_periods(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    agg = lambda d: d.groupBy("segment", F.col("o_orderpriority").alias("priority")).agg(F.avg("o_totalprice").alias("mean_price"), F.percentile("o_totalprice", F.lit(0.5)).alias("mid_price"))
    a = agg(o.where("year(o_orderdate) = 1995 and o_orderpriority < '4'"))
    b = agg(o.where("year(o_orderdate) = 1996 and o_orderpriority > '2'"))
    return rounded(shapes.compare_periods(a, b, ["segment", "priority"], ["mean_price", "mid_price"], ("y1", "y2")), 4)


@query("join_semi_filter", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000) and regexp_matches(c_mktsegment, 'BUILDING|MACHINERY')")
def semi_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").rlike("BUILDING|MACHINERY"))
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("join_anti_reference", "select doc_id, case when l.doc_id is null then 'unlabelled' when toxic = 1 and quality = 1 then 'mixed' else 'ok' end as state from documents left join labels l using (doc_id)")
def anti_reference(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"), "toxic", "quality")
    state = F.when(F.col("known").isNull(), "unlabelled").when((F.col("toxic") == 1) & (F.col("quality") == 1), "mixed").otherwise("ok")
    return d.join(lab, "doc_id", "left").select("doc_id", state.alias("state"))


# Bands of account balance, in order; the first that holds a value counts.
BANDS = [(1, "debt", -1e9, 0.0), (2, "low", 0.0, 2500.0), (3, "middle", 2000.0, 6000.0), (4, "high", 5000.0, 1e9)]
_BANDS_SQL = " union all ".join(f"select {i} as pos, '{n}' as band, {a!r}::double as lo, {b!r}::double as hi" for i, n, a, b in BANDS)


@query("join_interval_first", f"with b as ({_BANDS_SQL}) select c_custkey, first(band order by pos) as band from customer left join b on c_acctbal between lo and hi group by 1")
def interval_first(spark, sf_dir):
    b = spark.createDataFrame(BANDS, "pos int, band string, lo double, hi double")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return shapes.first_interval(c, b, F.col("c_acctbal"), "lo", "hi", "pos", ["band"], ["c_custkey"])


# First month-days of a step table.
STEPS = [(105, "minor cold"), (204, "spring begins"), (306, "awakening"), (506, "summer begins"), (808, "autumn begins"), (1108, "winter begins")]


@query("join_step_lookup", "select o_orderkey, case when md >= 1108 then 'winter begins' when md >= 808 then 'autumn begins' when md >= 506 then 'summer begins' when md >= 306 then 'awakening' when md >= 204 then 'spring begins' when md >= 105 then 'minor cold' else 'major snow' end as term from (select o_orderkey, month(o_orderdate) * 100 + day(o_orderdate) as md from orders)")
def step_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    md = F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
    return o.select("o_orderkey", shapes.step(md, STEPS, "major snow").alias("term"))


@query("join_unordered_pairs", "with e as (select event_type as t, lead(event_type) over (partition by user_id order by ts, event_id) as u from events) select least(t, u) || '|' || greatest(t, u) as pair, count(*) as n from e where u is not null group by 1")
def unordered_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = e.select(F.col("event_type").alias("t"), F.lead("event_type").over(w).alias("u")).where("u is not null")
    return p.groupBy(shapes.pair_key(F.col("t"), F.col("u")).alias("pair")).agg(F.count("*").alias("n"))


# The angles that count, in order, and how far off a pair may be.
ASPECTS, ORB = [0, 60, 90, 120, 180], 6


@query("join_circular_aspects", f"""with b as (select l_orderkey as g, l_linenumber as i, max((l_extendedprice / 100) % 360) as a from lineitem group by 1, 2), a(o, angle) as (values {', '.join(f'({k}, {x})' for k, x in enumerate(ASPECTS))}),
 p as (select x.g, x.i, y.i as j, least(abs(x.a - y.a) % 360, 360 - abs(x.a - y.a) % 360) as d from b x join b y on x.g = y.g and x.i < y.i)
 select g as l_orderkey, i, j, first(angle order by o)::int as angle, round(any_value(d), 4) as distance from p join a on abs(d - angle) <= {ORB} group by g, i, j""")
def circular_aspects(spark, sf_dir):
    """Unordered pairs of an order's lines (a dozen at most) at one of five angles, within six degrees; the first angle counts."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("i")).agg(F.max((F.col("l_extendedprice") / 100) % 360).alias("a")).select("l_orderkey", F.struct("i", "a").alias("p"))
    lines = F.array_sort(F.collect_list("p"))
    pairs = F.flatten(F.transform(F.col("s"), lambda x: F.transform(F.filter(F.col("s"), lambda y: y["i"] > x["i"]), lambda y: F.struct(x["i"].alias("i"), y["i"].alias("j"), calendars.angle_between(x["a"], y["a"]).alias("d")))))
    p = b.groupBy("l_orderkey").agg(lines.alias("s")).select("l_orderkey", F.explode(pairs).alias("p")).select("l_orderkey", "p.*")
    hit = F.get(F.filter(F.array(*[F.lit(x) for x in ASPECTS]), lambda x: F.abs(F.col("d") - x) <= ORB), 0)
    return p.select("l_orderkey", "i", "j", hit.alias("angle"), F.round("d", 4).alias("distance")).where("angle is not null")


@query("join_template_grid", "select n_name, t.y as year, 'events of ' || n_name || ' in ' || t.y as text from nation, (values (1995), (1996), (1997)) t(y)")
def template_grid(spark, sf_dir):
    """Templates times parameters: both are written lists or bounded dimensions."""
    y = spark.createDataFrame([(1995,), (1996,), (1997,)], "year int")
    n = table(spark, sf_dir, "nation").select("n_name")
    return n.crossJoin(F.broadcast(y)).select("n_name", "year", F.concat(F.lit("events of "), "n_name", F.lit(" in "), F.col("year").cast("string")).alias("text"))


@query("pareto_front", """with s as (select c_custkey, c_acctbal as a, coalesce(t, 0) as t, coalesce(n, 0)::double as n from customer left join (select o_custkey, max(o_totalprice) as t, count(*) as n from orders group by 1) on o_custkey = c_custkey)
 select c_custkey, a, t, n from s x where not exists (select 1 from s y where y.a >= x.a and y.t >= x.t and y.n >= x.n and (y.a > x.a or y.t > x.t or y.n > x.n))""")
def pareto(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"), F.count("*").cast("double").alias("n"))
    s = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("a")).join(o, "c_custkey", "left").fillna(0.0, ["t", "n"])
    return shapes.pareto_front(s, ["a", "t", "n"])


@query("join_near_window", "select a.event_id, exists(select 1 from events b where b.user_id = a.user_id and b.event_type = 'error' and b.ts::date between a.ts::date - 1 and a.ts::date + 1) as near_error from events a where event_type = 'purchase'")
def near_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), (F.col("event_type") == "error").alias("err"))
    return calibration.with_window(e, ["user_id"], "day", "err", 1, "near_error").where("event_type = 'purchase'").select("event_id", "near_error")


@query("join_task_plan", """with q as (select c_mktsegment as topic, count(*) as n from customer group by 1), s as (select c_mktsegment as topic, avg(o_totalprice) as price from orders join customer on c_custkey = o_custkey group by 1),
 v as (select c_mktsegment as topic, o_orderpriority as variant, count(*) as k from orders join customer on c_custkey = o_custkey group by 1, 2), r as (select topic, variant, row_number() over (partition by topic order by k desc, variant) = 1 as chosen from v)
 select q.topic, n, round(price, 3) as price, max(case when chosen then variant end) as selected, string_agg(case when not chosen then variant end, ',' order by variant) as rejected, case when n >= 300 then 'high' when n >= 290 then 'medium' else 'low' end as priority
 from q left join s using (topic) left join r using (topic) group by all""")
def task_plan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("topic"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    q, s = c.groupBy("topic").agg(F.count("*").alias("n")), o.groupBy("topic").agg(F.round(F.avg("o_totalprice"), 3).alias("price"))
    v = o.groupBy("topic", F.col("o_orderpriority").alias("variant")).agg(F.count("*").alias("k"))
    r = v.withColumn("chosen", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("k").desc(), "variant")) == 1)
    r = r.groupBy("topic").agg(F.max(F.when(F.col("chosen"), F.col("variant"))).alias("selected"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("variant")))), ",").alias("rejected"))
    level = F.when(F.col("n") >= 300, "high").when(F.col("n") >= 290, "medium").otherwise("low")
    return q.join(s, "topic", "left").join(r, "topic", "left").withColumn("priority", level)


# --- ranking and sets ------------------------------------------------------------------------------------------------


@query("rank_top_per_group", "select n_regionkey, c_custkey, c_acctbal, row_number() over (partition by n_regionkey order by c_acctbal desc, c_custkey)::int as rank from customer join nation on n_nationkey = c_nationkey qualify rank <= 10")
def top_per_group(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal").join(n, "c_nationkey")
    return shapes.top_per_group(c, ["n_regionkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 10).select("n_regionkey", "c_custkey", "c_acctbal", "rank")


@query("rank_global", "select c_custkey, row_number() over (order by abs(c_acctbal) desc, c_custkey)::bigint as rank from customer")
def rank_global(spark, sf_dir):
    """A place over all rows, numbered piece by piece."""
    return shapes.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.abs("c_acctbal"), [F.col("c_custkey")]).select("c_custkey", F.col("rank").cast("bigint").alias("rank"))


@query("rank_extremes", "select c_mktsegment, arg_max(c_custkey, c_acctbal) as richest, arg_min(c_custkey, abs(c_acctbal)) as nearest_zero from customer group by 1")
def extremes(spark, sf_dir):
    """Of rows that tie the least key, which is what the SQL gives in one thread over rows in the order of their keys; rows
    without key or balance take no part."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    both = lambda *by: F.when(k.isNotNull() & b.isNotNull(), F.struct(*by))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max_by(k, both(b, -k)).alias("richest"), F.min_by(k, both(F.abs(b), k)).alias("nearest_zero"))


@query("distinct_keep_first", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return shapes.keep_first(e.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("union_by_name", "select doc_id as id, lang, null::varchar as role from documents union all select conv_id, null, role from conversations")
def union_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return d.unionByName(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role"), allowMissingColumns=True)


@query("set_algebra", "with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O') select k, case when k in (select k from b) and k in (select k from a) then 'both' when k in (select k from a) then 'first' else 'second' end as side from (select k from a union select k from b)")
def set_algebra(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    flags = o.where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").alias("k")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("a"), F.max((F.col("o_orderstatus") == "O").cast("int")).alias("b"))
    return flags.select("k", F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "first").otherwise("second").alias("side"))


@query("filter_sign_agreement", f"with {SUPPLIER_MONTH} select symbol, date from p where \"return\" is not null and forward_return is not null and \"return\" * forward_return >= 0")
def sign_agreement(spark, sf_dir):
    return panels.supplier_month(spark, sf_dir).where(F.col("return") * F.col("forward_return") >= 0).select("symbol", "date")


@query("cascade_first_reason", "select doc_id, case when text is null or text = '' then 'empty' when n_chars < 200 then 'short' when n_chars > 20000 then 'long' when lang <> 'en' then 'language' end as reason from documents")
def cascade(spark, sf_dir):
    rules = [(F.col("text").isNull() | (F.col("text") == ""), "empty"), (F.col("n_chars") < 200, "short"), (F.col("n_chars") > 20000, "long"), (F.col("lang") != "en", "language")]
    return table(spark, sf_dir, "documents").select("doc_id", shapes.first_reason(rules).alias("reason"))


@query("rollup_grouped", """select o_orderpriority as factor, o_orderstatus as grp, count(*) as n, round(avg(o_totalprice), 3) as mean, round(median(o_totalprice), 3) as median, round(stddev_samp(o_totalprice), 3) as std, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as universes,
 round(median(o_totalprice) - 0.1 * stddev_samp(o_totalprice), 3) as final_score from orders join customer on c_custkey = o_custkey group by 1, 2""")
def rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    g = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy(F.col("o_orderpriority").alias("factor"), F.col("o_orderstatus").alias("grp"))
    x, mid, sd = F.col("o_totalprice"), F.percentile("o_totalprice", F.lit(0.5)), F.stddev_samp("o_totalprice")
    return rounded(g.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), mid.alias("median"), sd.alias("std"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("universes"), (mid - 0.1 * sd).alias("final_score")), 3)


@query("score_composite", """with a as (select c_custkey, c_acctbal / 10000 as ic, (c_custkey % 7) / 7.0 - 0.5 as test_ic, (c_custkey % 11) / 5.0 as sharpe, (c_custkey % 5) / 10.0 as rank_ic, -((c_custkey % 9) / 10.0) as mdd, (c_custkey % 4)::double as turnover from customer)
 select c_custkey, round(0.35 * ic + 0.25 * test_ic + 0.25 * sharpe + 0.15 * rank_ic - 0.10 * greatest(0, -mdd) - 0.05 * least(turnover, 2), 9) as composite,
 round(0.35 * sharpe + 0.25 * test_ic + 0.25 * abs(ic) + 0.10 * abs(rank_ic) - 0.15 * greatest(0, -mdd) - 0.15 * least(turnover, 2), 9) as train_fitness,
 case when turnover > 2 then null else round(0.45 * test_ic + 0.30 * sharpe + 0.15 * abs(ic) - 0.05 * turnover - 0.05 * greatest(0, -mdd), 9) end as weight_fitness from a""")
def composite(spark, sf_dir):
    k = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("ic"), ((k % 7) / 7.0 - 0.5).alias("test_ic"), ((k % 11) / 5.0).alias("sharpe"), ((k % 5) / 10.0).alias("rank_ic"), (-((k % 9) / 10.0)).alias("mdd"), (k % 4).cast("double").alias("turnover"))
    c = [F.col(x) for x in ("ic", "test_ic", "sharpe", "rank_ic", "mdd", "turnover")]
    fit = quality.weight_fitness(c[1], c[2], c[0], c[5], c[4], 2.0)
    return rounded(a.select("c_custkey", quality.composite_score(*c).alias("composite"), quality.enhanced_fitness(c[0], c[3], c[2], c[1], c[4], c[5]).alias("train_fitness"), F.when(fit > float("-inf"), fit).alias("weight_fitness")), 9)


@query("history_by_generation", "select year(o_orderdate)::int as generation, round(max(o_totalprice), 2) as best, round(avg(o_totalprice), 4) as mean, first(o_orderkey order by o_totalprice desc, o_orderkey) as best_key from orders group by 1")
def history(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("generation"))
    return g.agg(F.round(F.max("o_totalprice"), 2).alias("best"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_key"))


# --- nested records --------------------------------------------------------------------------------------------------


def cases(spark, sf_dir) -> DataFrame:
    """case_id and its labels: array of (id, type, value, source)."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("source"))
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_sort(F.collect_list(item)).alias("labels"))


@query("nested_flatten", "select o_custkey as case_id, o_orderkey as id, o_orderstatus as type, o_totalprice as value from orders")
def flatten(spark, sf_dir):
    return nested.flatten(cases(spark, sf_dir), ["case_id"], "labels", ["id", "type", "value"])


@query("nested_map_flatten", "select user_id, event_type as topic, ts::date - date '2024-01-01' as day from events group by all")
def map_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day"))
    years = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set("day")).alias("days"))
    tagged = years.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "days"))).alias("tags"))
    return nested.flatten_map(tagged, ["user_id"], "tags", "topic", "day")


@query("nested_audit", """select doc_id, string_agg(f, ',' order by o) as failures, count(f) = 0 as valid from (select doc_id, unnest([1, 2, 3]) as o, unnest([case when n_chars < 300 then 'too short' end, case when lang not in ('en', 'de') then 'language' end, case when source is null or source = 'src0' then 'source' end]) as f from documents) group by 1""")
def audit(spark, sf_dir):
    rules = [(F.col("n_chars") < 300, "too short"), (~F.col("lang").isin("en", "de"), "language"), (F.col("source").isNull() | (F.col("source") == "src0"), "source")]
    out = nested.audit(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), rules)
    return out.select("doc_id", F.when(F.size("failures") > 0, F.array_join("failures", ",")).alias("failures"), "valid")


@query("nested_duplicates", "select md5(text) as key, count(*) as n from documents group by 1 having count(*) > 1")
def duplicates(spark, sf_dir):
    return nested.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("key")), "key")


@query("nested_count_map", "select source, string_agg(lang || ':' || n, ',' order by lang) as counts from (select source, lang, count(*) as n from documents group by 1, 2) group by 1")
def count_map(spark, sf_dir):
    m = nested.count_map(table(spark, sf_dir, "documents").select("source", "lang"), ["source"], "lang")
    return m.select("source", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("nested_inventory", "with o as (select doc_id as id, count(*) as n from labels where toxic = 1 group by 1) select coalesce(d.doc_id, o.id) as id, d.doc_id is not null as defined, o.id is not null as observed, coalesce(n, 0) as n from (select distinct doc_id from documents) d full join o on o.id = d.doc_id")
def inventory(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return nested.inventory(d, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id")


@query("nested_provenance", "select o_custkey as case_id, count(*) as n, count(case when o_orderkey % 5 <> 0 then 1 end) as complete, coalesce(string_agg(case when o_orderkey % 5 = 0 then o_orderkey end, ',' order by o_orderkey), '') as missing from orders group by 1")
def provenance(spark, sf_dir):
    x = F.col("labels")
    miss = F.transform(F.filter(x, lambda s: s["source"].isNull()), lambda s: s["id"].cast("string"))
    return cases(spark, sf_dir).select("case_id", F.size(x).cast("bigint").alias("n"), F.size(F.filter(x, lambda s: s["source"].isNotNull())).cast("bigint").alias("complete"), F.array_join(miss, ",").alias("missing"))


def _roles(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    extra = lab.select((F.col("doc_id") + 10_000_000).alias("doc_id")).where("doc_id % 10 = 0")
    return nested.roles(d, lab.where("doc_id % 3 <> 0").select("doc_id").unionByName(extra), lab.where("doc_id % 4 = 0").select("doc_id"), "doc_id")


_ROLES = """t as (select doc_id from labels where doc_id % 3 <> 0 union select doc_id + 10000000 from labels where (doc_id + 10000000) % 10 = 0), h as (select doc_id from labels where doc_id % 4 = 0),
 r as (select id as doc_id, case when h.doc_id is not null then 'holdout' when t.doc_id is not null then 'train' else 'unassigned' end as role, t.doc_id is not null and h.doc_id is not null as overlap, d.doc_id is null as unknown
 from (select doc_id as id from documents union select doc_id from t union select doc_id from h) i left join t on t.doc_id = id left join h on h.doc_id = id left join documents d on d.doc_id = id)"""


@query("nested_split_roles", f"with {_ROLES} select * from r")
def split_roles(spark, sf_dir):
    return _roles(spark, sf_dir)


@query("nested_split_coverage", f"with {_ROLES}, c as (select count(*) filter (role <> 'unassigned' and not unknown) as assigned, count(*) filter (role = 'unassigned' and not unknown) as unassigned, count(*) filter (unknown) as unknown, count(*) filter (overlap) as overlap from r) select *, unassigned = 0 and unknown = 0 and overlap = 0 as complete from c")
def split_coverage(spark, sf_dir):
    return nested.coverage(_roles(spark, sf_dir))


@query("nested_gates", "with g as (select bool_and(n_chars > 0) as nonempty, bool_and(lang in ('en', 'de', 'fr', 'es')) as languages, bool_and(source is not null) as sources, bool_and(n_chars < 1000) as bounded from documents) select *, nonempty and languages and sources and bounded as accepted from g")
def gates(spark, sf_dir):
    return nested.gates(table(spark, sf_dir, "documents"), {"nonempty": F.col("n_chars") > 0, "languages": F.col("lang").isin("en", "de", "fr", "es"), "sources": F.col("source").isNotNull(), "bounded": F.col("n_chars") < 1000})


@query("nested_fingerprint", """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as fingerprint, substr(sha256(n_name), 1, 16) as short_id from nation""")
def fingerprint(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", nested.fingerprint(["n_nationkey", "n_name", "n_regionkey"]).alias("fingerprint"), nested.short_id(F.col("n_name")).alias("short_id"))


def chained_events(spark, sf_dir) -> DataFrame:
    """All events of each user as a chained log (previous, hash), every 97th payload changed afterwards."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").cast("string").alias("payload"))
    return nested.link(e, ["user_id"], "event_id", "payload").withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))


@query("nested_hash_chain", "select user_id, count(*) as rows, count(*) filter (event_id % 97 = 0) as broken from events group by 1")
def hash_chain(spark, sf_dir):
    """The whole log of each user is chained and verified; a changed payload breaks its own entry alone, as the entries
    behind it hold the hash that was stored."""
    c = nested.chain(chained_events(spark, sf_dir), ["user_id"], "event_id", F.col("payload"), "previous", "hash")
    return c.groupBy("user_id").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("ok"), 1)).alias("broken"))


@query("nested_json_bindings", "select event_id, (props->>'k')::int as k, (event_id % 40 + 1980)::int as year from events where event_id % 3 <> 0")
def json_bindings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    date = F.when(F.col("event_id") % 3 != 0, F.concat((F.col("event_id") % 40 + 1980).cast("string"), F.lit("-05-01"))).otherwise("unknown")
    value = lambda c: F.struct(c.cast("string").alias("value"))
    one = F.struct(value(F.col("event_id")).alias("event"), value(F.get_json_object("props", "$.k")).alias("k"), value(date).alias("date"))
    doc = e.select(F.to_json(F.struct(F.struct(F.array(one).alias("bindings")).alias("results"))).alias("json"))
    return nested.bindings(doc, "json", ["event", "k"]).select(F.col("event").cast("bigint").alias("event_id"), F.col("k").cast("int").alias("k"), "year")


@query("nested_unpivot", "unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name topic value value")
def unpivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return nested.unpivot(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("nested_identifiers", "select p_partkey, trim(lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '_', 'g')), '_') as ident from part")
def identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.identifier(F.col("p_name")).alias("ident"))


# --- calibration -----------------------------------------------------------------------------------------------------


def tagged(spark, sf_dir) -> DataFrame:
    """case_id, domain, topic, year (a day), is_event, hit, strict over every topic that occurs and every day of a case up to
    the last day of all."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("topic"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("year")).distinct()
    span = e.agg(F.array_sort(F.collect_set("topic")).alias("topics"), F.max("year").alias("last"))  # one row: kinds of events and a day
    grid = e.select("case_id").distinct().crossJoin(F.broadcast(span)).select("case_id", "last", F.posexplode("topics").alias("t", "topic")).select("case_id", "t", "topic", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("year"))
    out = grid.join(e.withColumn("is_event", F.lit(True)), ["case_id", "topic", "year"], "left").fillna(False, ["is_event"])
    m = F.col("case_id") * 7 + F.col("year") * 3 + F.col("t") * 5
    return out.select("case_id", (F.col("case_id") % 4).cast("int").alias("domain"), "topic", "year", "is_event", (m % 4 == 0).alias("hit"), (m % 8 == 0).alias("strict"))


_TAGGED = """e as (select distinct user_id as case_id, event_type as topic, (ts::date - date '2024-01-01')::int as year from events), ts as (select topic, row_number() over (order by topic) - 1 as t from (select distinct topic from e)),
 ys as (select unnest(range(0, (select max(year) from e) + 1))::int as year),
 g as (select c.case_id, (c.case_id % 4)::int as domain, ts.topic, y.year as year, e.case_id is not null as is_event, (c.case_id * 7 + y.year * 3 + t * 5) % 4 = 0 as hit, (c.case_id * 7 + y.year * 3 + t * 5) % 8 = 0 as strict
 from (select distinct case_id from e) c cross join ts cross join ys y left join e on e.case_id = c.case_id and e.topic = ts.topic and e.year = y.year)"""
_RATE = "coalesce(round(case when {d} > 0 then {n}::double / {d} end, 3), 0)"


def _scores_sql(by: str) -> str:
    r = lambda a, b: _RATE.format(n=a, d=b)
    return f"""with {_TAGGED}, s as (select {by}, count(*) filter (is_event) as events, count(*) filter (not is_event) as negatives, count(*) filter (is_event and hit) as hits, count(*) filter (not is_event and hit) as false_positives,
 count(*) filter (is_event and strict) as strict_hits, count(*) filter (not is_event and strict) as strict_false_positives from g group by all)
 select *, {r('hits', 'events')} as recall, {r('hits', '(hits + false_positives)')} as precision, {r('false_positives', 'negatives')} as fp_rate, {r('strict_hits', 'events')} as strict_recall, {r('strict_false_positives', 'negatives')} as strict_fp_rate from s"""


for _name, _by in (("case", ["case_id"]), ("topic", ["topic"]), ("domain_topic", ["domain", "topic"]), ("domain", ["domain"])):

    @query(f"calibration_by_{_name}", _scores_sql(", ".join(_by)))
    def _by_group(spark, sf_dir, by=_by):
        return calibration.scores(tagged(spark, sf_dir), by)


@query("calibration_window_hits", f"with {_TAGGED} select case_id, count(*) filter (is_event and near) as window_hits from (select *, max(hit::int) over (partition by case_id, topic order by year range between 1 preceding and 1 following) = 1 as near from g) group by 1")
def window_hits(spark, sf_dir):
    w = calibration.with_window(tagged(spark, sf_dir), ["case_id", "topic"], "year", "hit")
    return w.groupBy("case_id").agg(calibration.n(F.col("is_event") & F.col("near")).alias("window_hits"))


@query("calibration_mean_recall", f"with {_TAGGED}, r as (select case_id, domain, count(*) filter (is_event and hit)::double / nullif(count(*) filter (is_event), 0) as recall from g group by 1, 2) select domain, round(avg(recall), 6) as mean_recall, count(distinct case_id) as cases from r group by 1")
def mean_recall(spark, sf_dir):
    r = tagged(spark, sf_dir).groupBy("case_id", "domain").agg((calibration.n(F.col("is_event") & F.col("hit")) / F.nullif(calibration.n(F.col("is_event")), F.lit(0))).alias("recall"))
    return rounded(r.groupBy("domain").agg(F.avg("recall").alias("mean_recall"), F.count_distinct("case_id").alias("cases")))


@query("calibration_sweep", "with " + _TAGGED + ", v as (" + " union all ".join(f"select '{k}' as variant, is_event, {c} as hit from g" for k, c in (("base", "hit"), ("strict", "strict"), ("odd", "hit and year % 2 = 1"), ("wide", "hit or strict or year % 5 = 0"))) + f"), s as (select variant, count(*) filter (is_event) as events, count(*) filter (not is_event) as negatives, count(*) filter (is_event and hit) as hits, count(*) filter (not is_event and hit) as false_positives from v group by 1) select *, {_RATE.format(n='hits', d='events')} as recall, {_RATE.format(n='hits', d='(hits + false_positives)')} as precision, {_RATE.format(n='false_positives', d='negatives')} as fp_rate from s")
def sweep(spark, sf_dir):
    h, s, y = F.col("hit"), F.col("strict"), F.col("year")
    return calibration.sweep(tagged(spark, sf_dir), {"base": h, "strict": s, "odd": h & (y % 2 == 1), "wide": h | s | (y % 5 == 0)})


@query("calibration_label_table", f"with {_TAGGED} select domain, topic, count(*) filter (is_event) as positives, count(*) filter (not is_event) as negatives, min(case when is_event then year end) as first_year, max(case when is_event then year end) as last_year, count(distinct case_id) as cases from g group by 1, 2")
def label_table(spark, sf_dir):
    g, e = tagged(spark, sf_dir).groupBy("domain", "topic"), F.col("is_event")
    return g.agg(calibration.n(e).alias("positives"), calibration.n(~e).alias("negatives"), F.min(F.when(e, F.col("year"))).alias("first_year"), F.max(F.when(e, F.col("year"))).alias("last_year"), F.count_distinct("case_id").alias("cases"))


@query("calibration_priority", f"with {_TAGGED}, s as (select topic, count(*) filter (is_event) as events, count(*) filter (is_event and hit) as hits, count(*) filter (not is_event) as negatives, count(*) filter (not is_event and hit) as fp from g group by 1), r as (select topic, hits::double / events as recall, fp::double / negatives as fpr from s), c as (select *, case when recall >= 0.3 and fpr <= 0.2 then 'pass' when recall >= 0.2 then 'refine' else 'rework' end as status from r) select topic, status, row_number() over (order by case status when 'rework' then 0 when 'refine' then 1 else 2 end, fpr desc, topic)::int as position from c")
def priority(spark, sf_dir):
    e, h = F.col("is_event"), F.col("hit")
    r = tagged(spark, sf_dir).groupBy("topic").agg((calibration.n(e & h) / calibration.n(e)).alias("recall"), (calibration.n(~e & h) / calibration.n(~e)).alias("fpr"))
    c = r.withColumn("status", F.when((F.col("recall") >= 0.3) & (F.col("fpr") <= 0.2), "pass").when(F.col("recall") >= 0.2, "refine").otherwise("rework"))
    rank = F.when(F.col("status") == "rework", 0).when(F.col("status") == "refine", 1).otherwise(2)
    return c.select("topic", "status", F.row_number().over(Window.orderBy(rank, F.col("fpr").desc(), "topic")).alias("position"))


@query("calibration_absent_years", "with y as (select distinct l_suppkey as k, year(l_shipdate)::int as year from lineitem where l_suppkey % 3 = year(l_shipdate) % 3 or l_quantity > 45), r as (select k, min(year) as a, max(year) as b from y group by 1) select r.k, g.year::int as year from r, lateral (select unnest(range(a, b + 1)) as year) g anti join y on y.k = r.k and y.year = g.year")
def absent_years(spark, sf_dir):
    y = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year"), "l_quantity").where("k % 3 = year % 3 or l_quantity > 45").select("k", "year").distinct()
    return calibration.absent_years(y, ["k"], "year", F.min("year"), F.max("year"))


@query("calibration_earlier_absent", "with y as (select distinct l_suppkey as k, year(l_shipdate)::int as year from lineitem where l_quantity > 49), g as (select *, year - row_number() over (partition by k order by year) as run from y) select k, year, (min(year) over (partition by k, run) - 1)::int as absent from g")
def earlier_absent(spark, sf_dir):
    y = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year"))
    return calibration.earlier_absent(y, ["k"], "year")


@query("calibration_required_coverage", "with req(domain) as (values ('en'), ('de'), ('fr'), ('es'), ('it')), c as (select lang as domain, count(*) filter (toxic = 1) as pos, count(*) filter (toxic = 0) as neg from documents join labels using (doc_id) group by 1) select req.domain, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg, c.domain is null as missing, coalesce(pos, 0) > 0 and coalesce(neg, 0) > 0 as both_classes, greatest(0, 3 - coalesce(pos, 0)) as shortfall from req left join c using (domain)")
def required_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    c = d.groupBy("domain").agg(calibration.n(F.col("toxic") == 1).alias("pos"), calibration.n(F.col("toxic") == 0).alias("neg"), F.lit(True).alias("seen"))
    req = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "domain string")
    out = req.join(c, "domain", "left").fillna(0, ["pos", "neg"])
    return out.select("domain", "pos", "neg", F.col("seen").isNull().alias("missing"), ((F.col("pos") > 0) & (F.col("neg") > 0)).alias("both_classes"), F.greatest(F.lit(0), 3 - F.col("pos")).alias("shortfall"))


@query("calibration_blockers", "select source, string_agg(distinct f, ',' order by f) as reasons from (select source, unnest([case when n_chars < 300 then 'short' end, case when lang = 'fr' then 'french' end, case when n_chars > 30000 then 'long' end]) as f from documents) group by 1")
def blockers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    why = shapes.all_failures([(F.col("n_chars") < 300, "short"), (F.col("lang") == "fr", "french"), (F.col("n_chars") > 30000, "long")])
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_set(why))))
    return d.groupBy("source").agg(F.when(F.size(all_) > 0, F.array_join(all_, ",")).alias("reasons"))


# Fixed values of the query: the least mean that each metric must reach.
FLOORS = {"click": 20.0, "error": 19.0, "purchase": 25.0, "refund": 1.0, "view": 10.0}


@query("calibration_metric_means", "with m as (select user_id, event_type as metric, avg(value) as v from events group by 1, 2), t as (select count(distinct user_id) as n from m), a as (select metric, sum(v) / max(n) as mean from m, t group by 1) select metric, round(mean, 6) as mean from a")
def metric_means(spark, sf_dir):
    """Means over all users; a user without the metric counts 0."""
    m = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    return rounded(calibration.mean_with_absent(m, "user_id", "metric", "v"))


_FLOORS = ", ".join(f"('{k}', {v!r}::double)" for k, v in FLOORS.items())


@query("calibration_floor_rejections", f"with m as (select user_id, event_type as metric, avg(value) as v from events group by 1, 2), t as (select count(distinct user_id) as n from m), a as (select metric, sum(v) / max(n) as mean from m, t group by 1), f(metric, floor) as (values {_FLOORS}) select metric, floor, round(coalesce(mean, 0), 6) as mean, metric || ' below floor ' || floor || ': ' || printf('%.3f', coalesce(mean, 0)) as rejection from f left join a using (metric) where coalesce(mean, 0) < floor")
def floor_rejections(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    return rounded(calibration.floor_rejections(calibration.mean_with_absent(m, "user_id", "metric", "v"), FLOORS))


@query("calibration_zero_filled", "with l(lang) as (values ('de'), ('en'), ('es'), ('fr'), ('it'), ('pt')) select lang, coalesce(n, 0) as n from l left join (select lang, count(*) as n from documents group by 1) using (lang)")
def zero_filled(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return shapes.zero_filled(c, "lang", "n", ["de", "en", "es", "fr", "it", "pt"])


@query("calibration_missing_fields", "select f as field, count(*) as n from (select unnest([case when value < 5 then 'value' end, case when event_type = 'error' then 'type' end, case when user_id % 10 = 0 then 'user' end]) as f from events) where f is not null group by 1 order by n desc, field")
def missing_fields(spark, sf_dir):
    """The most frequent first, ties by name."""
    miss = shapes.all_failures([(F.col("value") < 5, "value"), (F.col("event_type") == "error", "type"), (F.col("user_id") % 10 == 0, "user")])
    return table(spark, sf_dir, "events").select(F.explode(miss).alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "field")


@query("calibration_votes", "with v as (select doc_id, 0.4 + 0.1 * quality + 0.35 * toxic + (doc_id % 5) / 20.0 as s from labels), c as (select doc_id, least(greatest(round(s, 2), 0.1), 0.95) as confidence from v) select (doc_id % 20)::int as school, round(avg(confidence), 4) as mean_confidence, count(*) filter (confidence >= 0.66) as support, round(count(*) filter (confidence >= 0.66)::double / count(*), 3) >= 0.35 as consensus, count(*) filter (confidence >= 0.70) as primary_votes from c group by 1")
def votes(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    c = lab.select("doc_id", calibration.confidence(F.lit(0.4), [0.1 * F.col("quality"), 0.35 * F.col("toxic"), (F.col("doc_id") % 5) / 20.0]).alias("c"))
    g = c.groupBy((F.col("doc_id") % 20).cast("int").alias("school"))
    yes = calibration.n(F.col("c") >= 0.66)
    return g.agg(F.round(F.avg("c"), 4).alias("mean_confidence"), yes.alias("support"), (F.round(yes / F.count("*"), 3) >= 0.35).alias("consensus"), calibration.n(F.col("c") >= 0.70).alias("primary_votes"))


@query("memory_profile", "with h(keyword, strategy) as (values ('the', 'grounding'), ('que', 'romance'), ('und', 'german')), c as (select strategy, count(*) as n from benchmark, h where contains(lower(text), keyword) group by 1), a as (select strategy, 2 * count(*) as n2, avg(item_id % 3 - 1) as delta from benchmark, h where item_id % 3 = length(strategy) % 3 group by 1), p as (select strategy, coalesce(n, 0) + coalesce(n2, 0) + greatest(0, coalesce(delta, 0)) * 10 as prior from c full join a using (strategy)) select strategy, round(prior, 6) as prior, round(least(0.05, 0.05 * prior / max(prior) over ()), 6) as bias from p")
def memory_profile(spark, sf_dir):
    """Counts of hinted strategies by substring, twice the accepted ones, and a bounded bias."""
    h = F.broadcast(spark.createDataFrame([("the", "grounding"), ("que", "romance"), ("und", "german")], "keyword string, strategy string"))  # a written list
    b = table(spark, sf_dir, "benchmark").crossJoin(h)
    hint, chosen = F.contains(F.lower("text"), F.col("keyword")), F.col("item_id") % 3 == F.length("strategy") % 3
    p = b.groupBy("strategy").agg((calibration.n(hint) + 2 * calibration.n(chosen) + 10 * F.greatest(F.lit(0.0), F.coalesce(F.avg(F.when(chosen, F.col("item_id") % 3 - 1)), F.lit(0.0)))).alias("prior"))
    top = F.max("prior").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rounded(p.withColumn("bias", F.least(F.lit(0.05), 0.05 * F.col("prior") / top)))


# --- calendars -------------------------------------------------------------------------------------------------------

_ST, _BR, _EL = (str(x) for x in (calendars.STEMS, calendars.BRANCHES, calendars.ELEMENTS))


def _sexa(i: str) -> str:
    return f"({_ST})[(({i}) % 10 + 10) % 10 + 1] || ({_BR})[(({i}) % 12 + 12) % 12 + 1]"


@query("calendar_years", f"select y::int as year, {_sexa('y - 1984')} as label, ({_EL})[(((y - 1984) % 10 + 10) % 10) // 2 + 1] as element, least((y - 1950) // 10, 9)::int as phase from range(1950, 2051) t(y)")
def calendar_years(spark, sf_dir):
    y = calendars.years(spark, 1950, 2050)
    return y.select("year", calendars.year_label(F.col("year")).alias("label"), calendars.stem_element(F.col("year") - 1984).alias("element"), calendars.phase(F.col("year") - 1950).alias("phase"))


@query("calendar_months", f"select y::int as year, m::int as month, ({_ST})[(y * 2 + m) % 10 + 1] || ({_BR})[(m + 1) % 12 + 1] as label from range(2020, 2026) a(y), range(1, 13) b(m)")
def calendar_months(spark, sf_dir):
    g = calendars.months(calendars.years(spark, 2020, 2025))
    return g.withColumn("label", calendars.month_label(F.col("year"), F.col("month")))


@query("calendar_days", f"select d::date as date, {_sexa(chr(34) + 'n' + chr(34))} as label, (['Fire', 'Earth', 'Metal'])[(n % 3 + 3) % 3 + 1] as officer, dayofweek(d)::int + 1 as weekday from (select d, (d::date - date '1984-02-02')::bigint as n from generate_series(timestamp '1983-12-20', timestamp '1984-12-31', interval 1 day) t(d))")
def calendar_days(spark, sf_dir):
    d = calendars.days(spark, "1983-12-20", "1984-12-31")
    n = F.datediff("date", F.lit("1984-02-02").cast("date"))
    return d.select("date", calendars.day_label(F.col("date")).alias("label"), calendars.cycle(["Fire", "Earth", "Metal"], n).alias("officer"), F.dayofweek("date").alias("weekday"))


@query("calendar_hours", f"select h::int as hour, case when h = 23 then 'Zi' else ({_BR})[((h + 1) // 2) % 12 + 1] end as branch from range(0, 24) t(h)")
def calendar_hours(spark, sf_dir):
    return spark.range(24).select(F.col("id").cast("int").alias("hour"), calendars.hour_branch(F.col("id")).alias("branch"))


@query("calendar_islands", f"with {USER_DAY}, x as (select symbol, date, case when close > open then 'up' when close < open then 'down' else 'flat' end as phase from p), c as (select *, case when phase is distinct from lag(phase) over (partition by symbol order by date) then 1 else 0 end as ch from x), r as (select *, sum(ch) over (partition by symbol order by date)::int as run from c) select symbol, run, phase, min(date) as first, max(date) as last, count(*) as n from r group by 1, 2, 3")
def calendar_islands(spark, sf_dir):
    x = panels.user_day(spark, sf_dir).select("symbol", "date", F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat").alias("phase"))
    return shapes.islands(x, ["symbol"], "date", "phase")


@query("calendar_mode", "select user_id, first(event_type order by n desc, event_type) as event_type, max(n) as n from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def calendar_mode(spark, sf_dir):
    return shapes.mode_least(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type")


@query("calendar_dominant", "with o(e, i) as (values ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3), ('error', 4)) select user_id, first(e order by n desc, i) as dominant from (select user_id, event_type, count(*) as n from events group by 1, 2) join o on e = event_type group by 1")
def dominant(spark, sf_dir):
    """The most frequent of a fixed order of kinds, ties to the earlier."""
    order = F.array(*[F.lit(x) for x in ("view", "click", "signup", "purchase", "error")])
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.array_position(order, F.col("event_type")))).alias("dominant"))


@query("calendar_first_favourable", f"with {USER_DAY} select symbol, min(case when \"return\" > 0.5 then date end) as first_good, coalesce(string_agg(case when \"return\" > 5 then strftime(date, '%Y-%m-%d') end, ',' order by date), '') as good_days from p group by 1")
def first_favourable(spark, sf_dir):
    p = panels.user_day(spark, sf_dir)
    return p.groupBy("symbol").agg(F.min(F.when(F.col("return") > 0.5, F.col("date"))).alias("first_good"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("return") > 5, F.date_format("date", "yyyy-MM-dd")))), ",").alias("good_days"))


@query("calendar_date_difference", "select o_orderkey, (date '1999-01-01' - o_orderdate::date)::int as days from orders")
def date_difference(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("days"))


# --- text ------------------------------------------------------------------------------------------------------------

_TERMS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({}), '\\s+'), lambda w: trim(w, '.,:;!?()[]{{}}')), lambda w: w <> ''))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query("text_retrieve", f"""with q as (select item_id, unnest({_TERMS.format('text')}) as term from benchmark), p as (select lang, doc_id, unnest({_TERMS.format('text')}) as term from documents),
 h as (select item_id, lang, doc_id, count(*) as overlap from q join p using (term) group by 1, 2, 3) select item_id, lang, doc_id, overlap, row_number() over (partition by item_id, lang order by overlap desc, doc_id desc)::int as rank from h qualify rank <= 2""")
def retrieve(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("lang", "doc_id", texts.terms(F.col("text")).alias("keywords"))
    return texts.retrieve(table(spark, sf_dir, "benchmark"), p, "item_id", "text", "lang", "doc_id", "keywords")


@query("text_index_audit", "select count(*) as passages, count(distinct lang) as languages, count(distinct source) as sources, sum(n_chars)::bigint as chars from documents")
def index_audit(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("passages"), F.count_distinct("lang").alias("languages"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("text_letter_counts", "select doc_id, len(regexp_extract_all(text, '[A-Za-z]'))::int as latin, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))::int as cjk from documents")
def letter_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.latin_count(F.col("text")).alias("latin"), texts.cjk_count(F.col("text")).alias("cjk"))


@query("text_duplicate_lines", "with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as a from documents) select doc_id, round(case when len(a) > 0 then (len(a) - len(list_distinct(a)))::double / len(a) else 0 end, 6) as ratio from l")
def duplicate_lines(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", texts.duplicate_line_ratio(F.col("text")).alias("ratio")))


@query("text_overlap", f"with d as (select conv_id, max(case when turn = 0 then text end) as a, max(case when turn = 1 then text end) as b from conversations group by 1), w as (select conv_id, {_WORDS.format('coalesce(a, chr(32))')} as a, {_WORDS.format('coalesce(b, chr(32))')} as b from d) select conv_id, round(case when len(a) > 0 then len(list_intersect(a, b))::double / len(a) else 0 end, 6) as ratio from w")
def overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    d = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))
    return rounded(d.select("conv_id", texts.overlap_ratio(F.col("a"), F.col("b")).alias("ratio")))


@query("text_critic", f"with w as (select doc_id, {_WORDS.format('text')} as a from documents), s as (select doc_id, least(1.0, len(list_intersect(a, ['the', 'of', 'and', 'license', 'film', 'que']))::double / 3) as style, case when len(list_intersect(a, ['idiot', 'scum', 'gore'])) > 0 then 0.0 else 1.0 end::double as gate from w) select doc_id, round(style, 6) as style, gate, round(case when gate = 0 then 0 else 0.4 * style + 0.3 * 0.9 + 0.3 * gate end, 6) as total from s")
def critic(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", texts.keyword_score(t, ["the", "of", "and", "license", "film", "que"]).alias("style"), texts.allowed(t, ["idiot", "scum", "gore"]).alias("gate"))
    return rounded(d.withColumn("total", texts.gated_total(F.col("gate"), [(F.col("style"), 0.4), (F.lit(0.9), 0.3), (F.col("gate"), 0.3)])))


def _any(phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains(t, '{p}')" for p in phrases) + ")"


@query("text_safety", f"with d as (select doc_id, lower(text) as t, n_chars from documents) select doc_id, round(case when {_any(texts.HIGH_STAKES)} then 0 else least(1.0, ({' + '.join(_any(g) + '::int' for g in texts.BOUNDARIES)}) / 6.0 * 0.8 + case when n_chars > 500 then 0.2 else 0 end) end, 6) as score from d")
def safety(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", texts.safety_score(F.col("text"), F.col("n_chars") > 500).alias("score")))


@query("text_markdown_tail", "with d as (select conv_id, string_agg(case when turn % 2 = 0 then '## ' || replace(text, chr(10), ' ') else '- ' || replace(text, chr(10), chr(10) || '- ') end, chr(10) order by turn) as t from conversations group by 1), s as (select conv_id, list_filter(string_split(chr(10) || t, chr(10) || '## ')[2:], lambda x: true) as p from d), b as (select conv_id, flatten(list_transform(p[-2:], lambda x: list_filter(string_split(x, chr(10))[2:], lambda y: starts_with(y, '- ')))) as a from s) select conv_id, len(a)::int as bullets, round(case when len(a) > 0 then len(list_filter(a, lambda x: contains(x, 'e') and contains(x, 'a')))::double / len(a) else 0 end, 6) as marked from b")
def markdown_tail(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## "), F.regexp_replace("text", "\n", " "))).otherwise(F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n- "))).alias("t"))
    d = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("t"))
    b = d.select("conv_id", texts.tail_bullets(F.col("t"), 2).alias("a"))
    return rounded(b.select("conv_id", F.size("a").alias("bullets"), texts.markers_ratio(F.col("a"), ["e", "a"]).alias("marked")))


@query("text_error_keys", "select lower(array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:8], ' ')) as key, count(*) as n from conversations group by 1")
def error_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(texts.error_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


@query("text_marker_flags", "select doc_id, regexp_matches(lower(text), 'license|copyright') as legal, regexp_matches(text, '@') as mail, regexp_matches(text, '[0-9]{4}') as number from documents")
def marker_flags(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(t).rlike("license|copyright").alias("legal"), t.rlike("@").alias("mail"), t.rlike("[0-9]{4}").alias("number"))


# --- store -----------------------------------------------------------------------------------------------------------


def versions(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("name"), F.row_number().over(w).alias("version"), F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score"))


_VERSIONS = "v as (select o_custkey as name, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as version, o_orderkey as doc, o_totalprice as score from orders)"


@query("store_latest", f"with {_VERSIONS} select * from v qualify version = max(version) over (partition by name)")
def store_latest(spark, sf_dir):
    return store.latest(versions(spark, sf_dir), ["name"])


@query("store_rollback", f"with {_VERSIONS}, m as (select name, max(version) as last from v group by 1) select name, (last + 1)::int as version, doc, score, last as rolled_back_from from v join m using (name) where version = 1")
def store_rollback(spark, sf_dir):
    return store.rollback(versions(spark, sf_dir), ["name"], 1).select("name", "version", "doc", "score", "rolled_back_from")


@query("store_against_parent", f"with {_VERSIONS} select a.name, a.version, a.version - 1 as parent, round(a.score, 4) as mean, round(b.score, 4) as parent_mean, round(a.score - b.score, 4) as delta, coalesce(a.score - b.score < 0, false) as roll_back from v a left join v b on a.name = b.name and b.version = a.version - 1")
def against_parent(spark, sf_dir):
    s = versions(spark, sf_dir).withColumn("parent", F.col("version") - 1)
    return rounded(store.against_parent(s, ["name"], "version", "parent", "score").select("name", "version", "parent", "mean", "parent_mean", "delta", "roll_back"), 4)


@query("store_weighted_score", "select user_id, round(sum(least(1, greatest(0, coalesce(v, 0))) * w) / case when sum(w) = 0 then 1 else sum(w) end, 6) as score, bool_and(v is not null) and sum(least(1, greatest(0, coalesce(v, 0))) * w) / case when sum(w) = 0 then 1 else sum(w) end + 1e-9 >= 0.5 as passed from (select user_id, case when event_id % 50 <> 0 then value / 30 end as v, (event_id % 3)::double as w from events) group by 1")
def weighted_score(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 50 != 0, F.col("value") / 30).alias("v"), (F.col("event_id") % 3).cast("double").alias("w"))
    return rounded(store.weighted_score(m, ["user_id"], "v", "w", 0.5))


@query("store_triggers", """with recursive x as (select user_id, event_id, event_type = 'error' as f, (event_id % 7)::varchar as p, event_id % 3 <> 0 as c, row_number() over (partition by user_id order by event_id)::int as n from events),
 s as (select user_id, 0 as last, []::varchar[] as seen from (select distinct user_id from events)
  union all select user_id, n, case when c then list_append(seen, p) else seen end from (select s.user_id, seen, n, p, c, row_number() over (partition by s.user_id order by n) as r from s join x on x.user_id = s.user_id and f and n - last >= 5 and not list_contains(seen, p)) where r = 1)
 select x.user_id, event_id, s.last is not null as trigger from x left join s on s.user_id = x.user_id and s.last = n""")
def store_triggers(spark, sf_dir):
    """Starts at least five runs apart; every third evolution isn't committed, so its pattern stays new."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    found = store.triggers(e, ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_id") % 7, 5, F.col("event_id") % 3 != 0)
    return found.select("user_id", "event_id", "trigger")


@query("store_degrees", "with e as (select distinct 'c' || o_custkey as src, 's' || l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey), n as (select src as node from e union select dst from e) select node, coalesce(i, 0) as predecessors, coalesce(o, 0) as successors, coalesce(o, 0) = 0 as terminal from n left join (select dst, count(*) as i from e group by 1) on dst = node left join (select src, count(*) as o from e group by 1) on src = node")
def store_degrees(spark, sf_dir):
    """Customers and the suppliers that they ordered from."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    e = li.join(o, "l_orderkey").select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return store.degrees(nodes, e)


@query("store_fitness", "select l_returnflag, round(1 / (1 + sqrt(avg(pow(l_extendedprice / 1000 - l_quantity, 2)))), 8) as fitness from lineitem group by 1")
def store_fitness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("p"), "l_quantity")
    return rounded(store.fitness(li, ["l_returnflag"], "p", "l_quantity"), 8)


@query("store_summary", "select c_mktsegment as category, count(*) as tasks, count(*) filter (c_acctbal > 0) as passed, round(avg((c_acctbal > 0)::int::double), 6) as pass_rate, round(coalesce(avg(case when c_custkey % 2 = 0 then c_custkey % 5 end), 0), 6) as mean_rounds, round(coalesce(avg(case when c_custkey % 2 = 0 then (c_custkey % 5 < 3)::int::double end), 0), 6) as convergence from customer group by 1")
def store_summary(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), (F.col("c_acctbal") > 0).alias("passed"), (k % 2 == 0).alias("allow_evolution"), (k % 5).alias("rounds"), F.lit(3).alias("max_rounds"))
    return rounded(store.summary(t, ["category"]))
