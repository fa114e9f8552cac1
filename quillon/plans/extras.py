"""Receipts, spreads, decay summaries and the remaining small shapes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsl
from ..operators import calendars, cross, nested, quality
from ..sources import panels, readers
from .base import SUPPLIER_MONTH, USER_DAY, W, last, query, rounded, table
from .factors import _IC, FACTORS, scorecard_sql


@query("audit_count_spread", "with c as (select user_id, event_type, count(*) as n from events group by 1, 2), s as (select user_id, max(n) - min(n) as spread, count(*) as kinds from c group by 1) select spread, count(*) as users, max(kinds) as kinds from s group by 1")
def count_spread(spark, sf_dir):
    """Greatest less least count over the kinds of each user, and how often each spread occurs."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = c.groupBy("user_id").agg((F.max("n") - F.min("n")).alias("spread"), F.count("*").alias("kinds"))
    return s.groupBy("spread").agg(F.count("*").alias("users"), F.max("kinds").alias("kinds"))


@query("audit_label_distribution", "with x as (select unnest([lang, case when n_chars > 5000 then 'long' end, case when n_chars < 500 then 'short' end]) as label from documents) select label, count(*) as n from x where label is not null group by 1")
def label_distribution(spark, sf_dir):
    """Counts over a scalar label and a list of further ones."""
    extra = F.array_compact(F.array(F.when(F.col("n_chars") > 5000, "long"), F.when(F.col("n_chars") < 500, "short")))
    d = table(spark, sf_dir, "documents").select(F.explode(F.concat(F.array("lang"), extra)).alias("label"))
    return d.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


_STEMS, _BRANCHES = str(calendars.STEMS), str(calendars.BRANCHES)


@query("calendar_receipts", f"""with y as (select y::int as year, ({_STEMS})[((y - 1984) % 10 + 10) % 10 + 1] || ({_BRANCHES})[((y - 1984) % 12 + 12) % 12 + 1] as label from range(1990, 2031) t(y)),
 h as (select year, label, sha256(year || '|' || label) as row_sha256 from y) select year, label, row_sha256, (select sha256(string_agg(row_sha256, '' order by year)) from h) as receipt from h""")
def receipts(spark, sf_dir):
    """A hash for each generated row and one over all of them (a calendar is small by construction)."""
    y = calendars.years(spark, 1990, 2030).withColumn("label", calendars.year_label(F.col("year")))
    h = y.withColumn("row_sha256", F.sha2(F.concat_ws("|", "year", "label"), 256))
    whole = h.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "row_sha256"))), lambda s: s["row_sha256"]), ""), 256).alias("receipt"))
    return h.crossJoin(F.broadcast(whole))


@query("nested_evidence_map", "with u as (unpivot (select doc_id, lang, source, n_chars::varchar as size from documents) on lang, source, size into name topic value value) select doc_id, topic, value, (row_number() over (partition by doc_id order by topic) - 1)::int as row_index, substr(sha256(doc_id || '|' || topic || '|' || value), 1, 16) as evidence from u where value is not null")
def evidence_map(spark, sf_dir):
    """Topic columns as keyed rows with an index and a short hash of the evidence."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("size"))
    u = nested.unpivot(d, ["doc_id"], ["lang", "source", "size"]).where("value is not null")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("topic")) - 1
    return u.select("doc_id", "topic", "value", index.alias("row_index"), nested.short_id(F.concat_ws("|", F.col("doc_id").cast("string"), "topic", "value")).alias("evidence"))


def _slope(n: int) -> str:
    return f"(select case when count(ic) >= {n} then coalesce(regr_slope(ic, x), 0) else 0 end from (select ic, row_number() over (order by date) - 1 as x from (select * from ic order by date desc limit {n})))"


@query("quality_decay_summary", f"with {_IC} select round({_slope(3)}, 6) + 0.0 as slope_3, round({_slope(5)}, 6) + 0.0 as slope_5, {_slope(3)} < -0.005 as decaying")
def decay_summary(spark, sf_dir):
    daily = quality.daily_ic(dsl.evaluate(panels.user_day(spark, sf_dir), {"f": FACTORS["reversal_5"]}), "f")
    a = quality.trend(daily, "date", "ic", 3).withColumnRenamed("slope", "slope_3")
    b = quality.trend(daily, "date", "ic", 5).withColumnRenamed("slope", "slope_5")
    return rounded(a.crossJoin(F.broadcast(b)).withColumn("decaying", F.col("slope_3") < -0.005))  # one row each


_LONG = " union all ".join(f"select '{n}' as factor, symbol, date, {c} as f, forward_return as r from x" for n, c in (("mean_5", "a"), ("last", "b"), ("spread", "c"), ("fall", "-b")))


def _share(x: str) -> str:
    return f"{x} / (sum(abs({x})) over () + 1e-12)"


@query("combination_weights", f"""with {USER_DAY}, x as (select *, avg("return") over {last(5)} as a, close as b, high - low as c from p), l as ({_LONG}), k as (select * from l where f is not null and r is not null),
 i as (select factor, date, case when min(f) <> max(f) and min(r) <> max(r) then covar_samp(f, r) / nullif(stddev_samp(f) * stddev_samp(r), 0) end as ic from k group by 1, 2),
 b0 as (select *, list_sort(list_distinct(quantile_cont(f, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) over (partition by factor, date))) as e from k), b as (select *, case when len(e) > 1 then greatest(0, len(list_filter(e, lambda y: y < f)) - 1) end as q from b0),
 d as (select factor, date, avg(case when q = 4 then r end) as hi, avg(case when q = 0 then r end) as lo from b group by 1, 2), ls as (select factor, coalesce(hi, 0) - coalesce(lo, 0) as ls from d where hi is not null or lo is not null),
 v as (select factor, stddev_samp(ls) as vol, avg(ls) / (stddev_samp(ls) + 1e-8) * sqrt(252) as sharpe from ls group by 1), s as (select factor, avg(ic) as ic from i group by 1),
 w as (select factor, ic, sign(ic) * sharpe as rs, sign(ic) / (vol + 1e-12) as rp, count(*) over () as n from s join v using (factor)),
 t as (select factor, n, {_share("ic")} as wi, {_share("rs")} as ws, {_share("rp")} as wp from w), u as (select *, sum(wi) over () as ti, sum(ws) over () as ts, sum(wp) over () as tp from t)
 select factor, round(1.0::double / n, 6) as equal, round(case when abs(ti) < 1e-6 then 1.0 / n else wi end, 5) + 0.0 as by_ic, round(case when abs(ts) < 1e-6 then 1.0 / n else ws end, 5) + 0.0 as by_sharpe, round(case when abs(tp) < 1e-6 then 1.0 / n else wp end, 5) + 0.0 as by_risk from u""")
def combination_weights(spark, sf_dir):
    """All four ways, from daily information coefficients and long-short series of four factors."""
    p = dsl.evaluate(panels.user_day(spark, sf_dir), {"a": "ts_mean(return, 5)", "b": "close", "c": "sub(high, low)", "d": "neg(close)"})
    long = p.select("symbol", "date", F.col("forward_return").alias("r"), F.expr("stack(4, 'mean_5', a, 'last', b, 'spread', c, 'fall', d) as (factor, f)")).where("f is not null and r is not null")
    ic = long.groupBy("factor", "date").agg(quality.pearson("f", "r").alias("ic")).groupBy("factor").agg(F.avg("ic").alias("ic"))
    ls = quality.long_short_many(long).groupBy("factor").agg(F.stddev_samp("ls").alias("vol"), quality.sharpe("ls").alias("sharpe"))
    out = ic.join(ls, "factor")
    for how, name in (("equal", "equal"), ("ic", "by_ic"), ("sharpe", "by_sharpe"), ("risk_parity", "by_risk")):
        out = quality.combination_weights(out, how).withColumn(name, F.round("weight", 6 if how == "equal" else 5) + 0.0).drop("weight")
    return out.select("factor", "equal", "by_ic", "by_sharpe", "by_risk")


@query("combination_signed_ic", scorecard_sql() + ", q as (select factor, ic, sum(abs(ic)) over () as size from s) select factor, round(ic / (size + 1e-8), 6) + 0.0 as signed from q")
def signed_ic(spark, sf_dir):
    s = quality.scorecard(dsl.evaluate(panels.user_day(spark, sf_dir), FACTORS), list(FACTORS)).select("factor", "ic")
    return quality.ic_weights(s).select("factor", (F.round("weight", 6) + 0.0).alias("signed"))


@query("source_forward_returns", f"with {SUPPLIER_MONTH} select symbol, date, round(lead(close, 3) over ({W}) / nullif(close, 0) - 1, 6) + 0.0 as forward_return from p")
def forward_returns(spark, sf_dir):
    p = panels.supplier_month(spark, sf_dir).drop("forward_return")
    return rounded(readers.forward_returns(p, 3).select("symbol", "date", "forward_return"))


@query("nested_overlap_recall", "with e as (select user_id, list(distinct event_type) filter (value > 20) as ev, list(distinct event_type) filter (event_id % 3 = 0) as hint from events group by 1) select user_id, round(len(list_intersect(coalesce(ev, []), coalesce(hint, [])))::double / greatest(1, len(coalesce(ev, []))), 6) as recall from e")
def overlap_recall(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("ev"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("hint"))
    return rounded(e.select("user_id", (F.size(F.array_intersect("ev", "hint")) / F.greatest(F.lit(1), F.size("ev"))).alias("recall")))


@query("cs_neutral_both", f"""with {SUPPLIER_MONTH}, a as (select *, case when sector is not null then "return" - avg("return") over (partition by date, sector) end as x from p),
 b as (select *, case when market_cap is not null then x end as u, case when x is not null then ln(market_cap) end as v from a) select symbol, date, round(u - v * (covar_samp(u, v) over (partition by date) / nullif(var_samp(v) over (partition by date), 0)), 6) + 0.0 as value from b""")
def neutral_both(spark, sf_dir):
    """Sector first, then size."""
    out = cross.neutralise(panels.supplier_month(spark, sf_dir), "return", "value", sector="sector", cap="market_cap")
    return rounded(out.select("symbol", "date", "value"))


@query("dedup_by_key", "select user_id, ts::date as day, min(event_id) as event_id from events group by 1, 2")
def dedup_by_key(spark, sf_dir):
    """One row of each (symbol, date), the least id: keys decide, never equal values."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_id")
    return e.groupBy("user_id", "day").agg(F.min("event_id").alias("event_id"))


@query("split_inclusive_bounds", f"with {USER_DAY} select count(*) filter (date <= date '2024-01-10') as train, count(*) filter (date between date '2024-01-10' and date '2024-01-20') as validation, count(*) filter (date >= date '2024-01-20') as test from p")
def split_bounds(spark, sf_dir):
    a, b, c = panels.three_way(panels.user_day(spark, sf_dir), "2024-01-10", "2024-01-20")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(a, "train").crossJoin(F.broadcast(n(b, "validation"))).crossJoin(F.broadcast(n(c, "test")))


@query("expected_items", "with e(kind) as (values ('view'), ('click'), ('refund')), u as (select distinct user_id from events), g as (select user_id, kind, exists(select 1 from events x where x.user_id = u.user_id and x.event_type = kind and x.value > 30) as present from u, e) select user_id, count(*) filter (present) as existing, string_agg(case when not present then kind end, ',' order by kind) as missing, bool_and(present) as complete from g group by 1")
def expected_items(spark, sf_dir):
    """Which of a written list each user has, and which are missing."""
    want = F.array(F.lit("click"), F.lit("refund"), F.lit("view"))
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("have"))
    miss = F.array_except(want, F.col("have"))
    return h.select("user_id", (F.size(want) - F.size(miss)).cast("bigint").alias("existing"), F.when(F.size(miss) > 0, F.array_join(miss, ",")).alias("missing"), (F.size(miss) == 0).alias("complete"))
