"""Formulas over panels: every operator of the language, the named factors, quality and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsl
from ..operators import cross, indicators, quality, rolling
from ..sources import panels
from .base import SUPPLIER_MONTH, USER_DAY, W, last, query, rounded

#: The named factors.
FACTORS = {
    "momentum_20": "cs_rank(ts_mean(return, 20))",
    "reversal_5": "neg(cs_rank(ts_mean(return, 5)))",
    "volume_price_20": "ts_corr(close, volume, 20)",
    "low_vol_20": "neg(cs_rank(ts_std(return, 20)))",
    "high_zscore_20": "cs_rank(ts_zscore(high, 20))",
    "alpha_001": "cs_rank(ts_max(mul(div(sub(close, ts_delay(close, 1)), ts_delay(close, 1)), div(sub(close, ts_delay(close, 1)), ts_delay(close, 1))), 5))",
    "alpha_003": "ts_corr(cs_rank(open), cs_rank(volume), 10)",
    "alpha_101": "div(sub(close, open), add(sub(high, low), 0.001))",
    "multi_timeframe": "add(cs_rank(ts_mean(return, 20)), neg(cs_rank(ts_mean(return, 5))))",
    "return_5": "cs_rank(ts_mean(return, 5))",
    "reversal_10": "neg(cs_rank(ts_mean(return, 10)))",
    "vol_5": "cs_rank(ts_std(return, 5))",
    "body": "div(sub(close, open), open)",
}


def rank_sql(x: str, by: str = "date") -> str:
    return f"case when {x} is not null then (rank() over (partition by {by} order by {x} nulls last) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count({x}) over (partition by {by}) end"


def corr_sql(x: str, y: str, over: str) -> str:
    u, v = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    return f"case when min({u}) over {over} <> max({u}) over {over} and min({v}) over {over} <> max({v}) over {over} then covar_samp({u}, {v}) over {over} / nullif(stddev_samp({u}) over {over} * stddev_samp({v}) over {over}, 0) end"


def _formula(name: str, formula: str, sql: str, ctes: str = "", source: str = "p") -> None:
    @query(f"dsl_{name}", f"with {USER_DAY}{ctes} select symbol, date, round({sql}, 6) + 0.0 as value from {source}")
    def run(spark, sf_dir):
        return rounded(dsl.evaluate(panels.user_day(spark, sf_dir), {"value": formula}).select("symbol", "date", "value"))


for _name, _f, _sql in [
    ("var", "vwap", "vwap"), ("const", "add(close, 0.5)", "close + 0.5"), ("abs", "abs(sub(close, open))", "abs(close - open)"),
    ("log", "log(sub(close, 20))", "case when close > 20 then ln(close - 20) end"), ("sign", "sign(return)", 'sign("return")::double'), ("neg", "-close", "-close"),
    ("signed_power", "signed_power(sub(close, open))", "sign(close - open) * sqrt(abs(close - open))"), ("add", "add(high, low)", "high + low"), ("sub", "sub(high, low)", "high - low"),
    ("mul", "mul(close, volume)", "close * volume"), ("div", "div(open, sub(high, low))", "open / nullif(high - low, 0)"),
    ("greater", "greater(return, 0)", 'coalesce(("return" > 0)::int::double, 0)'), ("less", "less(return, forward_return)", 'coalesce(("return" < forward_return)::int::double, 0)'),
    ("if_positive", "if_positive(return, forward_return)", 'coalesce(case when "return" > 0 then forward_return end, 0)'),
    ("if_else", "if_else(return, close, open)", 'case when "return" > 0 then close else open end'),
    ("cs_rank", "cs_rank(volume)", rank_sql("volume")),
    ("cs_zscore", "cs_zscore(return)", '("return" - avg("return") over (partition by date)) / (stddev_samp("return") over (partition by date) + 1e-8)'),
    ("winsorize", "winsorize(return)", 'case when "return" is not null then least(greatest("return", quantile_cont("return", 0.01) over (partition by date)), quantile_cont("return", 0.99) over (partition by date)) end'),
    ("ts_mean", "ts_mean(return, 5)", f'avg("return") over {last(5)}'), ("ts_std", "ts_std(return, 5)", f'stddev_samp("return") over {last(5)}'),
    ("ts_sum", "ts_sum(return, 10)", f'sum("return") over {last(10)}'), ("ts_min", "ts_min(low, 5)", f"min(low) over {last(5)}"), ("ts_max", "ts_max(high, 5)", f"max(high) over {last(5)}"),
    ("ts_delta", "ts_delta(close, 3)", f"close - lag(close, 3) over ({W})"), ("ts_delay", "ts_delay(close, 2)", f"lag(close, 2) over ({W})"), ("ts_shift", "ts_shift(return, 1)", f'lag("return", 1) over ({W})'),
    ("ts_pct_change", "ts_pct_change(return, 2)", f'last_value("return" ignore nulls) over ({W} rows between unbounded preceding and current row) / nullif(last_value("return" ignore nulls) over ({W} rows between unbounded preceding and 2 preceding), 0) - 1'),
    ("ts_zscore", "ts_zscore(close, 10)", f"(close - avg(close) over {last(10)}) / (stddev_samp(close) over {last(10)} + 1e-8)"),
    ("ts_corr", "ts_corr(close, volume, 10)", corr_sql("close", "volume", last(10))),
    ("ts_cov", "ts_cov(return, volume, 10)", f'covar_samp(case when volume is not null then "return" end, case when "return" is not null then volume end) over {last(10)}'),
]:
    _formula(_name, _f, _sql)

_formula("ts_rank", "ts_rank(volume, 5)", "(len(list_filter(a, lambda v: v < volume)) + (len(list_filter(a, lambda v: v = volume)) + 1) / 2.0) / len(a)", f", q as (select *, list(volume) over {last(5)} as a from p)", "q")
_arg = "case when len(list_filter(a, lambda v: v is not null)) > 0 then (coalesce(list_position(list_transform(a, lambda v: (v is null)::int), 1), list_position(a, {m}(a))) - 1) / greatest(1, len(a) - 1)::double end"
_list = f', q as (select *, list("return") over {last(5)} as a from p)'
_formula("ts_argmax", "ts_argmax(return, 5)", _arg.format(m="list_max"), _list, "q")
_formula("ts_argmin", "ts_argmin(return, 5)", _arg.format(m="list_min"), _list, "q")

_RN = f", n as (select *, row_number() over ({W}) as rn from p)"


def decayed_sql(x: str, q: float, source: str = "n") -> str:
    """Sum of x * q ** (rows since), by joining every row to the ones before it."""
    return f"select a.symbol, a.rn, sum(b.{x} * pow({q!r}, a.rn - b.rn)) as num, sum(case when b.{x} is not null then pow({q!r}, a.rn - b.rn) end) as den from {source} a join {source} b on a.symbol = b.symbol and b.rn <= a.rn group by all"


@query("dsl_ts_ema", f'with {USER_DAY}{_RN}, n2 as (select *, "return" as x from n), e as ({decayed_sql("x", 1 - 2 / 6, "n2")}) select symbol, date, round(num / den, 6) + 0.0 as value from n2 join e using (symbol, rn)')
def ts_ema(spark, sf_dir):
    return rounded(dsl.evaluate(panels.user_day(spark, sf_dir), {"value": "ts_ema(return, 5)"}).select("symbol", "date", "value"))


@query("smoothed_clip", f'with {USER_DAY}{_RN}, n2 as (select *, ("return" - avg("return") over (partition by date)) / (stddev_samp("return") over (partition by date) + 1e-8) as x from n), e as ({decayed_sql("x", 1 - 2 / 4, "n2")}) select symbol, date, round(case when num is not null then least(greatest(num / den, -5), 5) end, 6) + 0.0 as value from n2 join e using (symbol, rn)')
def smoothed_clip(spark, sf_dir):
    """An EMA-smoothed, clipped signal."""
    p = dsl.evaluate(panels.user_day(spark, sf_dir), {"x": "ts_ema(cs_zscore(return), 3)"})
    return rounded(p.select("symbol", "date", F.when(F.col("x").isNotNull(), F.least(F.greatest("x", F.lit(-5.0)), F.lit(5.0))).alias("value")))


# --- cross-section ---------------------------------------------------------------------------------------------------

_CS = {
    "abs_normalise": (("abs_normalise", "close"), "close / (sum(abs(close)) over (partition by date) + 1e-8)"),
    "sector_neutral": (("sector_neutral", "return", "sector"), 'case when sector is not null then "return" - avg("return") over (partition by date, sector) end'),
    "cap_neutral": (("cap_neutral", "return", "market_cap"), "u - v * (covar_samp(u, v) over (partition by date) / nullif(var_samp(v) over (partition by date), 0))"),
    "bucket": (("bucket", "close", 5), "case when len(e) > 1 then greatest(0, len(list_filter(e, lambda b: b < close)) - 1) end"),
}
for _name, (_item, _sql) in _CS.items():
    _more = ', q0 as (select *, case when market_cap is not null then "return" end as u, case when "return" is not null then ln(market_cap) end as v, quantile_cont(close, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) over (partition by date) as qs from p), q as (select *, list_sort(list_distinct(qs)) as e from q0)'

    @query(f"cs_{_name}", f"with {SUPPLIER_MONTH}{_more} select symbol, date, round(({_sql})::double, 6) + 0.0 as value from q")
    def _cs(spark, sf_dir, item=_item):
        out = cross.with_columns(panels.supplier_month(spark, sf_dir), {"value": item})
        return rounded(out.select("symbol", "date", F.col("value").cast("double").alias("value")))


@query("cs_rank_pieces", f"with {USER_DAY} select symbol, date, round({rank_sql('volume')}, 6) as rank_volume, round({rank_sql('close')}, 6) as rank_close from p")
def rank_pieces(spark, sf_dir):
    """Ranks as they are made beyond what one task may order: each date in pieces, with a value that many rows share."""
    out = cross.with_columns(panels.user_day(spark, sf_dir), {"rank_volume": ("cs_rank", "volume"), "rank_close": ("cs_rank", "close")}, wide=True)
    return rounded(out.select("symbol", "date", "rank_volume", "rank_close"))


@query("cs_quantile_pieces", f"""with {USER_DAY}, q as (select *, list_sort(list_distinct(quantile_cont(volume, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) over (partition by date))) as e from p)
 select symbol, date, round(least(greatest(close, quantile_cont(close, 0.05) over (partition by date)), quantile_cont(close, 0.95) over (partition by date)), 6) as clipped, case when len(e) > 1 then greatest(0, len(list_filter(e, lambda b: b < volume)) - 1) end::int as bucket from q""")
def quantile_pieces(spark, sf_dir):
    out = cross.with_columns(panels.user_day(spark, sf_dir), {"clipped": ("winsorize", "close", 0.05, 0.95), "bucket": ("bucket", "volume", 5)}, wide=True)
    return rounded(out.select("symbol", "date", "clipped", F.col("bucket").cast("int").alias("bucket")))


@query("cs_neutral_where_known", f"with {SUPPLIER_MONTH} select symbol, date, round(case when sector is not null then close - avg(close) over (partition by date, sector) end, 6) + 0.0 as value from p")
def neutral_where_known(spark, sf_dir):
    """Steps whose column the panel has: here the sector, as the cap isn't there."""
    p = panels.supplier_month(spark, sf_dir).drop("market_cap")
    return rounded(cross.neutralise(p, "close", "value", sector="sector", cap="market_cap").select("symbol", "date", "value"))


@query("cs_coverage", f'with {USER_DAY}, d as (select date, avg(("return" is not null)::int::double) as c from p group by 1) select round(avg(c), 6) as coverage, count(*) as days from d')
def coverage(spark, sf_dir):
    d = panels.user_day(spark, sf_dir).groupBy("date").agg(F.avg(F.col("return").isNotNull().cast("double")).alias("c"))
    return rounded(d.agg(F.avg("c").alias("coverage"), F.count("*").alias("days")))


# --- quality ---------------------------------------------------------------------------------------------------------

_REV = f'{USER_DAY}, m as (select *, avg("return") over {last(5)} as ma from p), f0 as (select *, -({rank_sql("ma")}) as f, forward_return as r from m)'
_C = f"{_REV}, c as (select * from f0 where f is not null and r is not null)"
_IC = f"{_C}, ic as (select date, case when min(f) <> max(f) and min(r) <> max(r) then covar_samp(f, r) / nullif(stddev_samp(f) * stddev_samp(r), 0) end as ic from c group by 1)"
_TURN = f"{_REV}, w as (select symbol, date, f / (sum(abs(f)) over (partition by date) + 1e-8) as w from f0), t as (select date, abs(w - lag(w) over ({W})) as t from w)"
_LS = f"{_C}, b0 as (select *, list_sort(list_distinct(quantile_cont(f, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) over (partition by date))) as e from c), b as (select *, case when len(e) > 1 then greatest(0, len(list_filter(e, lambda x: x < f)) - 1) end as k from b0), ls0 as (select date, avg(case when k = 4 then r end) as hi, avg(case when k = 0 then r end) as lo from b group by 1), ls as (select date, coalesce(hi, 0) - coalesce(lo, 0) as ls from ls0 where hi is not null or lo is not null)"
_EQ = f"{_LS}, eq0 as (select date, ls, product(1 + 0.01 * ls) over (order by date) as equity from ls), eq as (select *, equity / max(equity) over (order by date) - 1 as drawdown from eq0)"


def _reversal(spark, sf_dir) -> DataFrame:
    return dsl.evaluate(panels.user_day(spark, sf_dir), {"f": FACTORS["reversal_5"]})


@query("factor_reversal_ic", f"with {_IC} select round(avg(ic), 6) as ic, round(stddev_samp(ic), 6) as ic_std, count(ic) as days from ic")
def reversal_ic(spark, sf_dir):
    """The flagship: a formula to its daily information coefficient."""
    daily = quality.daily_ic(_reversal(spark, sf_dir), "f")
    return rounded(daily.agg(F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("days")))


@query("quality_daily_ic", f"with {_IC} select date, round(ic, 6) as ic from ic")
def daily_ic(spark, sf_dir):
    return rounded(quality.daily_ic(_reversal(spark, sf_dir), "f"))


_RIC = f"{_C}, rr as (select date, {rank_sql('f')} as f, {rank_sql('r')} as r from c), ic as (select date, case when min(f) <> max(f) and min(r) <> max(r) then covar_samp(f, r) / nullif(stddev_samp(f) * stddev_samp(r), 0) end as ic from rr group by 1)"


@query("quality_rank_ic", f"with {_RIC} select round(coalesce(avg(ic), 0), 6) as ic from ic")
def rank_ic(spark, sf_dir):
    return rounded(quality.ic_score(quality.daily_rank_ic(_reversal(spark, sf_dir), "f")))


@query("quality_icir", f"with {_IC} select round(coalesce(avg(ic) / (stddev_samp(ic) + 1e-8), 0), 6) as icir from ic")
def icir(spark, sf_dir):
    return rounded(quality.icir_score(quality.daily_ic(_reversal(spark, sf_dir), "f")))


@query("quality_turnover", f"with {_TURN}, d as (select date, avg(t) as t from t group by 1) select round(coalesce(avg(t), 0), 6) as turnover from d")
def turnover(spark, sf_dir):
    return rounded(quality.turnover(_reversal(spark, sf_dir), "f"))


@query("backtest_turnover", f"with {_TURN} select date, round(coalesce(sum(t), 0), 6) + 0.0 as turnover from t group by 1")
def backtest_turnover(spark, sf_dir):
    return rounded(quality.daily_turnover(_reversal(spark, sf_dir), "f"))


@query("backtest_long_short", f"with {_EQ} select date, round(ls, 6) + 0.0 as ls, round(equity, 6) + 0.0 as equity, round(drawdown, 6) + 0.0 as drawdown from eq")
def long_short(spark, sf_dir):
    """A hundredth of the capital in each leg: the tables' moves are far larger than those of prices."""
    return rounded(quality.equity(quality.long_short(_reversal(spark, sf_dir), "f"), share=0.01))


@query("backtest_summary", f"""with {_EQ}, w as (select symbol, date, f / (sum(abs(f)) over (partition by date) + 1e-8) as w from f0), t0 as (select date, abs(w - lag(w) over ({W})) as t from w),
 tu as (select date, coalesce(sum(t), 0) as turnover from t0 group by 1), j as (select * from eq full join tu using (date))
 select count(ls) as days, round(avg(ls) * 252, 5) as annual_return, round(coalesce(avg(ls) / (stddev_samp(ls) + 1e-8) * sqrt(252), 0), 5) as sharpe, round(min(drawdown), 5) as max_drawdown,
 round(avg(turnover), 5) as turnover, round(avg(ls - 2 * 0.001 * coalesce(turnover, 0)) * 252, 5) as cost_adjusted from j""")
def backtest(spark, sf_dir):
    return rounded(quality.backtest(_reversal(spark, sf_dir), "f", share=0.01), 5)


def _degenerate_sql(x: str, source: str) -> str:
    return f"""d as (select date, count(*) as n, count({x}) as k from {source} group by 1), a as (select (1 - sum(k) / nullif(sum(n), 0))::double as null_share, avg(k / n) as coverage from d),
 v as (select case when min({x}) = max({x}) then 0 else stddev_pop({x}) end as pop, case when min({x}) = max({x}) then 0 else stddev_samp({x}) end as samp from {source})"""


@query("quality_degenerate", f"""with {_REV}, {_degenerate_sql("f", "f0")}
 select round(null_share, 6) as null_share, round(pop, 6) as spread, round(coverage, 6) as coverage, null_share > 0.3 or coalesce(pop < 1e-8, true) as degenerate from a, v""")
def degenerate(spark, sf_dir):
    return rounded(quality.degenerate(_reversal(spark, sf_dir), "f"))


@query("quality_degenerate_constant", f"""with {USER_DAY}, c as (select date, case when volume > 1 then 99999.9 end as f from p), {_degenerate_sql("f", "c")}
 select round(null_share, 6) as null_share, round(samp, 6) as spread, round(coverage, 6) as coverage, null_share > 0.2 or coalesce(samp < 1e-8, true) or coverage < 0.5 as degenerate from a, v""")
def degenerate_constant(spark, sf_dir):
    """The cleaner's rule on a large constant with gaps: it must have no spread."""
    p = panels.user_day(spark, sf_dir).withColumn("f", F.when(F.col("volume") > 1, F.lit(99999.9)))
    return rounded(quality.degenerate(p, "f", 0.2, 0.5, sample=True))


@query("quality_ic_trend", f"with {_IC}, l as (select * from ic order by date desc limit 5), x as (select ic, row_number() over (order by date) - 1 as x from l) select round(case when count(ic) >= 5 then coalesce(regr_slope(ic, x), 0) else 0 end, 6) + 0.0 as slope, round(case when count(ic) >= 5 then coalesce(regr_slope(ic, x), 0) else 0 end, 6) < -0.005 as decaying from x")
def ic_trend(spark, sf_dir):
    out = quality.trend(quality.daily_ic(_reversal(spark, sf_dir), "f"), "date", "ic", 5)
    return rounded(out).withColumn("decaying", F.col("slope") < -0.005)


def _oracle_factor(name: str) -> str:
    m20, m5, m10 = (f'avg("return") over {last(n)}' for n in (20, 5, 10))
    return {
        "momentum_20": ("m20", None), "reversal_5": ("m5", "neg"), "volume_price_20": (corr_sql("close", "volume", last(20)), "raw"), "low_vol_20": ("sd20", "neg"), "high_zscore_20": ("z20", None),
        "alpha_101": ("(close - open) / nullif(high - low + 0.001, 0)", "raw"), "return_5": ("m5", None), "reversal_10": ("m10", "neg"), "vol_5": ("sd5", None), "body": ("(close - open) / nullif(open, 0)", "raw"),
        "alpha_001": ("mx5", None), "multi_timeframe": None, "alpha_003": None,
    }[name]


_WIDE = f"""{USER_DAY}, r0 as (select *, (close - lag(close) over ({W})) / nullif(lag(close) over ({W}), 0) as dr, {rank_sql("open")} as ro, {rank_sql("volume")} as rv from p),
 a0 as (select *, avg("return") over {last(20)} as m20, avg("return") over {last(5)} as m5, avg("return") over {last(10)} as m10, stddev_samp("return") over {last(20)} as sd20, stddev_samp("return") over {last(5)} as sd5,
 (high - avg(high) over {last(20)}) / (stddev_samp(high) over {last(20)} + 1e-8) as z20, max(dr * dr) over {last(5)} as mx5, {corr_sql("ro", "rv", last(10))} as a3, {corr_sql("close", "volume", last(20))} as vp from r0)"""


def _factor_sql() -> str:
    cols = []
    for k in FACTORS:
        if k == "multi_timeframe":
            e = f"({rank_sql('m20')}) - ({rank_sql('m5')})"
        elif k == "alpha_003":
            e = "a3"
        elif k == "volume_price_20":
            e = "vp"
        else:
            x, how = _oracle_factor(k)
            e = x if how == "raw" else f"-({rank_sql(x)})" if how == "neg" else rank_sql(x)
        cols.append(f"round({e}, 6) + 0.0 as {k}")
    return f"with {_WIDE} select symbol, date, {', '.join(cols)} from a0"


@query("factor_catalogue", _factor_sql())
def catalogue(spark, sf_dir):
    """All named factors in one staged plan."""
    return rounded(dsl.evaluate(panels.user_day(spark, sf_dir), FACTORS).select("symbol", "date", *FACTORS))


def scorecard_sql(weights: str = "") -> str:
    parts = " union all ".join(f"select '{k}' as factor, symbol, date, {k} as f, forward_return as r from ff" for k in FACTORS)
    inner = _factor_sql().split("select symbol, date, ", 1)[0]
    cols = _factor_sql()[len(inner) + len("select symbol, date, ") :].rsplit(" from a0", 1)[0].replace(", 6) + 0.0", ", 300) + 0.0")
    cols = cols.replace("round(", "(").replace(", 300) + 0.0", ")")
    return f"""{inner}, ff as (select symbol, date, forward_return, {cols} from a0), lg as ({parts}),
 w as (select *, f / (sum(abs(f)) over (partition by factor, date) + 1e-8) as w, case when f is not null and r is not null then f end as x, case when f is not null and r is not null then r end as y from lg),
 t as (select *, abs(w - lag(w) over (partition by factor, symbol order by date)) as t from w),
 d as (select factor, date, case when min(x) <> max(x) and min(y) <> max(y) then covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) end as ic, avg(t) as t from t group by 1, 2),
 s as (select factor, coalesce(avg(ic), 0) as ic, coalesce(avg(ic) / (stddev_samp(ic) + 1e-8), 0) as icir, coalesce(avg(t), 0) as turnover from d group by 1)"""


@query("factor_scorecard", scorecard_sql() + " select factor, round(ic, 6) as ic, round(icir, 6) as icir, round(turnover, 6) as turnover, round(greatest(0, least(1, 0.5 * abs(ic) + 0.3 * least(1, abs(icir)) - 0.5 * turnover)), 6) + 0.0 as score from s")
def scorecard(spark, sf_dir):
    p = dsl.evaluate(panels.user_day(spark, sf_dir), FACTORS)
    return rounded(quality.scorecard(p, list(FACTORS)))


@query("factor_leaderboard", scorecard_sql() + ", sc as (select factor, round(ic, 6) as ic from s) select row_number() over (order by abs(ic) desc, factor)::int as rank, factor, ic from sc qualify rank <= 5")
def leaderboard(spark, sf_dir):
    p = dsl.evaluate(panels.user_day(spark, sf_dir), FACTORS)
    s = rounded(quality.scorecard(p, list(FACTORS)).select("factor", "ic"))
    top = s.orderBy(F.abs("ic").desc(), "factor").limit(5)
    return top.select(F.row_number().over(Window.orderBy(F.abs("ic").desc(), "factor")).alias("rank"), "factor", "ic")


def _z(x: str) -> str:
    return f"({x} - avg({x}) over (partition by date)) / (stddev_samp({x}) over (partition by date) + 1e-8)"


@query("combine_zscores", f'with {USER_DAY} select symbol, date, round(0.6 * {_z("close")} - 0.4 * {_z(chr(34) + "return" + chr(34))}, 6) + 0.0 as combined from p')
def combine(spark, sf_dir):
    return rounded(quality.combine(panels.user_day(spark, sf_dir), {"close": 0.6, "return": -0.4}).select("symbol", "date", "combined"))


@query("combine_complete_rows", f'with {USER_DAY}, c as (select * from p where close is not null and "return" is not null) select symbol, date, round(0.6 * {_z("close")} - 0.4 * {_z(chr(34) + "return" + chr(34))}, 6) + 0.0 as combined from c')
def combine_complete(spark, sf_dir):
    return rounded(quality.combine(panels.user_day(spark, sf_dir), {"close": 0.6, "return": -0.4}, drop_incomplete=True).select("symbol", "date", "combined"))


_FOLD = f"""{USER_DAY}, fo as (select 'train' as fold, * from p where date <= date '2024-01-16' union all select 'test', * from p where date >= date '2024-01-16'),
 m as (select *, avg("return") over (partition by fold, symbol order by date rows between 4 preceding and current row) as f from fo),
 d as (select fold, date, case when min(f) <> max(f) and min(forward_return) <> max(forward_return) then covar_samp(f, forward_return) / nullif(stddev_samp(f) * stddev_samp(forward_return), 0) end as ic from m where f is not null and forward_return is not null group by 1, 2),
 s as (select avg(case when fold = 'train' then ic end) as train_ic, avg(case when fold = 'test' then ic end) as test_ic from d)"""


@query("fold_scores", f"with {_FOLD} select round(train_ic, 6) as train_ic, round(test_ic, 6) as test_ic, round(case when abs(train_ic) < 1e-8 then 0 else (train_ic - test_ic) / nullif(abs(train_ic), 0) end, 4) as overfit, round(case when train_ic * test_ic < 0 then -1 else test_ic end, 6) as robust_ic from s")
def fold_scores(spark, sf_dir):
    """Both folds in one pass; windows start cold in each."""
    p = panels.folds(panels.user_day(spark, sf_dir), "2024-01-16")
    w = Window.partitionBy("fold", "symbol").orderBy("date").rowsBetween(-4, 0)
    c = p.select("fold", "date", F.avg("return").over(w).alias("f"), F.col("forward_return").alias("r")).where("f is not null and r is not null")
    d = c.groupBy("fold", "date").agg(quality.pearson("f", "r").alias("ic"))
    s = d.agg(F.avg(F.when(F.col("fold") == "train", F.col("ic"))).alias("train_ic"), F.avg(F.when(F.col("fold") == "test", F.col("ic"))).alias("test_ic"))
    s = s.select("train_ic", "test_ic", quality.overfit_ratio(F.col("train_ic"), F.col("test_ic")).alias("overfit"), quality.robust_ic(F.col("train_ic"), F.col("test_ic")).alias("robust_ic"))
    return rounded(s).withColumn("overfit", F.round("overfit", 4))


# --- indicators ------------------------------------------------------------------------------------------------------

_FULL = f"{W} rows between 4 preceding and current row"


@query("indicator_bands", f"""with {SUPPLIER_MONTH}, b as (select *, case when count(close) over {last(20)} = 20 then avg(close) over {last(20)} end as m, case when count(close) over {last(20)} = 20 then stddev_pop(close) over {last(20)} end as sd,
 max(high) over {last(14)} as hi, min(low) over {last(14)} as lo, count(close) over {last(14)} as n14 from p)
 select symbol, date, round(m, 5) as bb_middle, round(m + 2 * sd, 5) as bb_upper, round(m - 2 * sd, 5) as bb_lower, round((close - (m - 2 * sd)) / (4 * sd + 1e-8), 5) + 0.0 as bbands_pctb, round(case when n14 = 14 then -100 * (hi - close) / nullif(hi - lo, 0) end, 5) + 0.0 as willr_14 from b""")
def bands(spark, sf_dir):
    out = indicators.willr(indicators.bbands(panels.supplier_month(spark, sf_dir)))
    return rounded(out.select("symbol", "date", "bb_middle", "bb_upper", "bb_lower", "bbands_pctb", "willr_14"), 5)


@query("indicator_cci", f"""with {SUPPLIER_MONTH}, b0 as (select *, (high + low + close) / 3 as tp from p), b as (select *, list(tp) over {last(20)} as a, avg(tp) over {last(20)} as m from b0)
 select symbol, date, round(case when len(a) = 20 then (tp - m) / nullif(0.015 * list_sum(list_transform(a, lambda x: abs(x - m))) / 20, 0) end, 5) + 0.0 as cci_20 from b""")
def cci(spark, sf_dir):
    return rounded(indicators.cci(panels.supplier_month(spark, sf_dir)).select("symbol", "date", "cci_20"), 5)


@query("indicator_obv", f"with {SUPPLIER_MONTH}, b as (select *, coalesce(sign(close - lag(close) over ({W})), 1) * volume as v from p) select symbol, date, round(sum(v) over ({W} rows between unbounded preceding and current row), 5) + 0.0 as obv from b")
def obv(spark, sf_dir):
    return rounded(indicators.obv(panels.supplier_month(spark, sf_dir)).select("symbol", "date", "obv"), 5)


def _wilder_sql(x: str, n: int, first: int) -> str:
    """The recursion written out: seed at row first + n - 1, decayed sums after it."""
    at = first + n - 1
    return f"select a.symbol, a.rn, case when a.rn >= {at} then max(case when b.rn = {at} then b.seed end) * pow({1 - 1 / n!r}, a.rn - {at}) + coalesce(sum(case when b.rn > {at} then b.{x} * pow({1 - 1 / n!r}, a.rn - b.rn) end), 0) / {n}.0 end as y from g a join g b on a.symbol = b.symbol and b.rn <= a.rn group by a.symbol, a.rn"


_RSI = f"n as (select *, row_number() over ({W}) as rn, close - lag(close) over ({W}) as d from p), u as (select *, greatest(d, 0) as up, greatest(-d, 0) as dn from n)"


@query("indicator_rsi", f"""with {SUPPLIER_MONTH}, {_RSI}, ga as (select symbol, rn, date, case when d is not null then up end as up, case when d is not null then dn end as dn from u),
 gu as (select symbol, rn, up as x, avg(up) over (partition by symbol order by rn rows between 13 preceding and current row) as seed from ga), gd as (select symbol, rn, dn as x, avg(dn) over (partition by symbol order by rn rows between 13 preceding and current row) as seed from ga),
 yu as ({_wilder_sql("x", 14, 2).replace("from g a join g b", "from gu a join gu b")}), yd as ({_wilder_sql("x", 14, 2).replace("from g a join g b", "from gd a join gd b")})
 select ga.symbol, date, round(100 * yu.y / nullif(yu.y + yd.y, 0), 5) + 0.0 as rsi_14 from ga join yu using (symbol, rn) join yd using (symbol, rn)""")
def rsi(spark, sf_dir):
    return rounded(indicators.rsi(panels.supplier_month(spark, sf_dir)).select("symbol", "date", "rsi_14"), 5)


@query("indicator_atr", f"""with {SUPPLIER_MONTH}, n as (select *, row_number() over ({W}) as rn, lag(close) over ({W}) as c from p),
 ga as (select symbol, rn, date, case when c is not null then greatest(high - low, abs(high - c), abs(low - c)) end as x from n), g as (select *, avg(x) over (partition by symbol order by rn rows between 13 preceding and current row) as seed from ga),
 y as ({_wilder_sql("x", 14, 2)}) select symbol, date, round(y, 5) + 0.0 as atr_14 from ga join y using (symbol, rn)""")
def atr(spark, sf_dir):
    return rounded(indicators.atr(panels.supplier_month(spark, sf_dir)).select("symbol", "date", "atr_14"), 5)


def _seeded_sql(source: str, x: str, rate: float, n: int, first: int) -> str:
    """The mean of rows first .. first + n - 1, then rate * x + (1 - rate) * the value before, written out."""
    at = first + n - 1
    return f"""select a.symbol, a.rn, case when a.rn >= {at} then max(case when b.rn = {at} then b.seed end) * pow({1 - rate!r}, a.rn - {at}) + {rate!r} * coalesce(sum(case when b.rn > {at} then b.x * pow({1 - rate!r}, a.rn - b.rn) end), 0) end as y
  from (select symbol, rn from {source}) a join (select symbol, rn, {x} as x, avg({x}) over (partition by symbol order by rn rows between {n - 1} preceding and current row) as seed from {source}) b on a.symbol = b.symbol and b.rn <= a.rn group by a.symbol, a.rn"""


@query("indicator_macd_adx", f"""with {SUPPLIER_MONTH}, n as (select *, row_number() over ({W}) as rn, lag(close) over ({W}) as c, high - lag(high) over ({W}) as up, lag(low) over ({W}) - low as dn from p),
 m as (select symbol, date, rn, close, case when c is not null then greatest(high - low, abs(high - c), abs(low - c)) end as tr, case when up is not null then case when up > dn and up > 0 then up else 0 end end as mp, case when dn is not null then case when dn > up and dn > 0 then dn else 0 end end as mq from n),
 ef as ({_seeded_sql("m", "close", 2 / 13, 12, 15)}), es as ({_seeded_sql("m", "close", 2 / 27, 26, 1)}), mm as (select symbol, rn, ef.y - es.y as macd from ef join es using (symbol, rn)), sg as ({_seeded_sql("mm", "macd", 2 / 10, 9, 26)}),
 st as ({_seeded_sql("m", "tr", 1 / 14, 14, 2)}), sp as ({_seeded_sql("m", "mp", 1 / 14, 14, 2)}), sq as ({_seeded_sql("m", "mq", 1 / 14, 14, 2)}),
 pq as (select symbol, rn, sp.y / nullif(st.y, 0) as p, sq.y / nullif(st.y, 0) as q from st join sp using (symbol, rn) join sq using (symbol, rn)), dx as (select symbol, rn, coalesce(100 * abs(p - q) / nullif(p + q, 0), 0) as dx from pq), ax as ({_seeded_sql("dx", "dx", 1 / 14, 14, 15)})
 select m.symbol, date, round(macd, 5) + 0.0 as macd, round(sg.y, 5) + 0.0 as macd_signal, round(macd - sg.y, 5) + 0.0 as macd_hist, round(ax.y, 5) + 0.0 as adx_14 from m join mm using (symbol, rn) join sg using (symbol, rn) join ax using (symbol, rn)""")
def macd_adx(spark, sf_dir):
    out = indicators.adx(indicators.macd(panels.supplier_month(spark, sf_dir)))
    return rounded(out.select("symbol", "date", "macd", "macd_signal", "macd_hist", "adx_14"), 5)


@query("forward_fill", f'with {USER_DAY}, x as (select symbol, date, case when volume > 3 then close end as c from p) select symbol, date, last_value(c ignore nulls) over ({W} rows between unbounded preceding and current row) as filled, c - lag(c) over ({W}) as step from x')
def forward_fill(spark, sf_dir):
    x = panels.user_day(spark, sf_dir).select("symbol", "date", F.when(F.col("volume") > 3, F.col("close")).alias("c"))
    w = rolling.by("symbol", "date")
    return x.select("symbol", "date", F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("filled"), (F.col("c") - F.lag("c").over(w)).alias("step"))
