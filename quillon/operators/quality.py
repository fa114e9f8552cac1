"""Factor quality and backtests: daily aggregates first, then scalars over days. One row out unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cross

TINY, YEAR = 1e-8, 252


def common(panel: DataFrame, factor: str, target: str = "forward_return") -> DataFrame:
    """symbol, date, f, r where both are known."""
    return panel.select("symbol", "date", F.col(f"`{factor}`").alias("f"), F.col(f"`{target}`").alias("r")).where("f is not null and r is not null")


def pearson(x: str, y: str) -> Column:
    """Aggregate: null on fewer than two rows or a constant side (corr() raises there under ANSI)."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def daily_ic(panel: DataFrame, factor: str, target: str = "forward_return") -> DataFrame:
    return common(panel, factor, target).groupBy("date").agg(pearson("f", "r").alias("ic"))


def daily_rank_ic(panel: DataFrame, factor: str, target: str = "forward_return") -> DataFrame:
    c = common(panel, factor, target)
    ranked = cross.with_columns(c, {"_rf": ("cs_rank", "f"), "_rr": ("cs_rank", "r")})
    return ranked.groupBy("date").agg(pearson("_rf", "_rr").alias("ic"))


def ic_score(daily: DataFrame) -> DataFrame:
    return daily.agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"))


def icir_score(daily: DataFrame) -> DataFrame:
    return daily.agg(F.coalesce(F.avg("ic") / (F.stddev_samp("ic") + TINY), F.lit(0.0)).alias("icir"))


def _moves(panel: DataFrame, factor: str) -> DataFrame:
    weight = cross.with_columns(panel.select("symbol", "date", F.col(f"`{factor}`").alias("f")), {"w": ("abs_normalise", "f")})
    return weight.withColumn("t", F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("symbol").orderBy("date"))))


def turnover(panel: DataFrame, factor: str) -> DataFrame:
    """Mean over dates of the mean move of normalised weights; the first date has none."""
    return _moves(panel, factor).groupBy("date").agg(F.avg("t").alias("t")).agg(F.coalesce(F.avg("t"), F.lit(0.0)).alias("turnover"))


def daily_turnover(panel: DataFrame, factor: str) -> DataFrame:
    """Summed moves by date; the first date counts as 0."""
    return _moves(panel, factor).groupBy("date").agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("turnover"))


def long_short(panel: DataFrame, factor: str, buckets: int = 5, target: str = "forward_return") -> DataFrame:
    """date, ls: mean return of the highest bucket less that of the lowest; a missing side counts 0, a date with neither is
    left out."""
    c = cross.with_columns(common(panel, factor, target), {"b": ("bucket", "f", buckets)})
    side = lambda k: F.avg(F.when(F.col("b") == k, F.col("r")))
    d = c.groupBy("date").agg(side(buckets - 1).alias("hi"), side(0).alias("lo")).where("hi is not null or lo is not null")
    return d.select("date", (F.coalesce("hi", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0))).alias("ls"))


def long_short_many(long: DataFrame, buckets: int = 5) -> DataFrame:
    """factor, date, ls of many factors in one pass over (factor, date, f, r)."""
    c = cross.with_columns(long.where("f is not null and r is not null"), {"b": ("bucket", "f", buckets)}, ["factor", "date"])
    side = lambda k: F.avg(F.when(F.col("b") == k, F.col("r")))
    d = c.groupBy("factor", "date").agg(side(buckets - 1).alias("hi"), side(0).alias("lo")).where("hi is not null or lo is not null")
    return d.select("factor", "date", (F.coalesce("hi", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0))).alias("ls"))


def equity(daily: DataFrame, value: str = "ls", share: float = 1.0) -> DataFrame:
    """date, ls, equity, drawdown with a share of the capital at work. One task, over daily aggregates only."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.product(1 + share * F.col(value)).over(w))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def sharpe(value: str) -> Column:
    return F.avg(value) / (F.stddev_samp(value) + TINY) * math.sqrt(YEAR)


def backtest(panel: DataFrame, factor: str, buckets: int = 5, cost: float = 0.001, share: float = 1.0) -> DataFrame:
    """days, annual_return, sharpe, max_drawdown, turnover, cost_adjusted. Turnover is of the whole factor, returns of the
    rows that have one."""
    ls = equity(long_short(panel, factor, buckets), share=share).join(daily_turnover(panel, factor), "date", "full")
    return ls.agg(
        F.count("ls").alias("days"), (F.avg("ls") * YEAR).alias("annual_return"), F.coalesce(sharpe("ls"), F.lit(0.0)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover"),
        (F.avg(F.col("ls") - 2 * cost * F.coalesce("turnover", F.lit(0.0))) * YEAR).alias("cost_adjusted"),
    )


def scorecard(panel: DataFrame, factors: list[str], target: str = "forward_return", buckets: int = 5) -> DataFrame:
    """factor, ic, icir, turnover, score for many factors in one pass: the panel is unpivoted once and every aggregate is
    by (factor, date), so the cost grows with rows, not with jobs."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in factors)
    long = panel.select("symbol", "date", F.col(f"`{target}`").alias("r"), F.expr(f"stack({len(factors)}, {pairs}) as (factor, f)"))
    w = cross.with_columns(long, {"w": ("abs_normalise", "f")}, ["factor", "date"])
    w = w.withColumn("t", F.abs(F.col("w") - F.lag("w").over(Window.partitionBy("factor", "symbol").orderBy("date"))))
    both = F.col("f").isNotNull() & F.col("r").isNotNull()
    w = w.withColumns({"x": F.when(both, F.col("f")), "y": F.when(both, F.col("r"))})
    daily = w.groupBy("factor", "date").agg(pearson("x", "y").alias("ic"), F.avg("t").alias("t"))
    out = daily.groupBy("factor").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"), F.coalesce(F.avg("ic") / (F.stddev_samp("ic") + TINY), F.lit(0.0)).alias("icir"), F.coalesce(F.avg("t"), F.lit(0.0)).alias("turnover"))
    return out.withColumn("score", combined_score(F.col("ic"), F.col("icir"), F.col("turnover")))


def combined_score(ic: Column, icir: Column, turn: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.abs(ic) + 0.3 * F.least(F.lit(1.0), F.abs(icir)) - 0.5 * turn))


def composite_score(ic: Column, test_ic: Column, sharpe_: Column, rank_ic: Column, mdd: Column, turn: Column) -> Column:
    return 0.35 * ic + 0.25 * test_ic + 0.25 * sharpe_ + 0.15 * rank_ic - 0.10 * F.greatest(F.lit(0.0), -mdd) - 0.05 * F.least(turn, F.lit(2.0))


def robust_ic(train: Column, test: Column) -> Column:
    """-infinity if unknown, -1 if the signs differ, else the test value."""
    return F.when(train.isNull() | test.isNull(), F.lit(float("-inf"))).when(train * test < 0, -1.0).otherwise(test)


def overfit_ratio(train: Column, test: Column) -> Column:
    return F.when(F.abs(train) < TINY, 0.0).otherwise((train - test) / F.nullif(F.abs(train), F.lit(0.0)))


def enhanced_fitness(ic: Column, rank_ic: Column, sharpe_: Column, annual: Column, mdd: Column, turn: Column) -> Column:
    """Of train figures alone: -infinity without an IC; other unknown ones count 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    gain = 0.35 * z(sharpe_) + 0.25 * z(annual) + 0.25 * F.abs(ic) + 0.10 * F.abs(z(rank_ic))
    loss = 0.15 * F.greatest(F.lit(0.0), -z(mdd)) + 0.15 * F.least(z(turn), F.lit(2.0))
    return F.when(ic.isNull(), F.lit(float("-inf"))).otherwise(gain - loss)


def weight_fitness(cost_adjusted: Column, sharpe_: Column, ic: Column, turn: Column, mdd: Column, cap: float) -> Column:
    """-infinity above the turnover cap."""
    score = 0.45 * cost_adjusted + 0.30 * F.coalesce(sharpe_, F.lit(0.0)) + 0.15 * F.abs(ic) - 0.05 * turn - 0.05 * F.greatest(F.lit(0.0), -mdd)
    return F.when(turn > cap, F.lit(float("-inf"))).otherwise(score)


def degenerate(panel: DataFrame, factor: str, null_share: float = 0.3, coverage: float | None = None, spread: float = TINY, sample: bool = False) -> DataFrame:
    """null_share, spread, coverage and whether the factor is degenerate: too many nulls, hardly any spread (an empty factor has
    none), or, where a coverage is asked for, too low a mean share of known values by date. The population takes the spread
    over all values (sample=False), the library's cleaner that of a sample, 0.2 of nulls and a coverage of 0.5."""
    x = F.col(f"`{factor}`")
    n, known = F.sum("n"), F.sum("k")
    by_day = panel.groupBy("date").agg(F.count("*").alias("n"), F.count(x).alias("k"))
    shares = by_day.agg((1 - known / F.nullif(n, F.lit(0))).alias("null_share"), F.avg(F.col("k") / F.col("n")).alias("coverage"))
    # the deviation is merged from centred moments: sums of squares would find a spread in large constants
    flat = panel.agg((F.stddev_samp(x) if sample else F.stddev_pop(x)).alias("spread"), (F.min(x) == F.max(x)).alias("constant"))
    a = shares.crossJoin(F.broadcast(flat)).withColumn("spread", F.when(F.col("constant"), 0.0).otherwise(F.col("spread"))).drop("constant")  # one row each
    bad = (F.col("null_share") > null_share) | F.coalesce(F.col("spread") < spread, F.lit(True))
    if coverage is not None:
        bad = bad | F.coalesce(F.col("coverage") < coverage, F.lit(True))
    return a.select("null_share", "spread", "coverage", F.coalesce(bad, F.lit(True)).alias("degenerate"))


def trend(series: DataFrame, order: str, value: str, last: int) -> DataFrame:
    """slope of the last points against 0, 1, ...; 0 with fewer points than asked for."""
    some = series.orderBy(F.col(order).desc()).limit(last)
    x = some.withColumn("x", F.row_number().over(Window.orderBy(order)) - 1)
    return x.agg(F.when(F.count(value) >= last, F.coalesce(F.regr_slope(F.col(value), F.col("x")), F.lit(0.0))).otherwise(0.0).alias("slope"))


def combination_weights(table: DataFrame, how: str, ic: str = "ic", sharpe_: str = "sharpe", vol: str = "vol") -> DataFrame:
    """table (a row for each factor) with weight: equal; or shares, of the sum of absolute values, of ic, of sharpe or of
    inverse vol (risk_parity), the last two with the sign of ic. Equal where the shares cancel out; nulls count 0."""
    all_ = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sign = F.signum(F.col(ic))
    raw = {"equal": F.lit(1.0), "ic": F.col(ic), "sharpe": sign * F.col(sharpe_), "risk_parity": sign / (F.col(vol) + 1e-12)}[how]
    out = table.withColumn("_raw", F.coalesce(raw.cast("double"), F.lit(0.0)))
    share = F.col("_raw") / (F.sum(F.abs("_raw")).over(all_) + 1e-12)
    out = out.withColumn("_share", share)
    return out.withColumn("weight", F.when(F.abs(F.sum("_share").over(all_)) < 1e-6, 1.0 / F.count("*").over(all_)).otherwise(F.col("_share"))).drop("_raw", "_share")


def ic_weights(table: DataFrame, ic: str = "ic") -> DataFrame:
    """Signed shares of absolute IC."""
    all_ = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table.withColumn("weight", F.col(ic) / (F.sum(F.abs(ic)).over(all_) + TINY))


def combine(panel: DataFrame, weights: dict[str, float], out: str = "combined", drop_incomplete: bool = False) -> DataFrame:
    """Weighted sum of z-scores; a null in any factor gives null, or drops the row before z-scores are taken."""
    p = panel.dropna(subset=list(weights)) if drop_incomplete else panel
    z = cross.with_columns(p, {f"_z{k}": ("cs_zscore", f) for k, f in enumerate(weights)})
    total = None
    for k, w in enumerate(weights.values()):
        part = F.lit(float(w)) * F.col(f"_z{k}")
        total = part if total is None else total + part
    return z.withColumn(out, total).drop(*[f"_z{k}" for k in range(len(weights))])
