"""Rolling operators: each symbol by itself, over its last n rows (not days). Columns in, Columns out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TINY = 1e-8


def by(symbol: str, date: str) -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(date)


def last_rows(n: int, symbol: str, date: str) -> WindowSpec:
    return by(symbol, date).rowsBetween(-(n - 1), 0)


def ts_mean(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return F.avg(x).over(last_rows(n, symbol, date))


def ts_std(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return F.stddev_samp(x).over(last_rows(n, symbol, date))


def ts_sum(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return F.sum(x).over(last_rows(n, symbol, date))


def ts_min(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return F.min(x).over(last_rows(n, symbol, date))


def ts_max(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return F.max(x).over(last_rows(n, symbol, date))


def ts_delta(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return x - F.lag(x, n).over(by(symbol, date))


def ts_delay(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return F.lag(x, n).over(by(symbol, date))


ts_shift = ts_delay


def ts_pct_change(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    """Change against n rows before, both with nulls filled forward; null on a base of 0."""
    seen = by(symbol, date).rowsBetween(Window.unboundedPreceding, 0)
    then = by(symbol, date).rowsBetween(Window.unboundedPreceding, -n)
    return F.last(x, ignorenulls=True).over(seen) / F.nullif(F.last(x, ignorenulls=True).over(then), F.lit(0.0)) - 1


def ts_zscore(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return (x - ts_mean(x, n, symbol, date)) / (ts_std(x, n, symbol, date) + TINY)


def ts_rank(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    """Percentile rank of the row's value in its window, average ties, over the non-null values."""
    a = F.collect_list(x).over(last_rows(n, symbol, date))
    below, same = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(a))


def _arg(x: Column, n: int, best, symbol: str, date: str) -> Column:
    """First position of the extreme (of the first null, if the window holds one) over the window's rows less one."""
    a = F.transform(F.collect_list(F.struct(x.alias("v"))).over(last_rows(n, symbol, date)), lambda s: s["v"])
    flags = F.transform(a, lambda v: v.isNull())
    at = F.when(F.array_contains(flags, True), F.array_position(flags, True)).otherwise(F.array_position(a, best(a)))
    return F.when(best(a).isNotNull(), (at - 1) / F.greatest(F.lit(1), F.size(a) - 1))


def ts_argmax(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return _arg(x, n, F.array_max, symbol, date)


def ts_argmin(x: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    return _arg(x, n, F.array_min, symbol, date)


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_cov(x: Column, y: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    """Over the rows where both are known, two at least."""
    u, v = _pair(x, y)
    return F.covar_samp(u, v).over(last_rows(n, symbol, date))


def ts_corr(x: Column, y: Column, n: int, symbol: str = "symbol", date: str = "date") -> Column:
    """Pearson over the rows where both are known; null where one of them is constant."""
    w = last_rows(n, symbol, date)
    u, v = _pair(x, y)
    spread = F.stddev_samp(u).over(w) * F.stddev_samp(v).over(w)
    flat = (F.min(u).over(w) == F.max(u).over(w)) | (F.min(v).over(w) == F.max(v).over(w))
    return F.when(~flat, F.covar_samp(u, v).over(w) / F.nullif(spread, F.lit(0.0)))


def with_decayed(df: DataFrame, sums: dict[str, tuple[Column, float]], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """df with, for each name, the sum over all rows so far of value * q ** (rows since); nulls add nothing.

    No recursion: positions are cut into blocks so long that what lies before the previous block has decayed below 1e-100,
    and inside a block a prefix sum of value / q ** position is scaled back. Linear in the rows of a symbol."""
    out, drop = df.withColumn("_pos", F.row_number().over(by(symbol, date)) - 1), ["_pos"]
    for k, (name, (x, q)) in enumerate(sums.items()):
        if not 0 < q < 1:
            raise ValueError("the decay must lie between 0 and 1")
        size = max(2, math.floor(100 * math.log(10) / -math.log(q)))
        block, at, scaled = f"_b{k}", F.col("_pos") % size, f"_s{k}"
        out = out.withColumns({block: F.floor(F.col("_pos") / size), scaled: x * F.pow(F.lit(1 / q), at.cast("double"))})
        here = Window.partitionBy(symbol).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        own = F.sum(scaled).over(Window.partitionBy(symbol, block).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
        before = F.sum(scaled).over(Window.partitionBy(symbol).orderBy(block).rangeBetween(-1, -1))
        seen = F.count(x).over(here) > 0
        total = F.coalesce(own, F.lit(0.0)) + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(q), F.lit(float(size)))
        out = out.withColumn(name, F.when(seen, total * F.pow(F.lit(q), at.cast("double"))))
        drop += [block, scaled]
    return out.drop(*drop)


def with_ema(df: DataFrame, x: Column, span: float, name: str, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Exponential mean with adjusted weights (1 - 2 / (span + 1)) ** (rows since); a null carries the last value on. A span
    of 1 or less is the value itself (carried on)."""
    seen = by(symbol, date).rowsBetween(Window.unboundedPreceding, 0)
    if span <= 1:
        return df.withColumn(name, F.last(x, ignorenulls=True).over(seen))
    q = 1 - 2 / (span + 1)
    a, b = f"{name}_n", f"{name}_d"
    out = with_decayed(df, {a: (x, q), b: (F.when(x.isNotNull(), F.lit(1.0)), q)}, symbol, date)
    # taken where a value is known: there its weight is 1 and what the sums leave out is negligible
    ratio = F.when(x.isNotNull() & (F.col(b) > 0), F.col(a) / F.col(b))
    return out.withColumn(name, ratio).withColumn(name, F.last(name, ignorenulls=True).over(seen)).drop(a, b)
