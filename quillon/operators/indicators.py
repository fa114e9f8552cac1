"""Technical indicators. Wilder and exponential recursions are decayed sums (rolling.with_decayed), so no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rolling


def _pos(symbol: str, date: str) -> Column:
    return F.row_number().over(rolling.by(symbol, date))


def recursion(df: DataFrame, items: dict[str, tuple[Column, float, int, int]], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """For each name (x, rate, n, first): the mean of x over rows first .. first + n - 1 (from 1) is the value there, and
    each later value is rate * x + (1 - rate) * the one before; null earlier."""
    base = df.withColumn("_row", _pos(symbol, date))
    sums, drop = {}, ["_row"]
    for k, (name, (x, rate, n, first)) in enumerate(items.items()):
        base = base.withColumn(f"_x{k}", x)
        seed = F.avg(f"_x{k}").over(rolling.last_rows(n, symbol, date))
        base = base.withColumn(f"_y{k}", F.when(F.col("_row") == first + n - 1, seed / rate).when(F.col("_row") > first + n - 1, F.col(f"_x{k}")))
        sums[name] = (F.col(f"_y{k}"), 1 - rate)
        drop += [f"_x{k}", f"_y{k}"]
    out = rolling.with_decayed(base, sums, symbol, date)
    return out.withColumns({name: F.col(name) * rate for name, (_, rate, _, _) in items.items()}).drop(*drop)


def rsi(df: DataFrame, n: int = 14, close: str = "close", name: str = "rsi_14") -> DataFrame:
    w = rolling.by("symbol", "date")
    d = F.col(close) - F.lag(close).over(w)
    base = df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    out = recursion(base, {"_u": (F.col("_up"), 1 / n, n, 2), "_d": (F.col("_down"), 1 / n, n, 2)})
    return out.withColumn(name, 100 * F.col("_u") / F.nullif(F.col("_u") + F.col("_d"), F.lit(0.0))).drop("_up", "_down", "_u", "_d")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, close: str = "close") -> DataFrame:
    """macd, macd_signal, macd_hist; both means begin on row slow, the signal signal - 1 rows later."""
    out = recursion(df, {"_fast": (F.col(close), 2 / (fast + 1), fast, slow - fast + 1), "_slow": (F.col(close), 2 / (slow + 1), slow, 1)})
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow"))
    out = recursion(out, {"macd_signal": (F.col("macd"), 2 / (signal + 1), signal, slow)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def bbands(df: DataFrame, n: int = 20, k: float = 2.0, close: str = "close") -> DataFrame:
    """bb_upper, bb_middle, bb_lower, bbands_pctb; null before n rows."""
    w = rolling.last_rows(n, "symbol", "date")
    full = F.count(close).over(w) == n
    mid, sd = F.when(full, F.avg(close).over(w)), F.when(full, F.stddev_pop(close).over(w))
    out = df.withColumns({"bb_middle": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd})
    return out.withColumn("bbands_pctb", (F.col(close) - F.col("bb_lower")) / (F.col("bb_upper") - F.col("bb_lower") + 1e-8))


def cci(df: DataFrame, n: int = 20, name: str = "cci_20") -> DataFrame:
    w = rolling.last_rows(n, "symbol", "date")
    out = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumns({"_a": F.collect_list("_tp").over(w), "_m": F.avg("_tp").over(w)})
    dev = F.aggregate(F.col("_a"), F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / n
    return out.withColumn(name, F.when(F.size("_a") == n, (F.col("_tp") - F.col("_m")) / F.nullif(0.015 * dev, F.lit(0.0)))).drop("_tp", "_a", "_m")


def willr(df: DataFrame, n: int = 14, name: str = "willr_14") -> DataFrame:
    w = rolling.last_rows(n, "symbol", "date")
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    return df.withColumn(name, F.when(F.count("close").over(w) == n, -100 * (hi - F.col("close")) / F.nullif(hi - lo, F.lit(0.0))))


def _true_range() -> Column:
    c = F.lag("close").over(rolling.by("symbol", "date"))
    return F.when(c.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c)))


def atr(df: DataFrame, n: int = 14, name: str = "atr_14") -> DataFrame:
    return recursion(df.withColumn("_tr", _true_range()), {name: (F.col("_tr"), 1 / n, n, 2)}).drop("_tr")


def adx(df: DataFrame, n: int = 14, name: str = "adx_14") -> DataFrame:
    w = rolling.by("symbol", "date")
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    move = lambda a, b: F.when(a.isNotNull(), F.when((a > b) & (a > 0), a).otherwise(0.0))
    out = df.withColumns({"_tr": _true_range(), "_p": move(up, down), "_q": move(down, up)})
    out = recursion(out, {"_st": (F.col("_tr"), 1 / n, n, 2), "_sp": (F.col("_p"), 1 / n, n, 2), "_sq": (F.col("_q"), 1 / n, n, 2)})
    p, q = F.col("_sp") / F.nullif(F.col("_st"), F.lit(0.0)), F.col("_sq") / F.nullif(F.col("_st"), F.lit(0.0))
    out = out.withColumn("_dx", 100 * F.abs(p - q) / F.nullif(p + q, F.lit(0.0)))
    out = recursion(out, {name: (F.coalesce(F.col("_dx"), F.lit(0.0)), 1 / n, n, n + 1)})
    return out.drop("_tr", "_p", "_q", "_st", "_sp", "_sq", "_dx")


def obv(df: DataFrame, name: str = "obv") -> DataFrame:
    """Running volume signed by the move of the close; the first row counts its volume."""
    w = rolling.by("symbol", "date")
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(1.0))
    return df.withColumn("_v", sign * F.col("volume")).withColumn(name, F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v")
