"""Panels: one row for each symbol and date. Every NaN and infinity becomes null at this boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICE_COLUMNS = ["open", "high", "low", "close", "volume", "amount", "vwap"]


def known(c: Column) -> Column:
    """A double without NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def parse_date(c: Column, form: str = "yyyyMMdd") -> Column:
    """Dates from text; unreadable ones are null."""
    return F.try_to_timestamp(c.cast("string"), F.lit(form)).cast("date")


def with_returns(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    out = panel.withColumn("return", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
    return out.withColumn("forward_return", F.lead("return").over(w))


def bars(events: DataFrame, symbol: Column, at: Column, value: Column, order: Column) -> DataFrame:
    """Daily bars from single values: map-side aggregation, one exchange on (symbol, date)."""
    e = events.select(symbol.cast("string").alias("symbol"), at.cast("date").alias("date"), known(value).alias("v"), order.alias("o")).where("symbol is not null and date is not null")
    out = e.groupBy("symbol", "date").agg(
        F.min_by("v", "o").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "o").alias("close"),
        F.count("v").cast("double").alias("volume"), F.sum("v").alias("amount"),
    )
    return out.withColumn("vwap", F.col("amount") / F.nullif(F.col("volume"), F.lit(0.0)))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_returns(bars(e, F.col("user_id"), F.col("ts"), F.col("value"), F.struct("ts", "event_id")))


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier and month of shipping, with sector (nation) and market_cap (balance, where positive)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    unit = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    p = li.select(F.col("l_suppkey").alias("k"), F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("date").alias("date"), known(unit).alias("u"), "l_quantity", "l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber")
    o = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    p = p.groupBy("k", "date").agg(
        F.min_by("u", o).alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.max_by("u", o).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )
    p = p.withColumn("vwap", F.col("amount") / F.nullif(F.col("volume"), F.lit(0.0)))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").cast("string").alias("sector"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("market_cap"))
    p = p.join(s, p.k == s.s_suppkey, "left").drop("s_suppkey")  # a dimension: Spark broadcasts it by its size
    return with_returns(p.withColumn("symbol", F.col("k").cast("string")).drop("k"))


def split(panel: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Train up to and test from the day, which is in both. Filter before any window: folds start cold."""
    return panel.where(F.col("date") <= F.lit(day).cast("date")), panel.where(F.col("date") >= F.lit(day).cast("date"))


def three_way(panel: DataFrame, validation: str, test: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, v, t = F.col("date"), F.lit(validation).cast("date"), F.lit(test).cast("date")
    return panel.where(d <= v), panel.where((d >= v) & (d <= t)), panel.where(d >= t)


def folds(panel: DataFrame, day: str) -> DataFrame:
    """Both folds in one frame, tagged: one pass over the panel. Partition later windows by (fold, symbol) or (fold, date)."""
    d = F.lit(day).cast("date")
    tags = F.array_compact(F.array(F.when(F.col("date") <= d, F.lit("train")), F.when(F.col("date") >= d, F.lit("test"))))
    return panel.withColumn("fold", F.explode(tags))


def synthetic(spark: SparkSession, symbols: int, days: int, start: str = "2020-01-01", seed: int = 0) -> DataFrame:
    """A reproducible random panel on business days. Values depend on (seed, symbol, day) alone, so partitioning can't
    change them."""
    days_ = F.explode(F.filter(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), days * 2 + 7)), lambda d: ~F.dayofweek(d).isin(1, 7)))
    base = spark.range(symbols).select(F.format_string("%06d.SZ", F.col("id") + 1).alias("symbol"), days_.alias("date"))
    n = Window.partitionBy("symbol").orderBy("date")
    base = base.withColumn("_n", F.row_number().over(n)).where(F.col("_n") <= days)
    unit = lambda k: (F.pmod(F.xxhash64("symbol", "date", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(6.283185307179586 * unit(2))
    walk = F.sum("_r").over(n.rowsBetween(Window.unboundedPreceding, 0))
    out = base.withColumn("_r", normal * 0.02).withColumn("close", F.lit(20.0) * F.exp(walk))
    out = out.withColumns({"open": F.col("close") * (1 + (unit(3) - 0.5) * 0.01), "volume": F.floor(100_000 * (1 + 9 * unit(4))).cast("bigint")})
    out = out.withColumns({"high": F.greatest("open", "close") * (1 + unit(5) * 0.01), "low": F.least("open", "close") * (1 - unit(6) * 0.01)})
    out = out.withColumns({"vwap": (F.col("high") + F.col("low") + F.col("close")) / 3, "amount": F.col("close") * F.col("volume")})
    return with_returns(out.drop("_r", "_n"))
