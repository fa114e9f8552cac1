"""Cross-sectional operators: each date by itself.

with_columns() adds any number of them to a frame. Means, deviations, sums and regressions are aggregates by date (combined
before the exchange) joined back on the few dates, so no date is ever gathered in a task. Ranks and quantiles need an order:
while the whole frame is small enough for one task (by the planner's own bound of its size) all of them share one exchange
on the date; beyond that each date is cut into pieces at its quantiles, pieces are ordered by themselves, and values that
many rows share are counted instead of ordered. Both ways give the same values.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-8
#: A frame that the planner bounds by so many bytes may be ordered date by date in one task each.
ONE_TASK = 4 << 30
PIECES = 64
RANKED, MOMENTS, QUANTILES = {"cs_rank"}, {"cs_zscore", "abs_normalise", "sector_neutral", "cap_neutral"}, {"winsorize", "bucket"}


def fits_one_task(df: DataFrame) -> bool:
    """Whether the planner's estimate, an upper bound from file sizes, proves df small. Frames it knows nothing of aren't."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_TASK


def with_columns(df: DataFrame, items: dict[str, tuple], date: str | list[str] = "date", salt: str = "symbol", wide: bool | None = None) -> DataFrame:
    """df with a column for each name: (operator, column names and parameters ...): ("cs_rank", x), ("cs_zscore", x),
    ("abs_normalise", x), ("sector_neutral", x, sector), ("cap_neutral", x, cap), ("winsorize", x, low, high), ("bucket", x, n).
    Values are cast to double; a null value stays null; rows without a date have no cross-section and are null. wide: whether
    dates are cut into pieces (by default if df isn't proved small); salt spreads rows of one value."""
    dates = [date] if isinstance(date, str) else list(date)
    need_order = [n for n, i in items.items() if i[0] in RANKED | QUANTILES]
    if unknown := [i[0] for i in items.values() if i[0] not in RANKED | QUANTILES | MOMENTS]:
        raise ValueError(f"unknown operators {unknown}")
    wide = bool(need_order) and not fits_one_task(df) if wide is None else wide
    out = _moments(df, {n: i for n, i in items.items() if i[0] in MOMENTS}, dates)
    if not wide:
        return out.withColumns({n: _ordered(items[n], dates) for n in need_order}) if need_order else out
    for n in need_order:
        op, x, *rest = items[n]
        if op == "cs_rank":
            out = _wide_rank(out, x, n, dates, salt)
        else:
            low, high = (rest[0], rest[1]) if op == "winsorize" and rest else (0.01, 0.99)
            probs = [low, high] if op == "winsorize" else [k / rest[0] for k in range(rest[0] + 1)]
            q = f"_q_{n}"
            out = out.join(F.broadcast(wide_quantiles(df, x, probs, dates, salt).withColumnRenamed("q", q)), dates, "left")  # one row a date
            v = F.col(f"`{x}`").cast("double")
            out = out.withColumn(n, _clip(v, F.col(q)[0], F.col(q)[1]) if op == "winsorize" else _place(v, F.col(q))).drop(q)
    return out


def _moments(df: DataFrame, items: dict[str, tuple], dates: list[str]) -> DataFrame:
    """Aggregates of all items by one pass for each set of keys, joined back."""
    if not items:
        return df
    by_keys: dict[tuple, list] = {}
    for n, (op, x, *rest) in items.items():
        keys = (*dates, rest[0]) if op == "sector_neutral" else tuple(dates)
        by_keys.setdefault(keys, []).append((n, op, F.col(f"`{x}`").cast("double"), rest))
    out = df
    for keys, some in by_keys.items():
        aggs, made = [], {}
        for n, op, x, rest in some:
            a, b = f"_a_{n}", f"_b_{n}"
            if op == "cs_zscore":
                aggs += [F.avg(x).alias(a), F.stddev_samp(x).alias(b)]
                made[n] = (x - F.col(a)) / (F.col(b) + TINY)
            elif op == "abs_normalise":
                aggs.append(F.sum(F.abs(x)).alias(a))
                made[n] = x / (F.col(a) + TINY)
            elif op == "sector_neutral":
                aggs.append(F.avg(x).alias(a))
                made[n] = x - F.col(a)
            else:
                cap = F.col(f"`{rest[0]}`")
                size = F.when(cap > 0, F.log(cap))
                both = x.isNotNull() & size.isNotNull()
                u, v = F.when(both, x), F.when(both, size)
                aggs += [F.covar_samp(u, v).alias(a), F.var_samp(v).alias(b)]
                made[n] = u - v * (F.col(a) / F.nullif(F.col(b), F.lit(0.0)))
        stats = df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*aggs)
        on = [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(keys)]
        # one row a date (a century has 36,525): small by construction; with a sector Spark decides by size
        out = out.join(F.broadcast(stats) if len(keys) == len(dates) else stats, on, "left").withColumns(made)
        out = out.drop(*[f"_k{i}" for i in range(len(keys))], *[c for n, *_ in some for c in (f"_a_{n}", f"_b_{n}")])
    return out


def neutralise(df: DataFrame, x: str, out: str, sector: str | None = None, cap: str | None = None, date: str = "date", strict: bool = False) -> DataFrame:
    """x less its sector's mean, then less its regression on the logarithm of the cap, as `out`; a step whose column df doesn't
    have is left out, or raises if strict."""
    have, now, made = set(df.columns), x, []
    for op, by in (("sector_neutral", sector), ("cap_neutral", cap)):
        if by is None or by not in have:
            if by is not None and strict:
                raise ValueError(f"no column {by}")
            continue
        step = f"_{op}"
        df, now = with_columns(df, {step: (op, now, by)}, date), step
        made.append(step)
    return df.withColumn(out, F.col(f"`{now}`").cast("double")).drop(*made)


# --- an order, date by date -------------------------------------------------------------------------------------------


def _ordered(item: tuple, dates: list[str]) -> Column:
    op, x, *rest = item
    fn = {"cs_rank": cs_rank, "winsorize": winsorize, "bucket": bucket}[op]
    return fn(F.col(f"`{x}`").cast("double"), dates, *rest) if op != "bucket" else bucket(F.col(f"`{x}`").cast("double"), rest[0], dates)


def cs_rank(x: Column, date: str | list[str] = "date") -> Column:
    """Percentile rank with average ties over the non-null values; null stays null. One sort: the average rank of a tie is
    half the sum of its first and last position."""
    by = Window.partitionBy(date)
    order = by.orderBy(x.asc_nulls_last())
    last = F.round(F.cume_dist().over(order) * F.count("*").over(by))
    return F.when(x.isNotNull(), (F.rank().over(order) + last) / 2 / F.count(x).over(by))


def winsorize(x: Column, date: str | list[str] = "date", low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped to interpolated quantiles."""
    by = Window.partitionBy(date)
    return _clip(x, F.percentile(x, F.lit(low)).over(by), F.percentile(x, F.lit(high)).over(by))


def bucket(x: Column, buckets: int = 5, date: str | list[str] = "date") -> Column:
    """Quantile bucket 0 .. buckets - 1: interpolated edges, closed on the right, the lowest included; equal edges count
    once, so later buckets may stay empty; a constant cross-section has none."""
    return _place(x, F.percentile(x, F.array(*[F.lit(k / buckets) for k in range(buckets + 1)])).over(Window.partitionBy(date)))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def _place(x: Column, quantiles: Column) -> Column:
    edges = F.array_distinct(quantiles)
    return F.when(x.isNotNull() & (F.size(edges) > 1), F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < x)) - 1))


# --- an order in pieces -----------------------------------------------------------------------------------------------


def _pieces(df: DataFrame, x: str, dates: list[str], pieces: int) -> tuple[DataFrame, DataFrame]:
    """df with _x and _piece, and for each date _all (its non-null values) and _sizes (piece and rows, by piece).

    A date's cuts are approximate quantiles of it: any cut is right. Piece 2 k holds the values between two cuts, 2 k + 1
    those equal to a cut; so a value that many rows share is a piece of its own."""
    v = df.withColumn("_x", F.col(f"`{x}`").cast("double"))
    cuts = v.groupBy(*dates).agg(F.array_distinct(F.percentile_approx("_x", [k / pieces for k in range(1, pieces)], 20 * pieces)).alias("_cuts"))
    v = v.join(F.broadcast(cuts), dates, "left")  # one row a date
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    v = v.withColumn("_piece", F.when(F.col("_x").isNotNull(), 2 * below + F.array_contains("_cuts", F.col("_x")).cast("int"))).drop("_cuts")
    n = v.where("_piece is not null").groupBy(*dates, "_piece").agg(F.count("*").cast("long").alias("_n"), F.min("_x").alias("_v"))
    sizes = n.groupBy(*dates).agg(F.sum("_n").alias("_all"), F.array_sort(F.collect_list(F.struct("_piece", "_n", "_v"))).alias("_sizes"))  # at most 2 * pieces a date
    return v, sizes


def _wide_rank(df: DataFrame, x: str, name: str, dates: list[str], salt: str, pieces: int = PIECES) -> DataFrame:
    v, sizes = _pieces(df, x, dates, pieces)
    v = v.join(F.broadcast(sizes), dates, "left")
    before = F.aggregate(F.filter("_sizes", lambda s: s["_piece"] < F.col("_piece")), F.lit(0).cast("long"), lambda t, s: t + s["_n"])
    own = F.get(F.filter("_sizes", lambda s: s["_piece"] == F.col("_piece")), 0)["_n"]
    alike = F.col("_piece") % 2 == 1
    # rows of one value need no order: they are spread, and their place follows from the counts
    spread = F.when(alike | F.col("_piece").isNull(), F.pmod(F.xxhash64(salt), F.lit(pieces))).otherwise(0)
    v = v.withColumns({"_before": before, "_own": own, "_spread": spread}).drop("_sizes")
    by = Window.partitionBy(*dates, "_piece", "_spread")
    first = F.rank().over(by.orderBy("_x"))
    last = F.round(F.cume_dist().over(by.orderBy("_x")) * F.count("*").over(by))
    place = F.when(alike, F.col("_before") + (F.col("_own") + 1) / 2).otherwise(F.col("_before") + (first + last) / 2)
    return v.withColumn(name, F.when(F.col("_x").isNotNull(), place / F.col("_all"))).drop("_x", "_piece", "_all", "_before", "_own", "_spread")


def wide_quantiles(df: DataFrame, x: str, probs: list[float], dates: list[str], salt: str = "symbol", pieces: int = PIECES) -> DataFrame:
    """dates and q: the interpolated quantiles of each date. Only the pieces that hold a wanted place are ordered."""
    v, sizes = _pieces(df.select(*dates, x), x, dates, pieces)
    at = F.array(*[F.lit(float(p)) for p in probs])
    wanted = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p * (F.col("_all") - 1)), F.ceil(p * (F.col("_all") - 1))))))
    ends = F.transform(F.sequence(F.lit(1), F.size("_sizes")), lambda k: F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0).cast("long"), lambda t, s: t + s["_n"]))
    places = sizes.where("_all > 0").withColumns({"_ends": ends}).select(*dates, "_sizes", "_ends", F.explode(wanted).alias("_place"))
    k = F.size(F.filter("_ends", lambda e: e <= F.col("_place")))  # pieces that end before the place
    places = places.withColumn("_k", k)
    of = F.get("_sizes", F.col("_k"))
    places = places.select(*dates, "_place", of["_piece"].alias("_piece"), of["_v"].alias("_v"), (F.col("_place") - F.coalesce(F.get("_ends", F.col("_k") - 1), F.lit(0)) + 1).cast("int").alias("_nth"))
    known = places.where("_piece % 2 = 1").select(*dates, "_place", "_v")
    open_ = places.where("_piece % 2 = 0").drop("_v")
    held = v.where("_piece is not null").select(*dates, "_piece", "_x").join(F.broadcast(open_.select(*dates, "_piece").distinct()), [*dates, "_piece"], "left_semi")  # a few a date
    nth = held.withColumn("_nth", F.row_number().over(Window.partitionBy(*dates, "_piece").orderBy("_x")))
    found = nth.join(F.broadcast(open_), [*dates, "_piece", "_nth"]).select(*dates, "_place", F.col("_x").alias("_v"))
    values = known.unionByName(found).groupBy(*dates).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_m"))
    total = sizes.select(*dates, "_all").join(values, dates)

    def one(p):
        place = p * (F.col("_all") - 1)
        low, high = (F.try_element_at("_m", f(place)) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return total.select(*dates, F.transform(at, one).alias("q"))


