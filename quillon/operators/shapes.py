"""Relational shapes: as-of, interval and step joins, dominance, ranking, keep-first, set algebra.

None of them broadcasts without a bound, and none collects a group that the operator itself doesn't need whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_order(df: DataFrame, by: list[str], order: str, reads: list[str], extra: str, begin, step) -> DataFrame:
    """df with columns (DDL in extra) that depend on all rows before in the group: step(state, row) gives the next state and
    the new values; begin() gives a group's first state. For recursions that no window can say. Rows stream through sorted
    partitions: a group is one task's, but never held."""
    from pyspark.sql.types import StructType

    given = df.repartition(*by).sortWithinPartitions(*by, order)
    more = StructType.fromDDL(extra)
    schema = StructType([*df.schema.fields, *more.fields])
    keys, names = list(by), [f.name for f in more.fields]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(more)]
        now, state = None, None
        for b in batches:
            at = {c: b.column(b.schema.names.index(c)).to_pylist() for c in dict.fromkeys([*keys, *reads])}
            made = []
            for i in range(b.num_rows):
                key = tuple(at[c][i] for c in keys)
                if now is None or key != now:
                    now, state = key, begin()
                state, new = step(state, {c: at[c][i] for c in reads})
                made.append(new)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[n] for m in made], k) for n, k in zip(names, kinds, strict=True))], names=[*b.schema.names, *names])

    return given.mapInArrow(run, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if a count proves that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """left with columns of the latest right row of the same key at or before it (null if none). One exchange on the key: the
    sides are interleaved and the last right row is carried on as a struct, so a matched row may hold nulls."""
    extra = [c for c in left.columns if c not in by]
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*extra).alias("_left"), F.lit(None).cast(_struct_type(right, columns)).alias("_right"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*columns).alias("_right")).where("_at is not null")
    w = Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*by, *[F.col(f"_left.{c}") for c in extra], *[F.col(f"_found.{c}") for c in columns])


def _struct_type(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def first_interval(points: DataFrame, intervals: DataFrame, key: Column, low: str, high: str, order: str, columns: list[str], point_id: list[str], by: list[str] | None = None) -> DataFrame:
    """points with columns of the first interval (least order) of the same key that holds them; both ends belong to it.
    Intervals of a key should be few: they meet all its points."""
    cond = (key >= F.col(low)) & (key <= F.col(high))
    rows = points.join(intervals, by, "left") if by else points.crossJoin(F.broadcast(intervals))  # without keys: a written list
    grouped = rows.groupBy(*point_id).agg(F.min(F.when(cond, F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_v")))).alias("_m"))
    return grouped.select(*point_id, *[F.col(f"_m._v.{c}") for c in columns])


def step(value: Column, steps: list[tuple], before) -> Column:
    """The label of the greatest boundary at or below value, else before. steps: (boundary, label) of a written list."""
    out = F.lit(before)
    for boundary, label in sorted(steps, key=lambda s: s[0]):
        out = F.when(value >= F.lit(boundary), F.lit(label)).otherwise(out)
    return out


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group. Spark cuts groups to k in every task before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def top_by_metrics(df: DataFrame, by: list[str], metrics: list[str], ties: list[Column], k: int) -> DataFrame:
    """The k greatest of each group by each metric: df with metric, value and rank. One pass and one exchange for all
    metrics."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(*df.columns, "_m.*")
    return top_per_group(long, [*by, "metric"], [F.col("value").desc_nulls_last(), *ties], k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in a written order (dropDuplicates would take any)."""
    return top_per_group(df, keys, order, 1, "_rn").drop("_rn")


def compare_periods(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], labels: tuple[str, str]) -> DataFrame:
    """Full outer join with suffixed values and changes; an absent side counts 0 in changes only."""
    x = a.select(*keys, *[F.col(v).alias(f"{v}_{labels[0]}") for v in values])
    y = b.select(*keys, *[F.col(v).alias(f"{v}_{labels[1]}") for v in values])
    out = x.join(y, keys, "full")
    change = {f"{v}_change": F.coalesce(f"{v}_{labels[1]}", F.lit(0.0)) - F.coalesce(f"{v}_{labels[0]}", F.lit(0.0)) for v in values}
    return out.withColumns(change)


def pareto_front(df: DataFrame, objectives: list[str], fan_in: int = 8) -> DataFrame:
    """Rows that no other row beats on one objective without losing on another; nulls count 0.

    A tree of fronts: every task thins its own rows, then fan_in tasks' survivors meet in one, level by level; only fronts
    are exchanged. Equal rows don't beat each other."""
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in objectives])
    v = df.withColumn("_v", vector)
    width = len(objectives)

    def front_of(batches):
        import numpy as np
        import pyarrow as pa

        held = np.zeros((0, width))
        for b in batches:
            rows = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, width)
            held = _front(np.concatenate([held, rows]))
        yield pa.RecordBatch.from_arrays([pa.array(held.tolist(), pa.list_(pa.float64()))], names=["_v"])

    front, n = v.select("_v").mapInArrow(front_of, "_v array<double>"), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        front = front.repartition(n).mapInArrow(front_of, "_v array<double>")
        if n == 1:
            return v.join(front, "_v", "left_semi").select(*df.columns)
        n = -(-n // fan_in)


def _front(rows, block: int = 256):
    import numpy as np

    rows = np.unique(rows, axis=0)
    rows = rows[np.argsort(-rows.sum(axis=1), kind="stable")]  # only rows of a greater sum can beat a row
    keep = rows[:0]
    for a in range(0, len(rows), block):
        some = rows[a : a + block]
        for by in (keep, some):
            if len(by) and len(some):
                beaten = ((by[None] >= some[:, None]).all(axis=2) & (by[None] > some[:, None]).any(axis=2)).any(axis=1)
                some = some[~beaten]
        keep = np.concatenate([keep, some])
    return keep


def ranked(df: DataFrame, key: Column, ties: list[Column], name: str = "rank", pieces: int = 256) -> DataFrame:
    """df with its place (from 1) by descending key, then ties; nulls last. No task sees all rows: keys are cut at quantiles
    (approximate ones: any cut is right), pieces are counted, and each is numbered by itself from its offset. Rows of one
    key stay together."""
    cuts = df.agg(F.percentile_approx(key.cast("double"), [k / pieces for k in range(1, pieces)], 20 * pieces).alias("c")).first().c or []
    cuts = sorted(set(cuts), reverse=True)  # fewer than `pieces` numbers
    listed = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    at = F.when(key.isNull(), len(cuts) + 1).otherwise(F.size(F.filter(listed, lambda c: c > key)))
    x = df.withColumns({"_key": key, "_piece": at})
    counts = x.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # over the pieces alone
    offsets = counts.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_piece").orderBy(F.col("_key").desc_nulls_last(), *ties))
    return x.withColumn(name, own).join(F.broadcast(offsets), "_piece").withColumn(name, F.col(name) + F.col("_before")).drop("_key", "_piece", "_before")  # at most pieces + 1 offsets


def islands(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: by, run, value, first, last, n."""
    w = Window.partitionBy(*by).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    run = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return run.groupBy(*by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def mode_least(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value, ties to the least."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value), F.max("_n").alias("n"))


def zero_filled(counts: DataFrame, key: str, count: str, keys: list[str]) -> DataFrame:
    """Counts of a written list of keys, 0 where there is none."""
    listed = counts.sparkSession.createDataFrame([(k,) for k in keys], f"{key} string")
    return listed.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count))


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds (a null condition doesn't), null if none."""
    out = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def all_failures(rules: list[tuple[Column, str]]) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def safe_rate(n: Column, d: Column, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.when(d > 0, n / F.nullif(d.cast("double"), F.lit(0.0))), digits), F.lit(0.0))
