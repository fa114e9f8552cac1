"""Balanced shards by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id, row number), so that equal texts lie side by side. Bytes below
candidate boundaries are counted exactly across all partitions; boundaries are refined digit by digit until each meets the
tolerance, first between texts and, only inside a group of copies that no such cut can balance, between its rows. Then
one exchange deals out slim rows (no texts), by pieces of shards that are even even if a third of all rows are copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_below, drop_staged, fresh, staged

SHARDS = 8
#: Bytes by which a shard may miss the mean, as a share of it, before a boundary is refined.
TOLERANCE = 0.002
_DIGIT = 12


def _digit(level: int) -> Column:
    """Digit of the key at a level: 12 bits at a time of h1, then of h2, then of h3, in unsigned order."""
    part, k = divmod(level, 6)
    shift = max(0, 64 - _DIGIT * (k + 1))
    bits = min(_DIGIT, 64 - _DIGIT * k)
    return F.shiftrightunsigned(F.col(f"h{part + 1}"), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def _inside(prefix: tuple[int, ...]) -> Column:
    """Rows whose key begins with these digits."""
    at = F.lit(True)
    for level, d in enumerate(prefix):
        at = at & (_digit(level) == d)
    return at


def _below(prefix: tuple[int, ...]) -> Column:
    """Rows whose key lies below the least key with this prefix."""
    test = F.lit(False)
    for level in reversed(range(len(prefix))):
        d = _digit(level)
        test = (d < prefix[level]) | ((d == prefix[level]) & test)
    return test


def splitters(slim: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """shards - 1 boundaries as digit prefixes: a row belongs to the shard after all boundaries that its key isn't below.

    Each round counts bytes under the 4096 next digits of the prefixes still open: at most 4096 rows for each boundary
    reach the driver. A boundary is settled when the bytes below it are within the tolerance of their mark, or digits end."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    marks = [total * (k + 1) / shards for k in range(shards - 1)]
    slack = tolerance * total / shards
    done: dict[int, tuple[int, ...]] = {}
    state = {k: ((), 0) for k in range(shards - 1)}  # open boundaries: the prefix they lie in, and the bytes before it
    for level in range(18):
        if not state or not total:
            break
        prefixes = sorted({p for p, _ in state.values()})
        which = F.lit(None).cast("int")
        for n, p in enumerate(prefixes):
            which = F.when(_inside(p), n).otherwise(which)
        counted = slim.select(which.alias("p"), _digit(level).alias("d"), "size").where("p is not null")
        histogram: dict[int, list[tuple[int, int]]] = {}
        for r in counted.groupBy("p", "d").agg(F.sum("size").alias("b")).collect():
            histogram.setdefault(r.p, []).append((r.d, r.b))
        still = {}
        for k, (p, before) in state.items():
            at, best = before, None
            holder = None
            for d, b in sorted(histogram[prefixes.index(p)]):
                for cut, bytes_below in (((*p, d), at), ((*p, d + 1), at + b)):
                    if best is None or abs(bytes_below - marks[k]) < best[0]:
                        best = abs(bytes_below - marks[k]), cut
                if at <= marks[k] < at + b:
                    holder = (*p, d), at
                at += b
            if best[0] <= slack or holder is None or level == 17:
                done[k] = best[1]
            else:
                still[k] = holder
        state = still
    return [done.get(k, ()) for k in range(shards - 1)]


#: Most pieces that numbering is broadcast for: 2 ** 16 of the first digits, and 128 for each of fewer than 2 * 1024 hot texts
#: and hot rows, once for each boundary that may cut one.
MOST_PIECES = 500_000


def keyed(df: DataFrame, id: str, text: str, row: str | None = None) -> DataFrame:
    """id, size, text_crc32 and the key. Nulls: a null text has no bytes and the checksum of none; a null id is a value."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.col(f"`{id}`").alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"),
        F.xxhash64(t).alias("h1"), F.xxhash64(F.col(f"`{id}`").cast("string")).alias("h2"), (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("h3"),
    )


def assign(df: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, row: str | None = None) -> DataFrame:
    """id, size, text_crc32, shard and slot (0, 1, ... in each shard) of every row; bytes of the shards are near equal. row: a
    column that numbers the rows, which is returned too; else numbers are made.

    Equal texts share a shard unless a boundary has to cut a group larger than the tolerance. Repeated rows are rows of
    their own; an empty table gives an empty result; with fewer rows than shards some shards are empty."""
    slim = staged(keyed(df, id, text, row), "sizes")
    n = slim.count()
    cuts = splitters(slim, shards, tolerance)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(~_below(cut), 1).otherwise(0) if cut else shard
    # pieces of about 1 / 1024 of the rows: the first digits of h1, and for the few texts with more copies those of h2, h3
    bits = min(16, max(8, math.ceil(math.log2(max(n, 1) / 50_000 + 1)) + 8))
    often = max(64, n >> 10)
    hot1 = [r.h1 for r in slim.groupBy("h1").count().where(F.col("count") > often).collect()]  # fewer than 1024
    hot2 = [r.h2 for r in slim.where(F.col("h1").isin(hot1)).groupBy("h1", "h2").count().where(F.col("count") > often).collect()] if hot1 else []
    head = lambda c, b: F.shiftrightunsigned(c, 64 - b).cast("int")
    piece2 = F.when(F.col("h1").isin(hot1), head(F.col("h2"), 7)).otherwise(-1) if hot1 else F.lit(-1)
    piece3 = F.when(F.col("h1").isin(hot1) & F.col("h2").isin(hot2), head(F.xxhash64("h3"), 7)).otherwise(-1) if hot2 else F.lit(-1)
    placed = slim.select("*", shard.cast("int").alias("shard"), head(F.col("h1"), bits).alias("p1"), piece2.alias("p2"), piece3.alias("p3"))
    piece = ["shard", "p1", "p2", "p3"]
    sizes = placed.groupBy(*piece).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("p1", "p2", "p3").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    within = F.row_number().over(Window.partitionBy(*piece).orderBy("h1", "h2", "id", "h3")) - 1
    numbered = placed.withColumn("within", within)
    out = numbered.join(broadcast_below(starts, MOST_PIECES), piece)
    return out.select(
        F.col("id").alias(id), *([F.col("h3").alias(row)] if row else []), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("before") + F.col("within")).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> None:
    """Whole rows as Parquet under path/shard=k, each file of one shard. Every row is written once, whatever its id: rows are
    numbered in a copy in the shared folder, and joined by that number."""
    row, shard = fresh(df, "_row"), fresh(df, "shard")
    numbered = staged(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan = assign(numbered, shards, id, text, row=row).select(row, F.col("shard").alias(shard))
    out = numbered.join(plan, row)
    out.repartition(shard, F.pmod(F.xxhash64(row), F.lit(64))).drop(row).write.partitionBy(shard).parquet(path)
    drop_staged(numbered)
