"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

The index is built once and written to the shared folder: blocks of vectors, inverted dimension by dimension, where a posting
segment lists the vectors of one dimension and quantised impact. Segments are processed in rounds of descending impact, one
addition of a shared impact per query and posting. For every vector and round the index holds the length of what the rounds so
far have left of it, small components and quantising errors alike; times the query's length that bounds how far its score can
still move. Processing stops when the vectors that the bound can't rule out are so few that scoring them exactly costs less
than going on. The k-th best score is carried from block to block, so later blocks stop early.

Queries and blocks meet in cells of a grid: blocks of queries against all blocks of vectors, dealt out by one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, staged

#: Queries scored side by side, vectors of an inverted block, rounds of impact, and blocks of one cell of the grid.
QUERY_BLOCK, VECTOR_BLOCK, LEVELS, CELL = 512, 4096, 12, 64
#: What a component costs in exact scoring, in postings.
RESCORE = 2


class Index:
    """Posting segments of one block of integer vectors (rows of v, all of one length)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, levels: int = LEVELS):
        self.ids, self.v = ids, v
        n, dims = v.shape
        top = int(np.quantile(np.abs(v), 0.99, method="higher")) if v.size else 0
        self.step = max(1, -(-top // levels))  # width of a level
        # nearest; what an outlier has beyond the highest level stays in the length left
        level = np.sign(v) * np.minimum((np.abs(v) + self.step // 2) // self.step, levels)
        self.rounds = int(np.abs(level).max(initial=0))
        # what is left of each vector before the first round and after each (rounds run from the highest level down)
        rest = v.astype(np.float64)
        left = [np.sqrt((rest * rest).sum(axis=1))]
        for r in range(self.rounds, 0, -1):
            now = np.abs(level) == r
            rest = np.where(now, v - level * self.step, rest)
            left.append(np.sqrt((rest * rest).sum(axis=1)))
        self.left = np.array(left) * (1 + 1e-9) + 1e-6
        # segments: by round, then dimension and sign
        row, dim = np.nonzero(level)
        own = level[row, dim]
        order = np.lexsort((row, own < 0, dim, -np.abs(own)))
        self.members = row[order].astype(np.int32)
        key = (np.abs(own[order]) * dims + dim[order]) * 2 + (own[order] < 0)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.segments = np.stack([self.rounds - np.abs(own[order][starts]), dim[order][starts], own[order][starts], starts], axis=1).astype(np.int64) if len(starts) else np.zeros((0, 4), np.int64)

    def packed(self) -> list[bytes]:
        """ids, vectors, left, members, segments and (step, rounds), as the index table holds them."""
        arrays = (self.ids.astype("<i8"), self.v.astype("<i4") if np.abs(self.v).max(initial=0) < 1 << 31 else self.v.astype("<i8"), self.left.astype("<f8"), self.members.astype("<i4"), self.segments.astype("<i8"), np.array([self.step, self.rounds], "<i8"))
        return [a.tobytes() for a in arrays]

    @classmethod
    def unpacked(cls, dims: int, ids: bytes, v: bytes, left: bytes, members: bytes, segments: bytes, sizes: bytes) -> Index:
        self = cls.__new__(cls)
        self.ids = np.frombuffer(ids, "<i8")
        n = len(self.ids)
        self.v = np.frombuffer(v, "<i4" if len(v) == 4 * n * dims else "<i8").reshape(n, dims)
        self.left, self.members = np.frombuffer(left, "<f8").reshape(-1, n), np.frombuffer(members, "<i4")
        self.segments = np.frombuffer(segments, "<i8").reshape(-1, 4)
        self.step, self.rounds = np.frombuffer(sizes, "<i8").tolist()
        return self

    def possible(self, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and queries (rows of q) of all vectors that can be, or tie with one, among the k best, given that scores below
        floor (one for each query) can't; and the number of postings processed."""
        n, dims = self.v.shape
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        columns = np.ascontiguousarray(q.T, np.float64)
        score = np.zeros((n, len(q)))
        stop = np.append(self.segments[1:, 3], len(self.members))
        by_round = np.searchsorted(self.segments[:, 0], np.arange(self.rounds + 1))
        done = 0
        for r in range(self.rounds + 1):
            reach = self.left[r][:, None] * length
            least = floor
            if n > k:
                least = np.maximum(floor, np.partition(score - reach, n - k, axis=0)[n - k]) if (floor == -np.inf).any() else floor
            maybe = score + reach >= least
            if r == self.rounds or RESCORE * maybe.sum() * dims <= (len(self.members) - done) * len(q):
                break
            for s in range(by_round[r], by_round[r + 1]):
                _, d, impact, a = self.segments[s].tolist()
                score[self.members[a : stop[s]]] += columns[d] * (impact * self.step)
                done = int(stop[s])
        rows, queries = np.nonzero(maybe)
        return rows, queries, done


class Best:
    """The k best so far of some queries: score, id, and whether it is the query's own row; ties to smaller ids, an own row
    before others of its id."""

    def __init__(self, n: int, k: int):
        self.k, self.query = k, np.zeros(0, np.int64)
        self.score, self.id, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray, same: np.ndarray) -> None:
        own = [np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, id), (self.same, same))]
        order = np.lexsort((~own[3], own[2], -own[1], own[0]))
        query, score, id, same = (x[order] for x in own)
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep, last = rank < self.k, rank == self.k - 1
        self.query, self.score, self.id, self.same = query[keep], score[keep], id[keep], same[keep]
        self.floor[query[last]] = score[last]


def quantised(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component."""
    return np.floor(scale * v).astype(np.int64)


def _valid(column: str):
    c = F.col(f"`{column}`")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _blocks(rows: DataFrame, size: int, names: list[str], make) -> DataFrame:
    """dims, what make(ids, vectors) gives of each up to `size` rows of one length, and the block's place and number."""
    def run(batches):
        held: dict[int, list] = {}

        def flush(dims):
            ids, vectors = zip(*held.pop(dims), strict=True)
            v = np.array(vectors, np.float64).reshape(len(ids), dims)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in make(np.array(ids, np.int64), v))], names=["dims", *names])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(len(x), [])
                own.append((i, x))
                if len(own) == size:
                    yield flush(len(x))
        for dims in list(held):
            yield flush(dims)

    made = rows.mapInArrow(run, "dims int, " + ", ".join(f"{x} binary" for x in names))
    return made.withColumns({"part": F.spark_partition_id(), "block": F.monotonically_increasing_id()})  # kept by being written


PARTS = ["ids", "v", "rest", "members", "segments", "sizes"]


def build(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = VECTOR_BLOCK) -> DataFrame:
    """The index of all vectors, written to the shared folder: dims, place, number and the packed parts of each block. Vectors that
    are null or hold a null or non-finite component, and rows without id, aren't in it."""
    prepare(df.sparkSession)
    rows = _rows(df, id, vector)
    n = rows.count()
    even = rows.repartition(max(1, -(-n // block)))  # round robin: equal blocks, however vectors or ids repeat
    return staged(_blocks(even, block, PARTS, lambda ids, v: Index(ids, quantised(v, scale)).packed()), "index")


def _rows(df: DataFrame, id: str, vector: str) -> DataFrame:
    return df.where(_valid(vector) & F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def search(df: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, index: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score: the k best other rows of every row for which is_query (of columns id and v) holds, ties to
    smaller ids.

    Vectors that are null or hold a null or non-finite component, and rows without id, take no part. Vectors of different
    lengths have no score. A repeated row is a candidate like any other; only the query's own row is left out, once. An
    empty table gives an empty result. index: that of build(), else it is made here. Only counts reach the driver."""
    prepare(df.sparkSession)
    index = build(df, id, vector, scale) if index is None else index
    queries = staged(_blocks(_rows(df, id, vector).where(is_query), QUERY_BLOCK, ["ids", "v"], lambda ids, v: [ids.astype("<i8").tobytes(), quantised(v, scale).astype("<i8").tobytes()]), "queries")
    n_index, n_queries = index.count(), queries.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-n_queries // CELL))
    down = max(1, -(-n_index // CELL), min(n_index, -(-2 * cores // across)))
    none = [F.lit(None).cast("binary").alias(x) for x in PARTS[2:]]
    where = lambda n: F.pmod(F.col("part"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dims", where(across).alias("a"), all_of(down).alias("d"), F.lit(0).alias("side"), "block", "ids", "v", *none)
    right = index.select("dims", all_of(across).alias("a"), where(down).alias("d"), F.lit(1).alias("side"), "block", *PARTS)
    cells = left.unionByName(right).repartition(across * down, "dims", "a", "d").sortWithinPartitions("dims", "a", "d", "side")

    def run(batches):
        now, blocks = None, []
        for b in batches:
            for r in b.to_pylist():
                cell = r["dims"], r["a"], r["d"]
                if cell != now:
                    yield from _answers(blocks)
                    now, blocks = cell, []
                if r["side"] == 0:
                    ids = np.frombuffer(r["ids"], "<i8")
                    blocks.append((r["block"], ids, np.frombuffer(r["v"], "<i8").reshape(len(ids), r["dims"]), Best(len(ids), k + 1)))
                elif blocks:
                    block = Index.unpacked(r["dims"], *(r[x] for x in PARTS))
                    for _, ids, q, best in blocks:
                        _search(block, ids, q, best)
        yield from _answers(blocks)

    found = cells.mapInArrow(run, "query_id long, b long, q long, id long, score long, same boolean")
    by_score = Window.partitionBy("b", "q").orderBy(F.col("score").desc(), "id", F.col("same").desc())
    # the own row is left out where it is among the k + 1 best; where it isn't, the last of these is
    best = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    before = F.min(F.when(F.col("same"), F.col("r"))).over(Window.partitionBy("b", "q"))
    best = best.withColumn("own", F.coalesce(before, F.lit(k + 1))).where(F.col("r") != F.col("own"))
    rank = F.when(F.col("r") > F.col("own"), F.col("r") - 1).otherwise(F.col("r"))
    return best.where(rank <= k).select("query_id", rank.cast("int").alias("rank"), F.col("id").alias(id), "score")


def _search(block: Index, ids: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Puts what a block holds among the best of some queries."""
    rows, queries, _ = block.possible(q, best.k, best.floor)
    score = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 1 << 16):
        i, j = rows[a : a + (1 << 16)], queries[a : a + (1 << 16)]
        score[a : a + (1 << 16)] = np.einsum("ij,ij->i", block.v[i].astype(np.int64), q[j])
    keep = score >= best.floor[queries]
    rows, queries, score = rows[keep], queries[keep], score[keep]
    same = block.ids[rows] == ids[queries]
    same[same] = (block.v[rows[same]] == q[queries[same]]).all(axis=1)
    best.add(queries, score, block.ids[rows], same)


def _answers(blocks: list) -> Iterator[pa.RecordBatch]:
    """The best of each query; block and place tell repeated queries apart."""
    for block, ids, _, best in blocks:
        if len(best.query):
            arrays = (ids[best.query], np.full(len(best.query), block), best.query, best.id, best.score, best.same)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["query_id", "b", "q", "id", "score", "same"])
