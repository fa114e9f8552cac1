"""Masked pseudo-likelihood: every token predicted from two tokens on either side.

A window network (position-wise embeddings of the four neighbours, a tanh layer, a softmax) is trained in numpy. Its softmax
over the vocabulary has two exact levels: over classes of words that stand in like contexts, and over the words of the class.
The vocabulary is the most frequent words, and buckets by the end of the word for all others; which word of a bucket it is
comes from counts over all whole texts. The network is fitted to every window of every text: begun in one task, then carried on
where the texts lie, each task by itself, and averaged. Texts are told into words once and staged as numbers, which all passes
read. A document is scored under the rest of the corpus: its own words are taken out of
those counts, so a document is expected where its rare words occur elsewhere. The counts of the most frequent words go with
the network; those of all others stay in a table that is joined, however many there are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import arrow_map, drop_staged, free, prepare, staged, texts

#: Classes of as many outputs each; buckets among the outputs; words whose counts go with the network (the others are joined).
CLASSES, SIZE, BUCKETS, SHARED = 64, 64, 64, 100_000
OUTPUTS = CLASSES * SIZE
WORDS = OUTPUTS - BUCKETS
HIDDEN, EPOCHS, RATE, BATCH = 32, 3, 0.15, 512
#: The fit begins with about so many windows, drawn over all texts by the hash of the text and the place (a corpus of no more
#: is fitted there); then all windows follow, so many a step.
WINDOWS, FULL_BATCH = 200_000, 16384
#: Neighbours that classes are told by, and groups that counts and networks of tasks are added up in.
NEAR, GROUPS = 512, 16
#: What a word that occurs nowhere else counts, and words counted in a worker before their counts are handed on.
SMOOTH, _HELD = 0.5, 200_000
#: Windows scored at once; rows of an input that are added up one by one (those of more frequent ones in one go).
_CHUNK, _FEW = 1 << 15, 16
#: Parquet looks at sizes after each row, not after a hundred, where a row is a batch of texts: a writer holds 64 MB at most.
_FEW_LARGE_ROWS = {"parquet.block.size": str(64 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: A window of the first ones: keys and buckets of its words, _EDGE behind an end.
_WINDOW, _EDGE = np.dtype([("key", np.int64, 5), ("bucket", np.uint8, 5)]), 255
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff']+|[^\sa-z0-9\x80-\xff']")


def tokens(text: bytes) -> list[bytes]:
    """Words (ASCII letters lower-cased, digits, apostrophes, anything past 7F) and single marks."""
    return _TOKEN.findall(text.lower())


def word_key(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63)


def bucket_of(w: bytes) -> int:
    """By the last two bytes: words of one ending share a bucket."""
    return zlib.crc32(w[-2:]) % BUCKETS


def buckets_of(words: Iterable[bytes]) -> np.ndarray:
    """bucket_of() each."""
    return (np.array([zlib.crc32(w[-2:]) for w in words], np.uint32) % BUCKETS).astype(np.uint8)


# --- the network ------------------------------------------------------------------------------------------------------


@dataclass
class Network:
    """Outputs 0 .. WORDS - 1 are words, the rest buckets; OUTPUTS is the edge of a text (an input alone)."""

    embed: np.ndarray  # 4 x (OUTPUTS + 1) x HIDDEN
    bias: np.ndarray  # HIDDEN
    to_class: np.ndarray  # (HIDDEN + 1) x CLASSES
    to_word: np.ndarray  # CLASSES x (HIDDEN + 1) x SIZE
    class_of: np.ndarray  # class of each output
    place: np.ndarray  # its place in the class

    def __post_init__(self):
        # no entry of the tanh layer exceeds 1: where the weights are small no logit can overflow
        self.small = max(float(np.abs(self.to_class).sum(axis=0).max()), float(np.abs(self.to_word).sum(axis=1).max())) < 80

    def log_prob(self, padded: np.ndarray) -> np.ndarray:
        """Log-probability of each output from its four neighbours. padded: outputs with two edges before, between and after
        texts; the result has an entry for each of padded[2:-2], 0 for edges."""
        out = np.zeros(max(0, len(padded) - 4))
        real = np.flatnonzero(padded[2:-2] != OUTPUTS)
        for a in range(0, len(real), _CHUNK):
            at = real[a : a + _CHUNK]
            out[at] = self._chunk([padded[at + k] for k in (0, 1, 3, 4)], padded[at + 2])
        return out

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        """tanh layer, and a last column of ones."""
        h = np.ones((len(around[0]), HIDDEN + 1), np.float32)
        s = np.take(self.embed[0], around[0], axis=0)
        for e, x in zip(self.embed[1:], around[1:], strict=True):
            s += np.take(e, x, axis=0)
        s += self.bias
        np.tanh(s, out=h[:, :HIDDEN])
        return h

    def _chunk(self, around: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        order, cut = self.by_class(target)
        around, place = [x[order] for x in around], self.place[target[order]]
        h, found = self.hidden(around), np.empty(len(target))
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                own = h[a:b]
                found[a:b] = _log_share(own @ self.to_class, c, self.small)
                found[a:b] += _log_share(own @ self.to_word[c], place[a:b], self.small)
        out = np.empty_like(found)
        out[order] = found
        return out

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """An order in which the outputs of a class lie together, and where each class begins (and the last ends)."""
        cls = self.class_of[target].astype(np.uint16)
        return np.argsort(cls, kind="stable"), [0, *np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()]


def _log_share(z: np.ndarray, at: np.ndarray | int, small: bool) -> np.ndarray:
    """Log-softmax of each row at one place. small: no entry can overflow."""
    if not small:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), at]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def neighbours(windows: np.ndarray) -> np.ndarray:
    """How often each of the most frequent outputs stands before and behind each output in windows."""
    seen = np.zeros((OUTPUTS, 2 * NEAR), np.float32)
    for k, side in ((1, 0), (3, NEAR)):
        some = windows[:, k] < NEAR  # the most frequent ones come first
        np.add.at(seen, (windows[some, 2], side + windows[some, k]), 1)
    return seen


def classes(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place of each output: outputs in the order of the first principal component of their neighbours, cut into
    classes of equal size."""
    seen = np.log1p(seen)
    seen /= np.sqrt((seen**2).sum(axis=1, keepdims=True)) + 1e-6
    seen -= seen.mean(axis=0)
    axis = np.ones(seen.shape[1], np.float32) + 0.01 * np.arange(seen.shape[1], dtype=np.float32)
    for _ in range(20):  # power iteration
        axis = seen.T @ (seen @ axis)
        axis /= np.sqrt((axis**2).sum()) + 1e-12
    order = np.argsort(seen @ axis, kind="stable")
    rank = np.empty(OUTPUTS, np.int64)
    rank[order] = np.arange(OUTPUTS)
    return rank // SIZE, rank % SIZE


class Fit:
    """A network, moved by AdaGrad."""

    def __init__(self, network: Network, sums: list[np.ndarray] | None = None, rate: float = RATE):
        self.network, self.rate = network, rate
        self.sums = sums or [np.full(x.shape, 0.01, np.float32) for x in self.weights()]

    def weights(self) -> list[np.ndarray]:
        return [self.network.embed, self.network.bias, self.network.to_class, self.network.to_word]

    def step(self, around: list[np.ndarray], target: np.ndarray):
        """One step by the mean gradient of windows."""
        net, n, rate = self.network, len(target), self.rate

        def move(x, s, g):
            s += g * g
            x -= rate * g / np.sqrt(s)

        net.__post_init__()
        order, cut = net.by_class(target)  # all that follows is in this order
        around, target = [x[order] for x in around], target[order]
        h, place = net.hidden(around), net.place[target]
        ds, to_class, to_word = np.empty((n, HIDDEN), np.float32), np.zeros_like(net.to_class), np.zeros_like(net.to_word)
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                own, w = h[a:b], net.to_word[c]
                dz, dy = _softmax(own @ net.to_class, net.small), _softmax(own @ w, net.small)
                dz[:, c] -= 1
                dy[np.arange(b - a), place[a:b]] -= 1
                np.matmul(dz, net.to_class[:HIDDEN].T, out=ds[a:b])
                ds[a:b] += dy @ w[:HIDDEN].T
                to_class += own.T @ dz
                np.matmul(own.T, dy, out=to_word[c])
        move(net.to_class, self.sums[2], to_class / n)
        move(net.to_word, self.sums[3], to_word / n)
        slope = h[:, :HIDDEN] ** 2
        ds *= np.subtract(1, slope, out=slope)
        move(net.bias, self.sums[1], np.ones(n, np.float32) @ ds / n)
        for e, sums, x in zip(net.embed, self.sums[0], around, strict=True):
            rows, grad = _added(x.astype(np.uint16), ds)
            grad /= n
            s = np.take(sums, rows, axis=0)
            s += grad * grad
            sums[rows] = s
            grad /= np.sqrt(s, out=s)
            grad *= rate
            e[rows] -= grad


def _added(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x, and the sum of each one's rows."""
    order = np.argsort(x, kind="stable")
    own = x[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    size = np.diff(first, append=len(x))
    lie = np.take(rows, order, axis=0)
    total = np.take(lie, first, axis=0)
    for k in np.flatnonzero(size > _FEW).tolist():
        np.add.reduce(lie[first[k] : first[k] + size[k]], axis=0, out=total[k])
    few = np.flatnonzero((size > 1) & (size <= _FEW))
    few = few[np.argsort(-size[few], kind="stable")]
    begun, left = first[few], np.cumsum(np.bincount(size[few], minlength=_FEW + 1)[::-1])[::-1]  # of that size or more
    some = np.take(total, few, axis=0)
    for k in range(1, _FEW):
        m = int(left[k + 1])
        some[:m] += np.take(lie, begun[:m] + k, axis=0)
    total[few] = some
    return own[first].astype(np.int64), total


def begin(windows: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11, of: tuple[np.ndarray, np.ndarray] | None = None) -> Fit:
    """A network fitted to windows (n x 5 outputs, edges OUTPUTS). counts: of each output over all texts; they set the biases
    that the fit begins with. of: class and place of each output (else by the neighbours in windows). The same input gives the same network."""
    rng = np.random.default_rng(seed)
    class_of, place = classes(neighbours(windows)) if of is None else of
    mass = counts.astype(np.float64) + 1
    by_class = np.bincount(class_of, mass, minlength=CLASSES)
    embed = (rng.standard_normal((4, OUTPUTS + 1, HIDDEN)) * 0.1).astype(np.float32)
    bias = np.zeros(HIDDEN, np.float32)
    to_class = np.zeros((HIDDEN + 1, CLASSES), np.float32)
    to_word = np.zeros((CLASSES, HIDDEN + 1, SIZE), np.float32)
    to_class[:HIDDEN] = rng.standard_normal((HIDDEN, CLASSES)) * 0.1
    to_word[:, :HIDDEN] = rng.standard_normal((CLASSES, HIDDEN, SIZE)) * 0.1
    to_class[HIDDEN] = np.log(by_class / mass.sum())
    to_word[class_of, HIDDEN, place] = np.log(mass / by_class[class_of])
    made = Fit(Network(embed, bias, to_class, to_word, class_of, place), rate=rate)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            w = windows[order[a : a + BATCH]]
            made.step([w[:, k] for k in (0, 1, 3, 4)], w[:, 2])
    made.network.__post_init__()
    return made


def fit(windows: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Network:
    """The network of begin()."""
    return begin(windows, counts, epochs, rate, seed).network


def _softmax(z: np.ndarray, small: bool) -> np.ndarray:
    """small: no entry can overflow."""
    if not small:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


# --- words of the corpus ----------------------------------------------------------------------------------------------


class Vocabulary:
    """Outputs of words, counts of the most frequent ones, and what a bucket holds."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, mass: np.ndarray, types: np.ndarray):
        """keys and counts: the most frequent words, most frequent first; mass and types: tokens and words of each bucket
        that are no output of their own."""
        self.__setstate__((keys, counts, mass, types))

    def __getstate__(self):
        return self.state

    def __setstate__(self, state):
        self.state = state
        keys, counts, mass, types = state
        self.output = {k: i for i, k in enumerate(keys[:WORDS].tolist())}
        self.total = mass + SMOOTH * (types + 1)
        self.tables = []
        for k, x in ((keys[:WORDS], np.arange(min(WORDS, len(keys)))), (keys[WORDS:], counts[WORDS:])):
            order = np.argsort(k)
            self.tables.append((k[order], x[order]))

    def look(self, w: bytes) -> tuple[int, int]:
        """Output and key of a word."""
        key = word_key(w)
        return self.output.get(key, WORDS + bucket_of(w)), key

    def outputs(self, keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Outputs of words."""
        found = _found(*self.tables[0], keys)
        return np.where(found < 0, WORDS + buckets.astype(np.int64), found)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words that are no outputs of their own; -1 of those that the joined table has."""
        return _found(*self.tables[1], keys)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted among the sorted keys; -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


class Model:
    """words: counts of all words by key (a staged table); numbers: the corpus as numbered() has it, if train() kept it."""

    def __init__(self, network: Network, vocabulary: Vocabulary, words: DataFrame | None, numbers: DataFrame | None = None):
        self.network, self.vocabulary, self.words, self.numbers = network, vocabulary, words, numbers


@dataclass
class Numbers:
    """Texts told into words: sizes (words of each text), ids (each word's place among the different ones), and keys and
    buckets of these."""

    sizes: np.ndarray
    ids: np.ndarray
    keys: np.ndarray
    buckets: np.ndarray

    @classmethod
    def of(cls, xs: list[bytes]) -> Numbers:
        place: defaultdict = defaultdict()
        place.default_factory = place.__len__
        own = [np.fromiter(map(place.__getitem__, words), np.uint32, len(words)) for words in map(tokens, xs)]
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place)) ^ np.uint64(1 << 63)
        return cls(np.array([len(x) for x in own], np.int32), np.concatenate([*own, np.zeros(0, np.uint32)]), keys.view(np.int64), buckets_of(place))

    def packed(self) -> list[bytes]:
        ids = self.ids if len(self.keys) > 1 << 16 else self.ids.astype(np.uint16)
        return [x.tobytes() for x in (self.sizes, ids, self.keys, self.buckets)]

    @classmethod
    def unpacked(cls, sizes: bytes, ids: bytes, keys: bytes, buckets: bytes) -> Numbers:
        return cls(np.frombuffer(sizes, np.int32), np.frombuffer(ids, np.uint32 if len(buckets) > 1 << 16 else np.uint16), np.frombuffer(keys, np.int64), np.frombuffer(buckets, np.uint8))

    def places(self) -> np.ndarray:
        """Where the words stand if two edges stand before, between and after the texts."""
        return np.arange(2, len(self.ids) + 2) + 2 * np.repeat(np.arange(len(self.sizes)), self.sizes)

    def padded(self, values: np.ndarray, edge: int, at: np.ndarray) -> np.ndarray:
        """The words' values, and edge at the edges; at: places()."""
        out = np.full(len(self.ids) + 2 * len(self.sizes) + 2, edge, values.dtype)
        out[at] = values[self.ids]
        return out


_PACKED = ["sizes", "ids", "keys", "buckets"]


def numbered(docs: DataFrame, text: str, share: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Texts as Numbers, a row for each batch of them: sizes, ids, keys, buckets; drawn (places in the batch of that share
    of all words); with keep rows, an array of those columns of docs."""
    limit, keep = int(share * (1 << 32)), keep or []
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free("text_", {c.lower() for c in keep})))
    kept = StructType(given.schema.fields[: len(keep)])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            xs = texts(b.column(len(keep)))
            told = Numbers.of(xs)
            begun = np.cumsum(told.sizes) - told.sizes
            drawn = [a + np.flatnonzero(_draws(x, n) < limit) for x, a, n in zip(xs, begun.tolist(), told.sizes.tolist(), strict=True) if n] if limit else []
            drawn = np.concatenate([*drawn, np.zeros(0, np.int64)]).astype(np.int32)
            columns = [pa.array([x], pa.binary()) for x in [*told.packed(), drawn.tobytes()]]
            if keep:
                whole = pa.StructArray.from_arrays(b.columns[: len(keep)], names=keep)
                columns.append(pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), whole))
            yield pa.RecordBatch.from_arrays(columns, names=[*_PACKED, "drawn", "rows"][: len(columns)])

    schema = StructType.fromDDL(", ".join(f"{c} binary" for c in [*_PACKED, "drawn"]))
    return given.mapInArrow(run, StructType([*schema.fields, StructField("rows", ArrayType(kept))]) if keep else schema)


def _unpacked(batches):
    """Numbers, and what follows them, of each row."""
    for b in batches:
        for x in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield Numbers.unpacked(*x[: len(_PACKED)]), *x[len(_PACKED) :]


def corpus_rows(numbers: DataFrame) -> DataFrame:
    """key, bucket, n of all words, and as rows of their own (with window) the windows around the words drawn."""

    def run(batches):
        def rows(keys, buckets, n, windows):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(buckets, pa.int32()), pa.array(n, pa.int64()), pa.array(windows, pa.binary())], names=["key", "bucket", "n", "window"])

        def counted():
            keys, buckets, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], buckets[order[first]], np.add.reduceat(n[order], first)

        held, size = [], 0
        for told, drawn in _unpacked(batches):
            if not len(told.ids):
                continue
            held.append((told.keys, told.buckets, np.bincount(told.ids, minlength=len(told.keys))))
            size += len(told.keys)
            if size > 2 * _HELD:
                held = [counted()]
                size = len(held[0][0])
                if size > _HELD:
                    yield rows(*held[0], [None] * size)
                    held, size = [], 0
            at = told.places()
            around = at[np.frombuffer(drawn, np.int32)][:, None] + np.arange(-2, 3)
            if len(around):
                found = np.empty(len(around), _WINDOW)
                for name, values, edge in (("key", told.keys, 0), ("bucket", told.buckets, _EDGE)):
                    found[name] = told.padded(values, edge, at)[around]
                yield rows([None] * len(found), [None] * len(found), [1] * len(found), [x.tobytes() for x in found])
        if held:
            keys, buckets, n = counted()
            yield rows(keys, buckets, n, [None] * len(keys))

    made = numbers.select(*_PACKED, "drawn").mapInArrow(run, "key long, bucket int, n long, window binary")
    return made.groupBy("key", "bucket", "window").agg(F.sum("n").alias("n"))


def _draws(text: bytes, n: int) -> np.ndarray:
    """A number below 2 ** 32 for each place of a text, by its content alone."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh3_64_intdigest(text))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) >> np.uint64(32)


def most_frequent(words: DataFrame, most: int) -> pd.DataFrame:
    """The words of greatest n, ties by key, at most `most` of them (but for words that occur thousands of times, those of
    about the same n count as ties). Nothing but a histogram of n and the words themselves is collected."""
    n = F.col("n")
    step = F.when(n < 4096, n).otherwise(4096 + F.floor(64 * (F.log2(n) - 12))).cast("int")
    sizes = sorted(((r.s, r.k) for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    room, last, tied = most, 0, None
    for s, k in sizes:
        if k > room:
            tied = s
            break
        room, last = room - k, s
    some = words.where(step >= last) if room < most else words.limit(0)
    if tied is not None and room:
        head = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 52)  # in the order of the signed keys
        own = words.where(step == tied)
        cut = 0
        for r in own.groupBy(head.alias("h")).agg(F.count("*").alias("k")).orderBy("h").collect():  # at most 4096
            if r.k > room:
                break
            room, cut = room - r.k, r.h + 1
        some = some.unionByName(own.where(head < cut))
    return some.toPandas().sort_values(["n", "key"], ascending=[False, True], kind="stable")


def coded(docs: DataFrame, text: str | None, vocabulary: Vocabulary) -> DataFrame:
    """What a task has counted of neighbours in the texts' outputs: group, cells and their counts. docs: numbered(), where text is None."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by OUTPUTS and SHARED

    def run(batches):
        v, seen = held.value, np.zeros(OUTPUTS * 2 * NEAR, np.int32)
        for (told,) in _unpacked(batches):
            p = told.padded(v.outputs(told.keys, told.buckets).astype(np.int32), OUTPUTS, told.places())
            for target, near, side in ((p[1:], p[:-1], 0), (p[:-1], p[1:], NEAR)):
                some = np.flatnonzero((near < NEAR) & (target < OUTPUTS))
                cells, n = np.unique(target[some] * (2 * NEAR) + (side + near[some]), return_counts=True)
                seen[cells] += n.astype(np.int32)
        size = len(seen) // GROUPS
        for g in range(GROUPS):
            own = seen[g * size : (g + 1) * size]
            if len(at := np.flatnonzero(own)):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([(at + g * size).astype(np.int32).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], names=["group", "cells", "n"])

    given = docs if text is None else numbered(docs, text)
    return given.select(*_PACKED).mapInArrow(run, "group int, cells binary, n binary")


def added_neighbours(rows: DataFrame) -> DataFrame:
    """neighbours() of all texts, added up by group where the rows lie: group and its counts (32-bit floats)."""

    def run(batches):
        of: dict[int, np.ndarray] = {}
        size = OUTPUTS * 2 * NEAR // GROUPS
        for b in batches:
            for g, cells, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                total = of.setdefault(g, np.zeros(size, np.int64))
                total[np.frombuffer(cells, np.int32) - g * size] += np.frombuffer(n, np.int32)
        for g, total in of.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["group", "n"])

    return rows.repartition(GROUPS, "group").mapInArrow(run, "group int, n binary")


def all_neighbours(rows: DataFrame) -> np.ndarray:
    """neighbours() of all texts."""
    return _whole((r.group, r.n) for r in added_neighbours(rows).toLocalIterator())


def _whole(groups) -> np.ndarray:
    seen = np.zeros((GROUPS, OUTPUTS * 2 * NEAR // GROUPS), np.float32)
    for g, n in groups:
        seen[g] = np.frombuffer(n, np.float32)
    return seen.reshape(OUTPUTS, 2 * NEAR)


def all_classes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """classes() by the neighbours in all texts, told in one task from GROUPS rows; only the classes come to the driver."""

    def run(batches):
        of = classes(_whole((g, n) for b in batches for g, n in zip(*[c.to_pylist() for c in b.columns], strict=True)))
        yield _row(0, np.concatenate(of))

    found = added_neighbours(rows).repartition(1).mapInArrow(run, "id int, total binary").collect()
    if not found:
        return classes(_whole([]))
    class_of, place = np.split(np.frombuffer(found[0].total, np.int64), 2)
    return class_of, place


def begin_there(windows: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, of: tuple[np.ndarray, np.ndarray] | None) -> Fit:
    """begin() on windows (window: of _WINDOW; n), in one task: the driver gets the network and its sums alone."""
    held = windows.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by OUTPUTS and SHARED

    def run(batches):
        first = sorted((w, n) for b in batches for w, n in zip(*[c.to_pylist() for c in b.columns], strict=True))
        words = np.frombuffer(b"".join(w for w, _ in first), _WINDOW)
        some = held.value.outputs(words["key"].ravel(), words["bucket"].ravel()).reshape(-1, 5)
        some[words["bucket"] == _EDGE] = OUTPUTS
        made = begin(np.repeat(some, [n for _, n in first], axis=0), counts, of=of)
        weights = np.concatenate([x.ravel() for x in [*made.weights(), *made.sums]])
        yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in (weights, made.network.class_of, made.network.place)]], names=["weights", "class_of", "place"])

    found = windows.select("window", "n").repartition(1).mapInArrow(run, "weights binary, class_of binary, place binary").collect()
    made = begin(np.zeros((0, 5), np.int64), counts, of=of)
    if not found:
        return made
    shapes = [x.shape for x in [*made.weights(), *made.sums]]
    cut = np.cumsum([math.prod(x) for x in shapes])[:-1]
    own = [x.reshape(s).copy() for x, s in zip(np.split(np.frombuffer(found[0].weights, np.float32), cut), shapes, strict=True)]
    return Fit(Network(*own[:4], *[np.frombuffer(x, np.int64) for x in (found[0].class_of, found[0].place)]), own[4:], made.rate)


def carry_on(made: Fit, numbers: DataFrame, vocabulary: Vocabulary) -> Network:
    """The network fitted on to all windows of numbered texts, each once. Every task moves a copy; what the copies have moved is
    averaged, each input's row and each class by how many windows of a task had it. The same tasks give the same network."""
    context = numbers.sparkSession.sparkContext
    held, known = context.broadcast((made.network, made.sums, made.rate)), context.broadcast(vocabulary)

    def run(batches):
        (network, sums, rate), v = held.value, known.value
        copy = lambda x: x.copy()
        own = Fit(Network(copy(network.embed), copy(network.bias), copy(network.to_class), copy(network.to_word), network.class_of, network.place), [x.copy() for x in sums], rate)
        inputs, outputs = np.zeros((4, OUTPUTS + 1)), np.zeros(CLASSES)
        for (told,) in _unpacked(batches):
            real = told.places()
            p = told.padded(v.outputs(told.keys, told.buckets), OUTPUTS, real)
            for a in range(0, len(real), FULL_BATCH):
                at = real[a : a + FULL_BATCH]
                own.step([p[at + k] for k in (-2, -1, 1, 2)], p[at])
            for k, d in enumerate((-2, -1, 1, 2)):
                inputs[k] += np.bincount(p[real + d], minlength=OUTPUTS + 1)
            outputs += np.bincount(network.class_of[p[real]], minlength=CLASSES)
        if outputs.any():
            new, old = own.weights(), [network.embed, network.bias, network.to_class, network.to_word]
            moved = [(x.astype(np.float64) - y) * w for x, y, w in zip(new, old, (inputs[:, :, None], outputs.sum(), outputs.sum(), outputs[:, None, None]), strict=True)]
            yield _row(int(TaskContext.get().partitionId()), np.concatenate([*[m.ravel() for m in moved], inputs.ravel(), outputs]))

    def add(batches):
        found = sorted(((i, x) for b in batches for i, x in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=lambda r: r[0])
        if found:
            total = np.frombuffer(found[0][1]).copy()
            for _, x in found[1:]:
                total += np.frombuffer(x)
            yield _row(found[0][0], total)

    def finish(batches):
        total = next(iter(add(batches)), None)
        if total is None:
            return
        total, old = np.frombuffer(total.column(1)[0].as_py()), Fit(*held.value).weights()
        *moved, inputs, outputs = np.split(total, np.cumsum([*[x.size for x in old], 4 * (OUTPUTS + 1)]))
        inputs = inputs.reshape(4, OUTPUTS + 1)
        counts = (np.maximum(1, inputs)[:, :, None], outputs.sum(), outputs.sum(), np.maximum(1, outputs)[:, None, None])
        new = [(x + m.reshape(x.shape) / w).astype(np.float32) for x, m, w in zip(old, moved, counts, strict=True)]
        yield _row(0, np.concatenate([x.ravel() for x in new]))

    tasks = staged(numbers.select(*_PACKED).mapInArrow(run, "id int, total binary"), "networks")
    added = staged(tasks.repartition(GROUPS, "id").mapInArrow(add, "id int, total binary"), "added-networks")
    found = added.repartition(1).mapInArrow(finish, "id int, total binary").collect()  # of at most GROUPS rows one
    drop_staged(tasks, added)
    if not found:
        return made.network
    old = made.weights()
    cut = np.cumsum([x.size for x in old])[:-1]
    new = [x.reshape(y.shape).copy() for x, y in zip(np.split(np.frombuffer(found[0].total, np.float32), cut), old, strict=True)]
    return Network(*new, made.network.class_of, made.network.place)


def _row(i: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["id", "total"])


def train(docs: DataFrame, text: str = "text", windows: int = WINDOWS, keep: list[str] | None = None) -> Model:
    """keep: the model has the corpus as numbers, with these columns of docs, for score(); drop_staged() drops them. Counts of words, neighbours and the network's fit are over all documents. To the driver come the SHARED most frequent
    words, totals by bucket, classes and two networks; about `windows` windows meet in one task. A corpus without words gives a model that knows none."""
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    numbers = staged(numbered(docs, text, min(1.0, 6 * windows / max(1, size)), keep), "numbers", **_FEW_LARGE_ROWS)
    rows = staged(corpus_rows(numbers), "corpus")
    whole = size <= 6 * windows  # all windows are among the rows
    words = rows.where("window is null").select("key", "bucket", "n")
    top = most_frequent(words, SHARED)
    keys, counts = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    mass, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in words.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        mass[r.bucket], types[r.bucket] = r.n, r.k
    own = top["bucket"].to_numpy(np.int64)[:WORDS]
    mass -= np.bincount(own, counts[:WORDS], minlength=BUCKETS)
    types -= np.bincount(own, minlength=BUCKETS)
    vocabulary = Vocabulary(keys, counts, mass, types)
    of_outputs = np.concatenate([counts[:WORDS], np.zeros(WORDS - len(own), np.int64), mass])
    some = rows.where("window is not null").select("window", "n")
    if whole:
        network = begin_there(some, vocabulary, of_outputs, None).network
    else:
        network = carry_on(begin_there(some, vocabulary, of_outputs, all_classes(coded(numbers, None, vocabulary))), numbers, vocabulary)
    if not keep:
        drop_staged(numbers)
    return Model(network, vocabulary, words, numbers if keep else None)


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, inside: bool = True) -> DataFrame:
    """docs (or its columns) with n_tokens, n_unseen (tokens whose word occurs in no other document's count), log_likelihood
    (sum over tokens) and perplexity.

    docs may be the model's numbers: the texts of its corpus aren't told into words again, and the columns are those kept.
    inside: docs are part of the corpus of the model, so each text's own words are taken out of the counts (a text that
    occurs twice is still known from its copy). Null, empty and blank texts have no tokens, log-likelihood 0 and a null
    perplexity. Repeated rows stay, each scored by itself; other columns pass as they are."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.network, model.vocabulary))  # bounded by OUTPUTS and SHARED
    told = docs is model.numbers
    of_docs = docs.schema["rows"].dataType.elementType.names if told else docs.columns
    wanted = of_docs if columns is None else columns
    taken = {c.lower() for c in wanted}
    n_tokens, n_unseen, likely, ppl, far, row = (free(x, taken) for x in ("n_tokens", "n_unseen", "log_likelihood", "perplexity", "_far", "_row"))

    def found(x: Numbers) -> list[pa.Array]:
        network, v = held.value
        k, at, text_of = len(x.sizes), x.places(), np.repeat(np.arange(len(x.sizes)), x.sizes)
        out = v.outputs(x.keys, x.buckets)
        sums = np.bincount(text_of, network.log_prob(x.padded(out, OUTPUTS, at))[at - 2], minlength=k)
        some = np.flatnonzero((out >= WORDS)[x.ids])
        pairs, n = np.unique(text_of[some] * len(x.keys) + x.ids[some], return_counts=True)  # a text and a word of it
        t, w = np.divmod(pairs, max(1, len(x.keys)))
        c = v.counts(x.keys)[w]
        near = c >= 0
        c = np.maximum(0, c - n) if inside else c
        a, b = near.nonzero()[0], (~near).nonzero()[0]
        sums += np.bincount(t[a], n[a] * np.log((c[a] + SMOOTH) / v.total[x.buckets[w[a]]]), minlength=k)
        unseen = np.bincount(t[a], n[a] * (c[a] == 0), minlength=k).astype(np.int64)
        others = pa.StructArray.from_arrays([pa.array(x.keys[w[b]], pa.int64()), pa.array(n[b], pa.int32()), pa.array(x.buckets[w[b]], pa.int32())], names=["key", "n", "bucket"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(t[b], minlength=k))))
        return [pa.array(x.sizes, pa.int64()), pa.array(unseen, pa.int64()), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)]

    extra = f"`{n_tokens}` long, `{n_unseen}` long, `{likely}` double, `{far}` array<struct<key: long, n: int, bucket: int>>"
    if told:
        fields = [docs.schema["rows"].dataType.elementType[c] for c in wanted]

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    rows = b.column(len(_PACKED)).slice(i, 1).flatten()
                    x = Numbers.unpacked(*[b.column(j)[i].as_py() for j in range(len(_PACKED))])
                    yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in range(len(wanted))], *found(x)], names=[*wanted, n_tokens, n_unseen, likely, far])

        rows = F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in wanted])).alias("rows") if list(wanted) != of_docs else F.col("rows")
        made = docs.select(*_PACKED, rows).mapInArrow(run, StructType([*fields, *StructType.fromDDL(extra).fields]))
    else:
        made = arrow_map(docs, wanted, extra, lambda b: found(Numbers.of(texts(b.column(b.schema.names.index(text))))), (text,))
    # the row's number is written with it, so it stays the same however often a task runs again
    first = staged(made.withColumn(row, F.monotonically_increasing_id()), "scored")
    totals = F.get(F.array(*[F.lit(float(x)) for x in model.vocabulary.total]), F.col("w.bucket"))
    rare = first.select(F.col(row).alias("r"), F.explode(far).alias("w"))
    if model.words is not None:
        counted = model.words.select(F.col("key").alias("k"), F.col("n").alias("c"))
        rare = rare.join(counted, F.col("w.key") == F.col("k"), "left")
    else:
        rare = rare.withColumn("c", F.lit(0))
    c = F.greatest(F.lit(0), F.coalesce("c", F.lit(0)) - (F.col("w.n") if inside else F.lit(0)))
    parts = rare.groupBy("r").agg(F.sum(F.col("w.n") * F.log((c + SMOOTH) / totals)).alias("more"), F.sum(F.when(c == 0, F.col("w.n")).otherwise(0)).alias("none"))
    whole = first.join(parts.withColumnRenamed("r", row), row, "left")
    sum_ = F.col(f"`{likely}`") + F.coalesce("more", F.lit(0.0))
    size = F.col(f"`{n_tokens}`")
    return whole.select(
        *[F.col(f"`{x}`") for x in wanted], size.alias(n_tokens), (F.col(f"`{n_unseen}`") + F.coalesce("none", F.lit(0))).alias(n_unseen), sum_.alias(likely),
        F.when(size > 0, F.exp(F.least(F.lit(700.0), -sum_ / size))).alias(ppl),
    )
