"""Benchmark decontamination: windows of benchmark words looked up in every document.

Windows of the benchmark are kept as a sorted set of 64-bit hashes with the places they come from, in blocks of bounded
size that are broadcast. A document's words and windows are hashed with prefix sums over its bytes, a bitmap passes few of
them on, and each of those is compared with the benchmark's words before it counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, prepare, spans_of, texts

WINDOW = 13
#: Words, and so windows, in one broadcast block (about 24 bytes each, and their texts); a larger benchmark is broadcast in
#: several, and a longer item is cut.
BLOCK_WINDOWS = 1_000_000
#: A document is contaminated if at least one in this many of its words is hit.
SHARE = 20
_CHUNK = 1 << 20
#: Hit windows whose items a worker keeps at hand.
_KEPT = 100_000
_ITEM_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_CODE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)


def _powers(base: int, n: int, known={}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** n modulo 2 ** 64."""
    if len(known.get(base, ())) <= n:
        a = np.full(max(n + 1, 1 << 16), base, np.uint64)
        a[0] = 1
        known[base] = np.multiply.accumulate(a)
    return known[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: where they lie in the lower-cased bytes, whose they are, and their hashes."""

    def __init__(self, raw: list[bytes]):
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        self.low = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        word = _WORD[self.low]
        first = np.zeros(len(word) + 1, bool)  # where a text begins
        first[end - size] = True
        start = np.flatnonzero(word & (first[:-1] | np.concatenate(([True], ~word[:-1])))) if len(word) else np.zeros(0, np.int64)
        stop = np.flatnonzero(word & (first[1:] | np.concatenate((~word[1:], [True])))) + 1 if len(word) else start
        self.start, self.stop = start, stop
        self.text = np.searchsorted(end, start, side="right")
        self.count = np.bincount(self.text, minlength=len(raw))
        self.base = end - size
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        inverse = pow(_P, -1, 1 << 64)
        a = 0
        while a < len(self.start):  # words that begin in one chunk of bytes: sums stay small however long a text is
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + _CHUNK)))
            lo, hi = int(self.start[a]), int(self.stop[b - 1])
            power = _powers(_P, hi - lo + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[self.low[lo:hi]] * power[: hi - lo])))
            s, e = self.start[a:b] - lo, self.stop[a:b] - lo
            out[a:b] = (total[e] - total[s]) * _powers(inverse, hi - lo + 1)[s]
            a = b
        return _mixed(out)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of n words within one text, and their hashes."""
        many = len(self.start) - n + 1
        if many <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.text[:many] == self.text[n - 1 :])
        h = np.zeros(many, np.uint64)
        for k in range(n):
            h = h * np.uint64(_Q) + self.hash[k : k + many]
        return first, _mixed(h)[first]

    def joined(self, i: int, n: int) -> bytes:
        return b" ".join([self.low[a:b].tobytes() for a, b in zip(self.start[i : i + n].tolist(), self.stop[i : i + n].tolist(), strict=True)])


class Block:
    """Windows of some benchmark items, by window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        words = Words([t for _, t in items])
        self.words = words
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(words.count[words.count > 0], window)).tolist():
            first, h = words.windows(n)
            own = words.count[words.text[first]]
            first, h = (x[(own >= window) if n == window else (own == n)] for x in (first, h))
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(h >> np.uint64(44)).astype(np.int64)] = True
            self.sets[n] = h[order], first[order], bitmap
        self.hot: dict[tuple[int, int], dict[bytes, set[int]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"hot": {}}

    def items_of(self, n: int, a: int, b: int) -> dict[bytes, set[int]]:
        """Items by the words of the windows at places a to b of the set of length n, which share a hash. Kept once found,
        so that a window which many documents and items hold is compared once for each document."""
        found = self.hot.get((n, a))
        if found is None:
            if len(self.hot) >= _KEPT:
                self.hot.clear()
            found = self.hot[n, a] = {}
            for p in self.sets[n][1][a:b].tolist():
                found.setdefault(self.words.joined(p, n), set()).add(int(self.words.text[p]))
        return found

    def find(self, doc: Words) -> Iterator[tuple[int, int, set[int]]]:
        """First word, length and items of each window that occurs in doc."""
        for n, (known, _, bitmap) in self.sets.items():
            first, h = doc.windows(n)
            maybe = np.flatnonzero(bitmap[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(known, h[maybe]), np.searchsorted(known, h[maybe], side="right")
            for at, a, b in zip(first[maybe[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                if items := self.items_of(n, a, b).get(doc.joined(at, n)):
                    yield at, n, items


def pieces(raw: bytes, window: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """Number of words and text of an item; of one with more than limit words, parts that overlap by a window less one word,
    so that each of its windows lies in one of them."""
    n = len(_ITEM_WORD.findall(raw))
    if n <= limit:
        yield n, raw
        return
    spans = [m.span() for m in _ITEM_WORD.finditer(raw)]
    limit = max(limit, window)
    for a in range(0, n - window + 1, limit - window + 1):
        part = spans[a : a + limit]
        yield len(part), raw[part[0][0] : part[-1][1]]


def blocks(benchmark: DataFrame, id: str, text: str, window: int, limit: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of at most limit words (and so windows), streamed to the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col(f"`{id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").toLocalIterator():
        for n, raw in pieces(row.t.encode(), window, limit):
            if held and size + n > limit:
                yield Block(held, window)
                held, size = [], 0
            held.append((row.i, raw))
            size += n
    if held:
        yield Block(held, window)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, columns: list[str] | None = None) -> DataFrame:
    """docs (or its columns) with n_words, n_hit, items (ids as strings, sorted) and spans of hit words (start and end
    in the UTF-8 bytes of the text).

    A-Z are lower-cased, words are runs of digits, letters and anything past 7F. A null text has no words; items without
    words have no window; those without an id hit but are not in items; an empty benchmark hits nothing; repeated items
    count once by id."""
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    held = [sc.broadcast(b) for b in blocks(benchmark, item_id, item_text, window)]

    def grouped(raw: list[bytes]) -> Iterator[list[bytes]]:
        some, size = [], 0
        for x in raw:
            if some and size + len(x) > _CHUNK:
                yield some
                some, size = [], 0
            some.append(x)
            size += len(x)
        if some:
            yield some

    def run(b: pa.RecordBatch):
        n_words, n_hit, items, spans = [], [], [], []
        parts = list(grouped(texts(b.column(b.schema.names.index(text)))))
        docs_ = [Words(raw) for raw in parts]
        changes = [np.zeros(len(doc.start) + 1, np.int32) for doc in docs_]
        found: list[dict[int, set[str]]] = [{} for _ in docs_]
        for bc in held:
            block = bc.value
            for doc, change, own in zip(docs_, changes, found, strict=True):
                for at, n, its in block.find(doc):
                    change[at] += 1
                    change[at + n] -= 1
                    own.setdefault(int(doc.text[at]), set()).update(block.ids[i] for i in its if block.ids[i] is not None)
            if len(held) > 1:
                bc.__dict__.pop("_value", None)  # a worker keeps one block at a time
        for raw, doc, change, own in zip(parts, docs_, changes, found, strict=True):
            hit = np.cumsum(change)[:-1] > 0
            counts = np.bincount(doc.text[hit], minlength=len(raw)) if len(hit) else np.zeros(len(raw), np.int64)
            after = np.cumsum(doc.count)
            for k in range(len(raw)):
                n_words.append(int(doc.count[k]))
                n_hit.append(int(counts[k]))
                items.append(sorted(own.get(k, ())))
                runs = spans_of(hit[after[k] - doc.count[k] : after[k]]) + (after[k] - doc.count[k]) if counts[k] else []
                spans.append([{"start": int(doc.start[s] - doc.base[k]), "end": int(doc.stop[e - 1] - doc.base[k])} for s, e in runs])
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    extra = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    return arrow_map(docs, docs.columns if columns is None else columns, extra, run, (text,))


def contaminated(n_words, n_hit, share: int = SHARE):
    return (n_hit > 0) & (n_hit * share >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = SHARE, **kw) -> DataFrame:
    """docs without contaminated ones; all others as they were."""
    words, hit = (fresh(docs, x) for x in ("n_words", "n_hit"))
    found = scan(docs, benchmark, text, **kw)
    return found.where(~contaminated(F.col(words), F.col(hit), share)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """docs with the hit words, and what stands between them, cut out of the text; other texts as they were."""
    prepare(docs.sparkSession)
    spans, cut = fresh(docs, "spans"), fresh(docs, "cut_text")

    def run(b: pa.RecordBatch):
        names = b.schema.names
        out = []
        for x, found in zip(b.column(names.index(text)).to_pylist(), b.column(names.index(spans)).to_pylist(), strict=True):
            if found:
                raw, ends = x.encode(), [0, *(s["end"] for s in found)]
                x = b"".join(raw[e : s["start"]] for e, s in zip(ends, found, strict=False)).decode() + raw[ends[-1] :].decode()
            out.append(x)
        return [pa.array(out, pa.string())]

    done = arrow_map(scan(docs, benchmark, text, **kw), [*docs.columns, spans], f"`{cut}` string", run)
    return done.select(*[F.col(f"`{cut}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def sha_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
