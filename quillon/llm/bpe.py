"""Byte-level BPE with a rank file: whole texts to ids and back.

Each match of the pattern is merged on its own. A segment tree over its byte positions keeps the leftmost minimum pair
rank at the root; a merge unlinks one neighbour and updates three leaves, so a match of n bytes takes O(n log n) however
long it is. Merged matches are remembered in two bounded generations per worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, prepare, texts

#: Matches remembered per generation and worker, and the longest one, in bytes; longer ones are merged one by one.
REMEMBERED, LONGEST = 250_000, 64
_NONE = 1 << 62
_AT = (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match: the whole if it has a rank, else merges of the leftmost pair of least rank until none has one."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    get = ranks.get
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # live neighbours; end of the token at i
    tree = [_NONE] * (2 * n)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[n + i] = r << 32 | i
    for k in range(n - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (best := tree[1]) != _NONE:
        i = best & _AT
        j = right[i]
        k = right[i] = right[j]
        end[i] = end[j]
        if k < n:
            left[k] = i
            r = get(piece[i : end[k]]) if end[k] - i <= longest else None
            new = _NONE if r is None else r << 32 | i
        else:
            new = _NONE
        changes = [(j, _NONE), (i, new)]
        h = left[i]
        if h >= 0:
            r = get(piece[h : end[i]]) if end[i] - h <= longest else None
            changes.append((h, _NONE if r is None else r << 32 | h))
        for at, value in changes:
            at += n
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class PairTable:
    """Merged id of a pair of ids: open addressing over two numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        get, rows = ranks.get, []
        for token, r in ranks.items():
            for s in range(1, len(token)):
                if (a := get(token[:s])) is not None and (b := get(token[s:])) is not None:
                    rows.append((a << 32 | b, r))
        self.bits = max(8, (3 * max(1, len(rows))).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left = np.array(rows, np.int64).reshape(-1, 2)
        at = self._slot(left[:, 0])
        while len(left):  # of several at one free slot the last one written stays, the others go on
            free = self.key[at] == -1
            self.key[at[free]], self.value[at[free]] = left[free, 0], left[free, 1]
            rest = self.key[at] != left[:, 0]
            self.value[at[~rest]] = left[~rest, 1]
            left, at = left[rest], (at[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, -1 for none."""
        keys = a << 32 | b
        at = self._slot(keys)
        held = self.key[at]
        out = np.where(held == keys, self.value[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (1 << self.bits) - 1
            held = self.key[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.value[at[todo[same]]]
            todo = todo[~same & (held != -1)]
        return out


def merge_many(pieces: list[bytes], leaves: int, byte_rank: np.ndarray, pairs: PairTable) -> list[bytes]:
    """merge() for many matches of 2 to `leaves` bytes (a power of two) side by side: one segment tree a column."""
    m, n_pieces = leaves, len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n_pieces)
    raw = np.frombuffer(b"".join(p.ljust(m, b"\0") for p in pieces), np.uint8).reshape(n_pieces, m)
    place = np.arange(m)
    alive = place < size[:, None]
    token = np.concatenate([byte_rank[raw], np.zeros((n_pieces, 1), np.int64)], axis=1)
    right = np.tile(np.append(np.arange(1, m + 1), m), (n_pieces, 1))
    right[np.arange(n_pieces), size - 1] = m  # m: none
    left = np.tile(np.append(np.arange(-1, m - 1), m), (n_pieces, 1))
    left[:, 0] = m
    rank = pairs.find(token[:, : m - 1].ravel(), token[:, 1:m].ravel()).reshape(n_pieces, m - 1)
    tree = np.full((2 * m, n_pieces), _NONE, np.int64)
    open_ = (rank >= 0) & alive[:, 1:]
    tree[m : 2 * m - 1] = np.where(open_, rank << 8 | place[: m - 1], _NONE).T
    half = m // 2
    while half:
        tree[half : 2 * half] = np.minimum(tree[2 * half : 4 * half : 2], tree[2 * half + 1 : 4 * half : 2])
        half //= 2
    w = np.flatnonzero(tree[1] != _NONE)
    while len(w):
        best = tree[1, w]
        i, merged = best & 255, best >> 8
        j = right[w, i]
        k, h = right[w, j], left[w, i]
        right[w, i], left[w, k], token[w, i], alive[w, j] = k, i, merged, False
        left[w, np.full_like(k, m)] = m
        found = pairs.find(np.concatenate([merged, token[w, h]]), np.concatenate([token[w, k], merged]))
        after, before = found[: len(w)], found[len(w) :]
        after = np.where((after >= 0) & (k < m), after << 8 | i, _NONE)
        before = np.where((before >= 0) & (h < m), before << 8 | h, _NONE)
        tree[m + j, w], tree[m + i, w] = _NONE, after
        h = np.where(h < m, h, i)
        tree[m + h, w] = np.where(h == i, after, before)
        for at in (m + j, m + i, m + h):
            while at[0] > 1:
                at = at >> 1
                tree[at, w] = np.minimum(tree[2 * at, w], tree[2 * at + 1, w])
        w = w[tree[1, w] != _NONE]
    ids = token[:, :m][alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@cache
def _library_classes() -> dict[str, frozenset[str]]:
    """The characters that the tiktoken library takes for \\p{L}, \\p{N} and \\s; its Unicode version is its own."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    return {p: frozenset(bytes(tiktoken.Encoding(p, pat_str=p + "+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()) for p in (r"\p{L}", r"\p{N}", r"\s")}


def _as_ranges(chars) -> str:
    code = np.sort(np.fromiter(map(ord, chars), np.int64, len(chars)))
    first = code[np.concatenate(([True], np.diff(code) > 1))]
    last = code[np.concatenate((np.diff(code) > 1, [True]))]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def _latin(text: str) -> bool:
    """Up to U+00FF, where all versions agree; a cheap test of the text's storage."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Matches of a pattern as the tiktoken library finds them. The regex module is fast, but follows another version of
    Unicode: a text with a character whose class differs goes by a pattern with the library's classes spelt out."""

    def __init__(self, pattern: str):
        self.fast = regex.compile(pattern)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        known = _library_classes()
        self.odd = re.compile("[" + _as_ranges(frozenset().union(*(chars ^ frozenset(regex.findall(p, every)) for p, chars in known.items())) or "\ue000") + "]")
        spelt = {p: _as_ranges(chars) for p, chars in known.items()}
        out, inside = [], False
        for item in re.findall(r"\\[pP]\{\w+\}|\\.|[^\\]", pattern, re.DOTALL):
            inside = item == "[" or inside and item != "]"
            if item in spelt:
                item = spelt[item] if inside else f"[{spelt[item]}]"
            elif item == r"\S" and not inside:
                item = f"[^{spelt[chr(92) + 's']}]"
            out.append(item)
        self.exact = re.compile("".join(out))

    def split(self, text: str) -> Iterator[list[str]]:
        """All matches, in lists of bounded length."""
        pattern = self.exact if not _latin(text) and self.odd.search(text) else self.fast
        if len(text) <= 1 << 20:
            yield pattern.findall(text)
        else:
            matches = pattern.finditer(text)
            while some := [m[0] for m in islice(matches, 100_000)]:
                yield some


class Codec:
    """Encodes and decodes by one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.split = Splitter(pattern).split
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.token[r] = token
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(self.ranks)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Puts what is missing of pieces into self.young."""
        young = self.young
        by_leaves: dict[int, list[str]] = {}
        for p in pieces.difference(young):
            if (packed := self.old.get(p)) is None:
                raw = p.encode()
                if raw in self.ranks:
                    packed = self.ranks[raw].to_bytes(4, "little")
                elif len(raw) <= LONGEST:
                    by_leaves.setdefault(1 << (len(raw) - 1).bit_length(), []).append(p)
                    continue
                else:
                    packed = np.array(merge(raw, self.ranks, self.longest), "<u4").tobytes()
            young[p] = packed
        for leaves, some in by_leaves.items():
            for a in range(0, len(some), 8192):
                part = some[a : a + 8192]
                young.update(zip(part, merge_many([p.encode() for p in part], leaves, self.byte_rank, self.pairs), strict=True))

    def encode_batch(self, batch: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        a = 0
        while a < len(batch):
            b, size = a, 0
            while b < len(batch) and (b == a or size + len(batch[b]) <= 1 << 20):
                size += len(batch[b])
                b += 1
            if size > 1 << 20:  # one long text
                yield b"".join(map(self._packed, self.split(batch[a])))
            else:
                lists = [next(self.split(t)) for t in batch[a:b]]
                self._learn(set().union(*lists))
                get = self.young.__getitem__
                yield from [b"".join(map(get, x)) for x in lists]
                self._forget()
            a = b

    def _packed(self, pieces: list[str]) -> bytes:
        self._learn(set(pieces))
        out = b"".join(map(self.young.__getitem__, pieces))
        self._forget()
        return out

    def _forget(self) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = {k: v for k, v in self.young.items() if len(k) <= LONGEST}, {}

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def tokenize(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", columns: list[str] | None = None) -> DataFrame:
    """df (or its columns) with the ids of each whole text, little-endian unsigned 32-bit, as binary.

    Null text counts as empty: no ids. Works row by row: repeated rows, ties and other columns pass as they are."""
    prepare(df.sparkSession)

    def run(b: pa.RecordBatch):
        c = codec(path, pattern)
        return [pa.array(list(c.encode_batch([x or "" for x in b.column(b.schema.names.index(text)).to_pylist()])), pa.binary())]

    return arrow_map(df, df.columns if columns is None else columns, f"`{out}` binary", run, (text,))


def detokenize(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each row's ids stand for. Null ids decode to nothing; ids without a token raise."""
    prepare(df.sparkSession)

    def run(b: pa.RecordBatch):
        c = codec(path, pattern)
        return [pa.array([c.decode(x) for x in texts(b.column(b.schema.names.index(ids)))], pa.binary())]

    return arrow_map(df, df.columns, f"`{out}` binary", run)


def digests(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 (and the ids) of each text, encoded and decoded in one pass: what
    tokenize() and detokenize() give, without sending ids and bytes between processes."""
    prepare(df.sparkSession)

    def run(b: pa.RecordBatch):
        c = codec(path, pattern)
        n, ids, back, raw = [], [], [], []
        for packed in c.encode_batch([x or "" for x in b.column(b.schema.names.index(text)).to_pylist()]):
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(c.decode(packed)).hexdigest())
            raw.append(packed if keep_ids else b"")
        return [pa.array(n, pa.int64()), pa.array(ids), pa.array(back), *([pa.array(raw, pa.binary())] if keep_ids else [])]

    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return arrow_map(df, [id], extra, run, (text,))
