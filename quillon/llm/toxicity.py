"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (with word boundaries) and of itself; a document is the mean over its
words of the mean of their vectors. Misspelt and unseen words share n-grams with known ones. Embeddings and softmax are
fitted together on a bounded sample of labelled documents; every document is scored over its whole text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, prepare, texts

#: Documented bound of the fit: so many labelled documents of each class, the ones with the least hash of their id.
MAX_PER_CLASS = 1000
BUCKETS, DIM, EPOCHS, RATE = 1 << 20, 4, 40, 0.01
#: Features move only where their gradient is at least this share of the largest (threshold gradient descent).
THRESHOLD = 0.6
#: A feature must occur in so many labelled documents to be trained.
LEAST_DOCS = 2
SHORTEST, LONGEST_GRAM = 3, 5
#: Words without a vector that every mean takes in, so that one word of a short text doesn't decide alone.
PAD = 20
#: A word that a text repeats n times weighs n to this power, so that a repeated line doesn't outweigh the rest.
DAMPING = 0.5
REMEMBERED = 200_000
#: Characters of the pieces that a longer word (a passage without separators) is taken in.
PIECE = 64
_WORD = re.compile(rb"[a-z0-9\x80-\xff']+")
_LONG = re.compile(rb"[a-z0-9\x80-\xff']{%d}" % (PIECE + 1))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), digits, apostrophes and anything past 7F; those of more than PIECE characters
    as pieces that overlap by LONGEST_GRAM - 1, with a space at an end that was cut."""
    low = text.lower()
    words = _WORD.findall(low)
    if not _LONG.search(low):
        return words
    return [x for w in words for x in ([w] if len(w) <= PIECE else pieces(w))]


def pieces(word: bytes) -> list[bytes]:
    w = word.decode("utf-8", "replace")
    if len(w) <= PIECE:
        return [word]
    keep = LONGEST_GRAM - 1
    starts = range(0, len(w) - keep, PIECE - keep)
    return [f"{' ' if i else ''}{w[i : i + PIECE]}{' ' if i + PIECE < len(w) else ''}".encode() for i in starts]


def grams(word: bytes, buckets: int) -> list[int]:
    """Buckets of a word's character n-grams, and of the word, marked at both ends but where a piece was cut."""
    word = word[1:] if word[:1] == b" " else b"<" + word
    word = word[:-1] if word[-1:] == b" " else word + b">"
    crc, found = zlib.crc32, {word}
    if word.isascii():
        for n in range(SHORTEST, LONGEST_GRAM + 1):
            found.update([word[i : i + n] for i in range(len(word) - n + 1)])
    else:
        w = word.decode("utf-8", "replace")
        for n in range(SHORTEST, LONGEST_GRAM + 1):
            found.update([w[i : i + n].encode() for i in range(len(w) - n + 1)])
    return sorted([crc(g) % buckets for g in found])


class Model:
    """After the fit a word's part of the logit is one number: the mean over its n-grams of their weights."""

    def __init__(self, weight: np.ndarray, bias: float):
        used = np.flatnonzero(weight)
        self.__setstate__((len(weight), used, weight[used].astype(np.float32), float(bias)))

    def __getstate__(self):
        return self.state

    def __setstate__(self, state):
        self.state = state
        self.buckets, used, weight, self.bias = state
        self.weight: dict[int, float] = dict(zip(used.tolist(), weight.tolist(), strict=True))  # all others are 0
        self.known: dict[bytes, float] = {}

    def _word(self, w: bytes) -> float:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        g, get = grams(w, self.buckets), self.weight.get
        value = self.known[w] = sum([get(x, 0.0) for x in g]) / len(g)
        return value

    def score(self, text: bytes) -> float:
        """Probability of label 1; the bias alone where there is no word."""
        known, total, size = self.known, 0.0, float(PAD)
        for w, n in Counter(words_of(text)).items():
            v = known.get(w)
            if v is None:
                v = self._word(w)
            if n > 1:
                n **= DAMPING
            total += v * n
            size += n
        logit = self.bias + total / size
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, logit)))))


def fit(labelled: list[tuple[bytes, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, least_docs: int = LEAST_DOCS, threshold: float = THRESHOLD, prior: float | None = None, seed: int = 7) -> Model:
    """Embeddings (buckets x dim) and softmax (dim x 2) by gradient descent with momentum on the mean cross-entropy of all
    documents; the same input gives the same model. prior: the share of label 1 that scores should reflect (by default as in labelled)."""
    y = np.array([int(label) for _, label in labelled], np.int64)
    if len(y) == 0 or y.min(initial=1) == y.max(initial=0):
        p = prior if prior is not None and 0 < prior < 1 else (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(buckets), np.log(p / (1 - p)))
    vocabulary: dict[bytes, int] = {}
    doc_word = [np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], return_counts=True) for t, _ in labelled]
    doc_word = [(w, c**DAMPING) for w, c in doc_word]
    flat, n_gram = array("i"), np.zeros(len(vocabulary), np.int64)
    for w, k in vocabulary.items():
        g = grams(w, buckets)
        n_gram[k] = len(g)
        flat.extend(g)
    gram = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
    word = np.repeat(np.arange(len(vocabulary), dtype=np.int32), n_gram)
    share = np.repeat(1 / np.maximum(n_gram, 1), n_gram).astype(np.float32)
    d_doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(w) for w, _ in doc_word])
    d_word = np.concatenate([w for w, _ in doc_word]).astype(np.int32)
    d_part = np.concatenate([c / (c.sum() + PAD) for _, c in doc_word]).astype(np.float32)
    # only features seen in several documents are trained; the others keep the weight 0
    in_docs = np.bincount(d_word, minlength=len(vocabulary))
    often = np.bincount(gram, in_docs[word], minlength=buckets) >= least_docs
    keep = often[gram]
    gram, word, share = gram[keep].astype(np.int32), word[keep].astype(np.int32), share[keep]
    used, gram = np.unique(gram, return_inverse=True)

    # each feature in units of its spread over documents, so that rare and frequent ones compare
    mean = np.bincount(gram, share * np.bincount(d_word, d_part, minlength=len(vocabulary))[word], minlength=len(used)) / len(y)
    square = np.bincount(gram, share**2 * np.bincount(d_word, d_part**2, minlength=len(vocabulary))[word], minlength=len(used)) / len(y)
    unit = 1 / np.sqrt(square + mean**2)
    share = (share * unit[gram]).astype(np.float32)
    centre = (mean * unit).astype(np.float32)

    def product(rows, cols, part, x, n):
        """Sparse (n x ...) times x, column by column."""
        return np.stack([np.bincount(rows, part * x[cols, k], minlength=n) for k in range(x.shape[1])], axis=1).astype(np.float32)

    rng = np.random.default_rng(seed)
    e = np.zeros((len(used), dim), np.float32)
    w, b = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    onehot = np.eye(2, dtype=np.float32)[y]
    balance = (0.5 / np.bincount(y, minlength=2))[y][:, None].astype(np.float32)  # each class half the loss
    speed = [np.zeros_like(x) for x in (e, w, b)]
    for step in range(1, epochs + 1):
        vec = product(word, gram, share, e, len(vocabulary))
        h = product(d_doc, d_word, d_part, vec, len(y)) - centre @ e
        z = h @ w + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) * balance
        gh = g @ w.T
        gvec = product(d_word, d_doc, d_part, gh, len(vocabulary))
        grads = (product(gram, word, share, gvec, len(used)) - np.outer(centre, gh.sum(axis=0)), h.T @ g, g.sum(axis=0))
        for x, m, gr in zip((e, w, b), speed, grads, strict=True):
            m += 0.2 * (gr - m)
            size = np.abs(m).max(axis=1, keepdims=True) if m is speed[0] else np.abs(m)
            x -= rate * m / (size.max(initial=0) + 1e-12) * (size >= (threshold * size.max(initial=0) if m is speed[0] else 0))
    weight = np.zeros(buckets)
    weight[used] = unit * (e.astype(np.float64) @ (w[:, 1] - w[:, 0]))
    bias = float(b[1] - b[0]) - float(mean @ weight[used])
    if prior is not None and 0 < prior < 1:
        bias += float(np.log(prior / (1 - prior)))
    return Model(weight, bias)


def held_out(id: Column, folds: int = 5) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = MAX_PER_CLASS, folds: int = 5, **kw) -> Model:
    """Fits on labelled documents outside the held-out fold: at most per_class of each label, those of least hash of the id.
    Rows with null ids, labels other than 0 and 1, or without a document are left out; of documents that share an id one text
    counts."""
    known = labels.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id"), folds))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))  # a label once, the worse one
    n, toxic = known.agg(F.count("*"), F.sum("_y")).first()
    kw.setdefault("prior", (toxic or 0) / n if n else None)
    order = F.xxhash64("_id", F.lit(13))
    some = None
    for y, size in ((0, n - (toxic or 0)), (1, toxic or 0)):
        part = known.where(F.col("_y") == y)
        if size > 4 * per_class:  # so that one task doesn't sort what every other one holds: far more ids than needed are left
            part = part.where(F.shiftrightunsigned(order, 1) < int((1 << 63) * 2 * per_class / size))
        part = part.orderBy(order, "_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    found = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(some), "_id")  # at most 2 * per_class ids
    found = found.groupBy("_id", "_y").agg(F.max("_t").alias("_t"))
    rows = sorted((int(r._y), str(r._id), r._t or "") for r in found.collect())
    return fit([(t.encode(), y) for y, _, t in rows], **kw)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", columns: list[str] | None = None) -> DataFrame:
    """docs (or its columns) with the probability of label 1 over each whole text. Null and empty texts get the score that
    the model has without words. Row by row: repeated rows and other columns pass as they are."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(b: pa.RecordBatch):
        m = held.value
        return [pa.array([m.score(x) for x in texts(b.column(b.schema.names.index(text)))], pa.float64())]

    return arrow_map(docs, docs.columns if columns is None else columns, f"`{out}` double", run, (text,))


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without rows that score at least the threshold."""
    name = fresh(docs, "toxicity")
    return score(docs, model, text, name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
