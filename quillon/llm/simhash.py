"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints come from whole texts in one Arrow pass. Equal fingerprints are one node, so copies cost an aggregation.
Candidates share a band key (pigeonhole: with more bands than the radius, some combination of whole bands is equal), and
are compared bit-sliced: 64 bit planes stored vertically, carry-save counters for 64 pairs a machine word, blocks left as
soon as every lane is past the radius. Each block reports a forest of links, never all pairs. deduplicate() looks further:
pairs come from masks of sampled bits and a wider radius, and each is checked on its shingles. What fingerprints tell apart
or no mask meets is then looked for between the classes found, by an exact join on prefixes of the shingle sets. Components of the links are found by alternating large and small stars, written to the shared folder.
Nothing but counts reaches the driver.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_below, drop_staged, fresh, prepare, staged, texts

RADIUS, SHINGLE = 3, 3
#: Near copies: similarity over shingles of so many words, bits between fingerprints that are compared, and the share of pairs
#: at the threshold that the masks should miss at most.
SIMILARITY, COPY_SHINGLE, COPY_RADII, MISS = 0.8, 5, (3, 5, 7, 9, 12), 0.01
#: Independent fingerprints of a text that the masks are dealt over, so that one unlucky fingerprint hides no pair.
PRINTS = 4
#: Cells that a task counts shingles in to order them, and the most that are told apart as frequent; least number of parts that
#: prefixes are dealt by. Pairs don't depend on them.
CELL_BITS, OFTEN, PARTS = 24, 50_000, 256
#: Rows of a bucket of prefixes from which on its pairs are told apart by sketches of so many bits; below, they are few a row.
WIDE, SKETCH = 16, 2048
#: Rows of one side of a comparison; a larger bucket is dealt out as pairs of such blocks.
BLOCK = 1536
#: Each byte's bits as eight byte-wide counters of one word, high bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """64 bits: bit b is set if more than half of the shingles' XXH64 (seed 42) have it. A-Z lower-cased; words are runs
    of bytes other than space and 09-0D; fewer words than n make one shingle; none: 0."""
    return _majority(_hashes(text.lower().split(), n))


def _cuts(words: list[bytes], n: int):
    """Starts and ends of the shingles of n words in the words joined by spaces; more words than n."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    return zip((ends - sizes)[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    joined = b" ".join(words)
    if len(words) <= n:
        raw = xxhash.xxh64_digest(joined, 42) if words else b""
    else:
        digest = xxhash.xxh64_digest
        raw = b"".join([digest(joined[a:b], 42) for a, b in _cuts(words, n)])
    return np.frombuffer(raw, ">u8")


def _majority(hashes: np.ndarray) -> int:
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    spread = _SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    counts = np.add.reduceat(spread, range(0, len(spread), 255), axis=0)  # a byte-wide counter holds 255
    counts = counts.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(spread)).tobytes(), "big")


def prints(words: list[bytes], n: int = SHINGLE, many: int = PRINTS) -> list[int]:
    """Fingerprints of different hashes of the same shingles: the first is fingerprint(), the others mix its hashes anew."""
    h = _hashes(words, n)
    out, mixed = [_majority(h)], h.astype(np.uint64)
    for _ in range(many - 1):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(mixed.astype(">u8")))
    return out


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", n: int = SHINGLE, columns: list[str] | None = None) -> DataFrame:
    """df's columns and the fingerprint as a signed long. Null text counts as empty: fingerprint 0."""
    prepare(df.sparkSession)

    def run(b: pa.RecordBatch):
        col = b.column(b.schema.names.index(text)).cast(pa.large_binary()).to_pylist()
        return [pa.array(np.array([fingerprint(x or b"", n) for x in col], np.uint64).view(np.int64))]

    return arrow_map(df, df.columns if columns is None else columns, f"`{out}` long", run, (text,))


# --- bit-sliced comparison -------------------------------------------------------------------------------------------


def planes(fp: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: plane p holds bit p of every fingerprint, one lane each."""
    n = len(fp)
    bits = np.zeros((64, -(-max(n, 1) // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _lanes(n: int) -> np.ndarray:
    """Words with ones in the first n lanes."""
    return np.packbits(np.arange(-(-n // 64) * 64) < n, bitorder="little").view("<u8")


def within(diff, shape: tuple, live: np.ndarray, radii: tuple[int, ...]) -> list[np.ndarray]:
    """For each radius (ascending) the lanes of live whose distance is at most that. diff(p): words with a one where plane p
    differs.

    Saturating carry-save counters of as many bits a lane as the greatest radius needs; a lane past that stays dead, and the
    block is abandoned when no lane lives."""
    radius = radii[-1]
    width = radius.bit_length()
    counter = [np.zeros(shape, np.uint64) for _ in range(width)]
    dead = np.broadcast_to(~live, shape).copy()
    for p in range(64):
        carry = diff(p)
        for c in counter:
            carry, c[...] = c & carry, c ^ carry
        dead |= carry  # counted past 2 ** width - 1
        if p % 8 == 7:
            if radius + 1 < 1 << width:
                dead |= _above(counter, radius)
            if (dead == _ONES).all():
                return [~dead] * len(radii)
    return [~(dead | _above(counter, r)) if r + 1 < 1 << width else ~dead for r in radii]


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter exceeds radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def block_links(fp: np.ndarray, radii: tuple[int, ...] = (RADIUS,), rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of fp that connect, for each radius, what all pairs within it connect (a forest for each: fewer pairs
    than len(fp)), by blocks of queries against all lanes and a search over the bit rows."""
    n = len(fp)
    vertical, live = planes(fp.view(np.uint64)), _lanes(n)
    near = np.empty((len(radii), n, vertical.shape[1]), np.uint64)
    for a in range(0, n, rows):
        q = fp[a : a + rows].view(np.uint64)
        flip = [(~((q >> np.uint64(p)) & np.uint64(1)) + np.uint64(1))[:, None] for p in range(64)]  # 0 or all ones
        near[:, a : a + rows] = within(lambda p: vertical[p][None, :] ^ flip[p], (len(q), vertical.shape[1]), live[None, :], radii)
    child, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in near:
        left = live.copy()
        for root in range(n):
            if not left[root // 64] >> np.uint64(root % 64) & np.uint64(1):
                continue
            left[root // 64] &= ~(np.uint64(1) << np.uint64(root % 64))
            todo = [root]
            for x in todo:  # grows
                if (reach := own[x] & left).any():
                    left &= ~reach
                    new = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little"))
                    child.append(new)
                    parent.append(np.full(len(new), x))
                    todo += new.tolist()
    a, b = np.concatenate(child), np.concatenate(parent)
    if len(radii) > 1:
        both = np.unique(np.maximum(a, b) * n + np.minimum(a, b))  # forests share most of their pairs
        a, b = both // n, both % n
    return a, b


def small_links(fp: np.ndarray, group: np.ndarray, radii: tuple[int, ...] = (RADIUS,)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places inside small groups that connect, for each radius, what all pairs within it connect: lane i is
    compared with lane i + s for each shift s, over all groups at once. Groups come largest first, so that a shift reads a
    prefix; a pair that is already connected under a radius is left out there."""
    _, inverse, sizes = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((group, -sizes[inverse]))
    fp, group, size = fp[order], group[order], sizes[inverse][order]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    roots = [np.arange(len(fp)) for _ in radii]
    vertical = planes(fp.view(np.uint64))
    for s in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -s, side="left"))  # rows in groups of more than s
        if n <= s:
            break
        same = np.zeros(-(-n // 64) * 64, bool)
        same[: n - s] = (group[: n - s] == group[s:n]) & (roots[0][: n - s] != roots[0][s:n])
        if not same.any():
            continue
        words, skip, bit = len(same) // 64, s // 64, np.uint64(s % 64)
        padded = np.zeros((64, words + skip + 1), np.uint64)
        have = min(vertical.shape[1], words + skip + 1)
        padded[:, :have] = vertical[:, :have]

        def shifted(p, words=words, skip=skip, bit=bit, padded=padded):
            x = padded[p, skip : skip + words]
            return x if not bit else (x >> bit) | (padded[p, skip + 1 : skip + 1 + words] << (np.uint64(64) - bit))

        hits = within(lambda p, f=shifted, words=words: vertical[p, :words] ^ f(p), (words,), np.packbits(same, bitorder="little").view("<u8"), radii)
        if not hits[-1].any():
            continue
        new = np.zeros(len(same), bool)
        for k, hit in enumerate(hits):
            i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            root = roots[k]
            i = i[root[i] != root[i + s]]
            new[i] = True
            while len(i):  # join the groups' labels until each pair has one
                low, high = np.minimum(root[i], root[i + s]), np.maximum(root[i], root[i + s])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
                i = i[root[i] != root[i + s]]
            roots[k] = root
        i = np.flatnonzero(new)
        a.append(i + s)
        b.append(i)
    return order[np.concatenate(a)], order[np.concatenate(b)]


def bucket_links(batches, radii: tuple[int, ...] = (RADIUS,), small: int = 48, rows: int = 50_000):
    """Links of whole buckets; input sorted by bucket (columns bucket, fp, node), batches of any length. For each radius a
    forest, or little more: never all pairs. In large buckets the middle and the last radius do: of copies what this or a
    mask leaves out is found by missed()."""
    coarse = tuple(dict.fromkeys((radii[len(radii) // 2], radii[-1])))

    def flush(k: np.ndarray, f: np.ndarray, node: np.ndarray):
        if not len(k):
            return
        cut = np.flatnonzero(np.diff(k)) + 1
        size = np.diff(np.concatenate(([0], cut, [len(k)])))
        start = np.concatenate(([0], cut))
        big = np.repeat(size > small, size)
        few = node[~big]
        x, y = small_links(f[~big], k[~big], radii)
        out = [(few[x], few[y])]
        for s, n in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
            x, y = block_links(f[s : s + n], coarse)
            out.append((node[s + x], node[s + y]))
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["src", "dst"])

    for k, f, node in whole_buckets(batches, rows):
        yield from flush(k, f, node)


def whole_buckets(batches, rows: int):
    """Columns of batches that are sorted by the first one, as arrays of whole buckets, cut where about so many rows are held."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= rows:
            found = [np.concatenate(x) for x in zip(*held, strict=True)]
            k = found[0]
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            yield [x[:last] for x in found]
            held = [[x[last:] for x in found]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def band_keys(fp: Column, n_rows: int, radius: int = RADIUS) -> Column:
    """Array of the buckets of a fingerprint (with it): any two within the radius share one. The more fingerprints, the more
    bits a key has: 64 bits are cut into radius + e parts and a key holds e of them, for the least e with few rows a key."""
    for e in (1, 2, 3):
        parts = radius + e
        if n_rows <= 2 ** (64 * e // parts) * 64:
            break
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << cuts[k + 1] - cuts[k]) - 1) << cuts[k] for k in range(parts)]
    return table_keys([fp], [sum(masks[k] for k in c) for c in combinations(range(parts), e)])


def tables(n_rows: int, agree: float, miss: float = MISS) -> list[int]:
    """Masks of bits such that two fingerprints each of whose bits agrees with probability agree are equal under none of them
    with probability miss at most. The more rows, the more bits a mask has, so that a bucket holds few unrelated rows."""
    bits = min(32, max(4, math.ceil(math.log2(max(1, n_rows) / 16))))
    count = math.ceil(math.log(miss) / math.log(1 - agree**bits))
    rng = np.random.default_rng(5)
    deck = np.concatenate([rng.permutation(64) for _ in range(-(-count * bits // 64) + 1)])  # each bit as often as any other
    masks, at = [], 0
    for _ in range(count):
        own: list[int] = []
        while len(own) < bits:
            if deck[at] in own:  # where one permutation ends and the next begins: take the bit later
                later = next(k for k in range(at + 1, len(deck)) if deck[k] not in own)
                deck[[at, later]] = deck[[later, at]]
            own.append(int(deck[at]))
            at += 1
        masks.append(sum(1 << k for k in own))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_keys(fps: list[Column], masks: list[int]) -> Column:
    """Array of bucket and fingerprint, one for each mask; masks go round the fingerprints."""
    rows = []
    for i, m in enumerate(masks):
        fp = fps[i % len(fps)]
        rows.append(F.struct(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)).cast("long"))).alias("bucket"), fp.alias("fp")))
    return F.array(*rows)


def links(nodes: DataFrame, keys: Column, radii: tuple[int, ...] = (RADIUS,), block: int = BLOCK) -> DataFrame:
    """Links (src > dst) of nodes that connect exactly what all pairs within a radius that share one of the keys
    (bucket and fingerprint) connect, for each of the radii."""
    keyed = nodes.select("node", F.explode(keys).alias("k")).select("node", "k.bucket", "k.fp")
    return dealt(keyed, ["fp", "node"], block).mapInArrow(lambda it: bucket_links(it, radii), "src long, dst long")


def dealt(keyed: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Rows of keyed (bucket, node, more) as bucket and columns, sorted by bucket, so that any two rows of a bucket meet in one."""
    large = keyed.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("k"))
    pairs = keyed.join(broadcast_below(staged(large, "large-buckets"), 200_000), "bucket", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("k").cast("long")).cast("int")
    # a large bucket: block i meets block j in the pair (least, greatest); its rows go to k pairs
    out = pairs.select(*columns, "bucket", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    out = out.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), *columns)
    return out.repartition("bucket").sortWithinPartitions("bucket")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches. Alternating large and small stars until nothing moves;
    each round is written to the shared folder and the last one deleted. Hubs are aggregated before they are joined."""
    spark = edges.sparkSession
    now = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = staged(large, "large")
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        after = staged(small.unionByName(low.select("src", F.col("m").alias("dst"))).distinct(), "small")
        drop_staged(now, large)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return after.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(after.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        before, now = tuple(state), after


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """id, fingerprint (signed long), component_id of each row: the least id that a chain of fingerprints at most radius
    bits apart reaches, its own included.

    Null ids stay in the result and never name a component (null if a component has no other); repeated rows stay; null
    and empty texts have fingerprint 0 and are linked as any other; an empty table gives an empty result."""
    fp = fresh(df, "fingerprint")
    slim = staged(with_fingerprint(df, text, fp, n, [id]).select(F.col(f"`{id}`").alias("id"), F.col(f"`{fp}`").alias("fp")), "fingerprints")
    return classes(slim, radius).select(F.col("id").alias(id), F.col("fp").alias("fingerprint"), "component_id")


def classes(slim: DataFrame, radius: int = RADIUS) -> DataFrame:
    """slim (id, fp, more...) with component_id; slim should be staged, as it is read several times."""
    reps = staged(slim.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    nodes = reps.select(F.col("fp").alias("node"), "fp")
    roots = staged(connected(links(nodes, band_keys(F.col("fp"), reps.count(), radius), (radius,))), "roots")
    linked = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    lookup = linked.join(named, "root").select("fp", "component_id")
    return slim.join(lookup, "fp", "left")


# --- near copies by exact similarity ---------------------------------------------------------------------------------


def shingles(text: bytes, n: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes (XXH3) of the word shingles of a text, words as in fingerprint(); fewer words than n
    are one shingle, none have none."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest(joined)] if words else [], np.uint64)
    digest = xxhash.xxh3_64_digest
    raw = b"".join([digest(joined[a:b]) for a, b in _cuts(words, n)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def agreement(similarity: float, n: int = COPY_SHINGLE, m: int = SHINGLE) -> float:
    """Probability that a bit of m-word fingerprints agrees for texts of that Jaccard similarity over n-word shingles, if
    they differ by single words here and there."""
    words = (1 - similarity) / (1 + similarity) / n  # share of words that differ
    return 1 - math.acos(max(0.0, 1 - m * words)) / math.pi


def copies(marked: DataFrame, text: str, keys: list[str], similarity: float, n: int, radii: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """node, root of the texts of marked that a chain of texts, each at least that similar to the next, connects; and
    all nodes with the least keys of their rows. keys tell different rows apart. A forest for each of the radii is checked, so
    that a close pair is seldom left out for a path through a text that turns out too different; missed() finds the others."""
    prepare(marked.sparkSession)

    def marks(b: pa.RecordBatch):
        words = [x.lower().split() for x in texts(b.column(b.schema.names.index(text)))]
        made = [[xxhash.xxh3_64_intdigest(b" ".join(w)), *prints(w)] for w in words]
        return [pa.array(x) for x in np.array(made, np.uint64).view(np.int64).reshape(-1, 1 + PRINTS).T]

    fps = [f"fp{k}" for k in range(PRINTS)]
    slim = staged(arrow_map(marked, keys, "node long, " + ", ".join(f"{x} long" for x in fps), marks, (text,)), "prints")
    # equal texts are one node, whatever their case and spacing
    first = staged(slim.groupBy("node").agg(*[F.min(x).alias(x) for x in fps], F.min(F.struct(*keys)).alias("of")), "nodes")
    masks = tables(first.count(), agreement(similarity, n))
    found = staged(links(first, table_keys([F.col(x) for x in fps], masks), radii).where("src <> dst").distinct(), "near")
    drop_staged(slim)
    close = staged(alike(found, first, marked, text, keys, similarity, n), "alike")
    drop_staged(found)
    return missed(close, first, marked, text, keys, similarity, n), first


def alike(found: DataFrame, first: DataFrame, marked: DataFrame, text: str, keys: list[str], similarity: float, n: int) -> DataFrame:
    """Pairs of found (src, dst) whose shingle sets are that similar. Outlines of 256 counts rule out most of the others before whole
    sets are put beside pairs."""
    found = staged(possible(found, of_ends(found, first, marked, text, keys, "counts binary", lambda x: pa.array([outline(shingles(s, n)) for s in x], pa.binary())), similarity), "possible")
    sets = lambda x: pa.array([shingles(s, n).view(np.int64) for s in x], pa.list_(pa.int64()))
    of = of_ends(found, first, marked, text, keys, "words array<long>", sets)
    both = found.join(of.select(F.col("node").alias("src"), F.col("words").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("words").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("src", "dst")


def of_ends(found: DataFrame, first: DataFrame, marked: DataFrame, text: str, keys: list[str], column: str, make) -> DataFrame:
    """node and a column that make gives for texts, for each node of found; staged."""
    ends = found.select(F.col("src").alias("node")).unionByName(found.select(F.col("dst").alias("node"))).distinct()
    chosen = first.join(ends, "node", "left_semi").select("node", *[F.col(f"of.`{k}`").alias(k) for k in keys])
    held = marked.select(*keys, F.col(f"`{text}`").alias("held_text")).join(broadcast_below(chosen, 500_000), keys).select("node", "held_text")
    return staged(arrow_map(held, ["node"], column, lambda b: [make(texts(b.column(1)))], ("held_text",)).dropDuplicates(["node"]), "shingles")


def outline(s: np.ndarray) -> bytes:
    """Counts of hashes by their last byte, 255 at most."""
    return np.minimum(255, np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256)).astype(np.uint8).tobytes()


def possible(found: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """Pairs of found but for those whose outlines show that they share too little: a cell holds at most the lesser count of
    common hashes. Cells that are full on both sides show nothing."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 256) for c in b.columns[2:])
            most, total = np.minimum(x, y).sum(axis=1, dtype=np.int64), x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
            good = (most >= similarity / (1 + similarity) * total - 1e-6) | ((x == 255) & (y == 255)).any(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in b.columns[:2]], names=["src", "dst"])

    both = found.join(of.select(F.col("node").alias("src"), F.col("counts").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("counts").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def sketch(s: np.ndarray) -> bytes:
    """Parities of the counts of hashes by their last bits. Where sketches differ in a bit so do the sets in a hash: sets differ
    by at least as many hashes as their sketches by bits."""
    return np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _apart(similarity: float) -> float:
    """Sets of a and b hashes that are that similar differ by at most this share of a + b."""
    return (1 - similarity) / (1 + similarity)


def _words(sketches: np.ndarray) -> np.ndarray:
    """A row of words for each sketch, zeros for none."""
    none = bytes(SKETCH // 8)
    return np.frombuffer(b"".join([x or none for x in sketches.tolist()]), np.uint64).reshape(-1, SKETCH // 64)


def sizes(marked: DataFrame, text: str, n: int) -> DataFrame:
    """node, size, same (a hash of the set) and sketch of each text; and as rows of their own (with cell) the cells of hashes that hold
    many more shingles of a task than others, and their counts."""

    def run(batches):
        seen, total = np.zeros(1 << CELL_BITS, np.int32), 0
        names = ["node", "size", "same", "sketch", "cell", "n"]
        for b in batches:
            nodes, many, same, drawn = [], [], [], []
            for x in texts(b.column(0)):
                s = shingles(x, n)
                np.add.at(seen, s >> np.uint64(64 - CELL_BITS), 1)
                nodes.append(node_of(x))
                many.append(len(s))
                same.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                drawn.append(sketch(s))
            total += sum(many)
            none = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([_long(nodes), pa.array(many, pa.int32()), _long(same), pa.array(drawn, pa.binary()), none, none], names=names)
        hot = np.flatnonzero(seen > 2 + 6 * total / len(seen))
        none = pa.nulls(len(hot), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none, pa.nulls(len(hot), pa.binary()), pa.array(hot), pa.array(seen[hot].astype(np.int64))], names=names)

    return marked.select(F.col(f"`{text}`")).mapInArrow(run, "node long, size int, same long, sketch binary, cell long, n long")


def node_of(text: bytes) -> int:
    """Equal texts are one node, whatever their case and spacing."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))


def _long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def frequent(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells that sizes() counted, ascending, and their counts over all texts. They only set the order of shingles: whatever it
    is, the same pairs are found, but rare shingles first make small buckets."""
    cells = seen.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n"))
    most = cells.orderBy(F.col("n").desc(), "cell").limit(OFTEN).toPandas().sort_values("cell")
    return most["cell"].to_numpy(np.uint64), most["n"].to_numpy(np.int64)


def in_prefix(s: int, similarity: float) -> int:
    """How many shingles of a set of s are its prefix: sets that are that similar share one of it, in any common order."""
    return s - math.ceil(similarity * s - 1e-6) + 1 if s else 0


def shared_prefixes(marked: DataFrame, text: str, n: int, similarity: float, cells: np.ndarray, often: np.ndarray) -> DataFrame:
    """bucket, node of the shingles in prefixes that more than one node has in its prefix. Most shingles are in one text alone:
    they go through the exchange as 4 bytes and a node, packed by a part of the hash range, and no further."""
    size = marked.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = max(PARTS, -(-size // (32 << 20)))

    def run(batches):
        held, nodes, many = [], [], 0

        def flush():
            hashes = np.concatenate(held)
            owner = np.repeat(np.array(nodes, np.uint64), [len(x) for x in held])
            part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            low, owner, cut = hashes[order].astype(np.uint32), owner[order], np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            blobs = [[x[cut[k] : cut[k + 1]].tobytes() for k in some] for x in (low, owner)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], names=["part", "low", "node"])

        for b in batches:
            for x in texts(b.column(0)):
                s = shingles(x, n)
                if len(s):
                    cell = s >> np.uint64(64 - CELL_BITS)
                    at = np.searchsorted(cells, cell) % max(1, len(cells))
                    weight = np.where(cells[at] == cell, often[at], 0) if len(cells) else np.zeros(len(s), np.int64)
                    held.append(s[np.lexsort((s, weight))[: in_prefix(len(s), similarity)]])
                    nodes.append(node_of(x))
                    many += len(held[-1])
                if many > 2_000_000:
                    yield flush()
                    held, nodes, many = [], [], 0
        if many:
            yield flush()

    def meet(batches):
        def flush(part, low, node):
            low, node = (np.frombuffer(b"".join(x), t) for x, t in ((low, np.uint32), (node, np.int64)))
            order = np.lexsort((node, low))
            low, node = low[order], node[order]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (node[1:] != node[:-1])))  # copies are one node
            low, node = low[new], node[new]
            same = low[1:] == low[:-1]
            at = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
            bucket = (np.int64(part) << np.int64(32)) | low[at].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node[at])], names=["bucket", "node"])

        now, low, node = None, [], []
        for b in batches:
            for k, x, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != now:
                    if low:
                        yield flush(now, low, node)
                    now, low, node = k, [], []
                low.append(x)
                node.append(y)
        if low:
            yield flush(now, low, node)

    packed = marked.select(F.col(f"`{text}`")).mapInArrow(run, "part int, low binary, node binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "bucket long, node long")


def missed(close: DataFrame, first: DataFrame, marked: DataFrame, text: str, keys: list[str], similarity: float, n: int) -> DataFrame:
    """node, root of all texts that a chain of texts, each at least that similar to the next, connects; close: links known.

    Sets of s shingles that are that similar share one of the first s - ceil(similarity s) + 1 shingles in any common order.
    Texts of different classes that share as many of these as their sizes ask for are checked. Rows of wide buckets carry
    sketches: the links of a forest of the closest are checked first, so that a large group is one class when pairs are made, and then
    only pairs whose sketches don't show that they differ too much."""
    seen = staged(sizes(marked, text, n), "sizes")
    cells, often = frequent(seen)
    sets = seen.where("node is not null").select("node", "size", "same").distinct()
    equal = sets.groupBy("same").agg(F.min("node").alias("dst"), F.count("*").alias("k")).where("k > 1").join(sets.select("same", F.col("node").alias("src")), "same")
    roots = staged(connected(close.unionByName(equal.where("src <> dst").select("src", "dst"))), "classes")
    shared = staged(shared_prefixes(marked, text, n, similarity, cells, often), "shared")
    buckets = staged(shared.groupBy("bucket").count().where(F.col("count") > WIDE).select("bucket"), "wide-buckets")
    buckets = broadcast_below(buckets, 200_000)
    wide = shared.join(buckets, "bucket")
    drawn = seen.where("node is not null").join(wide.select("node").distinct(), "node", "left_semi").select("node", "size", "sketch").dropDuplicates(["node"])
    wide = staged(wide.join(drawn, "node").select("bucket", "node", "size", F.lit(0).alias("place"), "sketch"), "wide")
    rest = staged(shared.join(buckets, "bucket", "left_anti").join(sets.select("node", "size"), "node").select("bucket", "node", "size", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("sketch")), "postings")
    drop_staged(shared, seen)
    columns = ["node", "root", "size", "place", "sketch"]
    rooted = lambda x: x.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    forest = staged(dealt(rooted(wide), columns).mapInArrow(lambda it: closest(it, similarity), "src long, dst long").distinct(), "closest")
    if forest.limit(1).count():
        more = staged(alike(forest, first, marked, text, keys, similarity, n), "linked")
        roots = joined(roots, more)
    drop_staged(forest)
    pairs = dealt(rooted(wide.unionByName(rest)), columns).mapInArrow(lambda it: prefix_pairs(it, similarity, counted=True), "src long, dst long, n long, need long")
    found = staged(pairs.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("src", "dst"), "missed")
    drop_staged(wide, rest)
    more = staged(alike(found, first, marked, text, keys, similarity, n), "more")
    drop_staged(found)
    return joined(roots, more)


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root once the links of more are added; staged if there are any."""
    if not more.limit(1).count():
        return roots
    old = roots.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    return staged(connected(old.unionByName(more)), "classes")


def closest(batches, similarity: float, rows: int = 50_000):
    """Pairs (src > dst) of nodes of different roots, a forest for each bucket: the least spanning forest of the pairs that may be
    that similar by size and sketch, by how much the sketches differ for the sizes. Columns as in prefix_pairs(), with sketches."""
    for bucket, *rest in whole_buckets(batches, rows):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            node, root, size, _, drawn = (x[a:b] for x in rest)
            if (root == root[0]).all():
                continue
            x, y = nearest(root, size.astype(np.int64), _words(drawn), similarity)
            if len(x):
                yield _pairs([node[x]], [node[y]])


def nearest(root: np.ndarray, size: np.ndarray, drawn: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of that forest, grown from node to nearest node; nodes of one root are linked before."""
    left, x, found = np.arange(len(root)), 0, []
    best, parent = np.full(len(root), np.inf), np.zeros(len(root), np.int64)
    while True:
        left = left[left != x]
        if not len(left):
            break
        total = size[left] + size[x]
        far = np.bitwise_count(drawn[left] ^ drawn[x]).sum(axis=1, dtype=np.int64) / np.maximum(1, _apart(similarity) * total + 1e-6)
        far[np.minimum(size[left], size[x]) < similarity * np.maximum(size[left], size[x]) - 1e-6] = np.inf
        far[root[left] == root[x]] = -1
        new = left[far < best[left]]
        best[new], parent[new] = far[far < best[left]], x
        x = int(left[np.argmin(best[left])])
        if 0 <= best[x] <= 1:
            found.append((x, int(parent[x])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def prefix_pairs(batches, similarity: float, rows: int = 50_000, counted: bool = False):
    """Pairs (src > dst) of nodes of different roots that share a bucket and may be that similar by size and place (columns
    bucket, node, root, size, place, and sketch if there is one; sorted by bucket): lane i is compared with lane i + s for each shift s, over all buckets
    at once. A pair is found at least in the bucket of its first common shingle.

    counted: n, in how many buckets (of block pairs) it was found here, and need, in how many it must be to be that similar:
    of its common shingles at most one prefix's remainder, the greater one, lies in no common bucket. Places are all 0 then."""
    for bucket, *rest in whole_buckets(batches, rows):
        if not len(bucket):
            continue
        _, inverse, count = np.unique(bucket, return_inverse=True, return_counts=True)
        order = np.lexsort((inverse, -count[inverse]))
        order = order[: int((count[inverse] > 1).sum())]
        group, many = inverse[order], count[inverse][order]
        node, root, size, place = (x[order] for x in rest[:4])
        drawn = _words(rest[4][order]) if len(rest) > 4 else None
        size, left = size.astype(np.int64), size.astype(np.int64) - place
        a, b, need, held = [], [], [], 0
        for s in range(1, int(many[0]) if len(many) else 0):
            m = int(np.searchsorted(-many, -s, side="left"))  # rows in buckets of more than s
            if m <= s:
                break
            i = np.flatnonzero((group[: m - s] == group[s:m]) & (root[: m - s] != root[s:m]))
            j = i + s
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            good = (low >= similarity * high - 1e-6) & (np.minimum(left[i], left[j]) >= similarity / (1 + similarity) * (low + high) - 1e-6)
            if drawn is not None and good.any():
                good[good] = np.bitwise_count(drawn[i[good]] ^ drawn[j[good]]).sum(axis=1, dtype=np.int64) <= _apart(similarity) * (low + high)[good] + 1e-6
            a.append(node[i[good]])
            b.append(node[j[good]])
            low, high = low[good], high[good]
            need.append(np.ceil(similarity / (1 + similarity) * (low + high) - 1e-6).astype(np.int64) - np.ceil(similarity * high - 1e-6).astype(np.int64) + 1)
            held += int(good.sum())
            if held > 200_000:
                yield _pairs(a, b, need if counted else None)
                a, b, need, held = [], [], [], 0
        if held:
            yield _pairs(a, b, need if counted else None)


def _pairs(a: list[np.ndarray], b: list[np.ndarray], need: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """Each pair once; with need: its count and need."""
    x, y = np.concatenate(a), np.concatenate(b)
    src, dst = np.maximum(x, y), np.minimum(x, y)
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    at = np.flatnonzero(np.concatenate(([True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))))
    columns, names = [src[at], dst[at]], ["src", "dst"]
    if need is not None:
        columns += [np.diff(np.append(at, len(src))), np.concatenate(need)[order][at]]
        names += ["n", "need"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, n: int = COPY_SHINGLE, radii: tuple[int, ...] = COPY_RADII) -> DataFrame:
    """df with one row of each class of near copies: the least id, ties by a hash of the row, equal rows once.

    Two texts are linked if the Jaccard similarity of their n-word shingles is at least `similarity`, transitively. Pairs to
    compare come from SimHash fingerprints: equal under one of several bit masks and at most the greater of radii bits apart (bit-sliced);
    each is then checked on the shingles themselves, so dissimilar texts never fall together. Masks are as many as miss at
    most MISS of the pairs at the threshold; links between the classes so found come from an exact join on shingles, so none is
    left out. Null and empty texts are one class. Rows with null
    ids count as after all others. The columns of df are returned as they are; an empty table stays empty."""
    names = []
    for k in range(3):
        names.append(fresh(df, f"row_{k}"))
    late, h1, h2 = names
    whole = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumns({h1: F.xxhash64(*whole), h2: F.xxhash64(F.lit(1), *whole)})
    ranked = marked.select("*", F.struct(F.col(f"`{id}`").isNull(), F.col(f"`{id}`")).alias(late))
    roots, first = copies(ranked, text, [late, h1, h2], similarity, n, radii)
    linked = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("of").alias("of"))
    kept = marked.join(linked.select(F.col(f"of.`{h1}`").alias(h1), F.col(f"of.`{h2}`").alias(h2)), [h1, h2], "left_semi")
    return kept.dropDuplicates([h1, h2]).select(*whole)
