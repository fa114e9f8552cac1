"""Each operator against brute force, and its defined results on nulls, empty tables, repeats and clashing names."""

import datetime
import hashlib
import hmac
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, common, decontaminate, language_model, licenses, pii, sharding, simhash, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint int, score int, items string, spans string, ids string, shard int, size int"


def frame(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "x", "y", "z", 3, 4) for i, t in rows], DOCS)


def base_words(n, seed):
    r = random.Random(seed)
    return [("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))) for _ in range(n)]


# --- SimHash ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(range(len(fps)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def test_fingerprint_long_short_and_odd_texts():
    long = " ".join(base_words(5000, 1))
    for t in ["", " \t\n", "One", "one two", "A b C d", "é ß\u00a0x y", long, long + " tail", "a\x0bb\x0cc\x1cd"]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("n", [2, 63, 64, 65, 300])
def test_bit_sliced_links_equal_brute_force(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, max(2, n // 8), dtype=np.uint64)
    near = [int(c) ^ sum({1 << int(b) for b in rng.integers(0, 64, k)}) for c in centre for k in range(6)]
    fp = np.unique(np.array(near, np.uint64))[:n]
    want = brute_components([int(x) for x in fp])
    signed = fp.view(np.int64)
    for a, b in (simhash.block_links(signed), simhash.small_links(signed, np.zeros(len(fp), np.int64))):
        root = list(range(len(fp)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            assert (int(fp[x]) ^ int(fp[y])).bit_count() <= 3
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        got = [find(x) for x in range(len(fp))]
        assert len(a) <= 2 * len(fp)  # a forest, or little more
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_radius_other_than_three():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64) & np.uint64(0x3FF))
    for radius in (0, 1, 2, 4, 5):
        live = simhash._lanes(len(fp))
        planes = simhash.planes(fp)
        for q in fp[:5]:
            hit = simhash.within(lambda p, q=q: planes[p] ^ (np.uint64(0xFFFFFFFFFFFFFFFF) if int(q) >> p & 1 else np.uint64(0)), live.shape, live, (radius,))[0]
            got = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")).tolist()
            assert got == [i for i, x in enumerate(fp) if (int(x) ^ int(q)).bit_count() <= radius]


def near_rows():
    w = base_words(400, 2)
    rows = [(10 * k, " ".join(base_words(60, k))) for k in range(20)]
    for k in range(30):
        v = w[:]
        v[k * 3] = "changed"
        rows.append((500 + k, " ".join(v)))
    return rows + [(7, ""), (9, None), (8, " \n"), (500, " ".join(w)), (3, " ".join(w)), (3, " ".join(w)), (None, "lone text here"), (None, "")]


def test_near_duplicates(spark):
    rows = near_rows()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f, least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=str) == want


def test_large_buckets_are_dealt_out_without_loss(spark):
    rng = np.random.default_rng(5)
    fp = np.unique(np.array([sum({1 << int(b) for b in rng.integers(0, 64, 2)}) for _ in range(300)], np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    keys = simhash.band_keys(F.col("fp"), df.count())
    linked = simhash.connected(simhash.links(df.select(F.col("fp").alias("node"), "fp"), keys, block=16)).collect()
    comp = brute_components([int(x) & (1 << 64) - 1 for x in fp])
    groups = {}
    for x, c in zip(fp.tolist(), comp):
        groups.setdefault(c, set()).add(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert {r.node: r.root for r in linked} == want


def brute_copies(texts, similarity=0.8, n=5):
    """Class of each text: Jaccard similarity of n-word shingles, transitively; texts without words are one class."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if find(i) != find(j) and len(x & y) >= similarity * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(sets))]


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = near_rows()
    got = simhash.deduplicate(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    comp = brute_copies([t for _, t in rows])
    kept = got.collect()
    assert len(kept) == len(set(comp))
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(min((i for (i, _), c in zip(rows, comp) if c == k and i is not None), default=None)) for k in set(comp))
    assert simhash.deduplicate(frame(spark, rows).limit(0)).count() == 0
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_copies_near_the_threshold_are_found_and_no_others(spark):
    r = random.Random(4)
    rows, line = [], " ".join(base_words(30, 10**6))
    for k in range(150):
        w = base_words(r.randint(60, 200), k)
        rows.append((10 * k, " ".join(w)))
        for c, share in enumerate((0.01, 0.02, 0.03, 0.08)):  # the last one is no copy any more
            v = w[:]
            for at in r.sample(range(len(v)), max(1, round(share * len(v)))):
                v[at] = r.choice("uvwxyz") * 3
            rows.append((10 * k + c + 1, " ".join(v)))
        rows.append((10 * k + 9, (line + "\n") * 20 + " ".join(base_words(40, 5000 + k))))  # alike in fingerprint alone
    comp = brute_copies([t for _, t in rows])
    want = {min(rows[i][0] for i, c in enumerate(comp) if c == k) for k in set(comp)}
    got = {x.doc_id for x in simhash.deduplicate(frame(spark, rows)).collect()}
    assert want <= got and len(got - want) <= 0.04 * (len(rows) - len(want))


def test_copies_that_fingerprints_tell_apart_are_linked(spark):
    """Repeats weigh in a fingerprint but not in a set; a few words of a short text at the threshold; buckets of many rows."""
    r, rows = random.Random(6), []
    for k in range(40):
        w, turn = base_words(80, 900 + k), base_words(6, 7000 + k)
        rows += [(10 * k + c, " ".join([*w, *turn * times])) for c, times in enumerate((2, 60))]
        rows += [(10 * k + 2, " ".join(v := base_words(r.randint(13, 60), 8000 + k))), (10 * k + 3, " ".join([*v[:-1], "other"])), (10 * k + 4, " ".join([*v, *base_words(len(v) // 4 - 1, 50 + k)]))]
    rows += [(1000 + k, " ".join(base_words(12, 3) + base_words(4, 100 + k))) for k in range(60)]  # alike, but no copies
    comp = brute_copies([t for _, t in rows])
    want = sorted(min(rows[i][0] for i, c in enumerate(comp) if c == k) for k in set(comp))
    assert len(want) < len(rows) - 60 and sorted(x.doc_id for x in simhash.deduplicate(frame(spark, rows)).collect()) == want


def test_prefix_pairs_over_blocks(spark):
    """Every pair that shares a bucket, however its rows are dealt out, and none inside a class."""
    rows = [(int(b), int(x), int(x) // 3 * 3, 10, 0) for b, n in ((1, 70), (2, 5), (3, 1)) for x in range(1000 * b, 1000 * b + n)]
    keyed = spark.createDataFrame(rows, "bucket long, node long, root long, size int, place int")
    pairs = simhash.dealt(keyed, ["node", "root", "size", "place"], 16).mapInArrow(lambda it: simhash.prefix_pairs(it, 0.8), "src long, dst long")
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] > y[1] and x[2] != y[2]}
    assert {tuple(x) for x in pairs.collect()} == want


def test_passages_that_many_texts_share_make_no_candidates(spark):
    """Texts that share a third of their shingles reach no exact comparison: counts in prefixes and outlines tell them apart,
    whatever the order of shingles, and similar pairs pass both."""
    shared = base_words(60, 1)
    rows = [(k, " ".join([*base_words(60, 100 + k), *shared, *base_words(60, 5000 + k)])) for k in range(120)]
    rows += [(500 + k, rows[k][1] + " more") for k in range(20)]
    df = frame(spark, rows).select("doc_id", "text")
    nodes = {int(np.uint64(simhash.node_of(t.encode())).astype(np.int64)): i for i, t in rows}
    for often in ((np.array([], np.uint64), np.array([], np.int64)), simhash.frequent(simhash.sizes(df, "text", 5).cache())):
        got = simhash.shared_prefixes(df, "text", 5, 0.8, *often).withColumns({"root": F.col("node"), "size": F.lit(len(rows[0][1].split()) - 4), "place": F.lit(0)})
        met = simhash.dealt(got, ["node", "root", "size", "place"]).mapInArrow(lambda it: simhash.prefix_pairs(it, 0.8, counted=True), "src long, dst long, n long, need long")
        met = met.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").collect()
        assert {tuple(sorted((nodes[x.src], nodes[x.dst]))) for x in met} == {(k, 500 + k) for k in range(20)}
    sets = {i: simhash.shingles(t.encode()) for i, t in rows}
    of = spark.createDataFrame([(i, bytearray(simhash.outline(s))) for i, s in sets.items()], "node long, counts binary")
    pairs = spark.createDataFrame([(x, y) for x in sets for y in sets if x > y], "src long, dst long")
    left = {tuple(x) for x in simhash.possible(pairs, of, 0.8).collect()}
    assert {(500 + k, k) for k in range(20)} <= left and len(left) < 40


def test_groups_near_the_threshold_make_few_pairs(spark, monkeypatch):
    """Texts of one pattern that are nearly similar are not compared with the square of their number, and classes
    are those of all pairs."""
    rng = np.random.default_rng(3)
    base, rows = base_words(150, 7), []
    for k in range(240):
        words = list(base)
        for at in rng.choice(150, 3 if k % 4 else 1, replace=False):
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    sets = [simhash.shingles(t.encode()) for _, t in rows]
    shared = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
    size = np.array([len(x) for x in sets])
    alike = shared >= 0.8 * (size[:, None] + size[None, :] - shared)
    root = np.arange(240)
    while (new := np.where(alike, root[None, :], 240).min(axis=1)).tolist() != root.tolist():
        root = new
    compared, exact = [], simhash.alike
    monkeypatch.setattr(simhash, "links", lambda nodes, *_: spark.createDataFrame([], "src long, dst long"))  # no mask meets
    monkeypatch.setattr(simhash, "alike", lambda found, *x: compared.append(found.count()) or exact(found, *x))
    kept = sorted(x.doc_id for x in simhash.deduplicate(frame(spark, rows)).collect())
    assert kept == sorted(set(root.tolist())) and 1 < len(kept) < 200
    assert sum(compared) < 240 * 4
    drawn = simhash._words(np.array([simhash.sketch(x) for x in sets], object))
    assert (np.bitwise_count(drawn[:, None] ^ drawn[None, :]).sum(axis=2) <= size[:, None] + size[None, :] - 2 * shared).all()


def test_masks_use_all_bits_and_grow_with_the_rows():
    few, many = simhash.tables(1000, 0.88), simhash.tables(10**9, 0.88)
    assert {m.bit_count() for m in few} == {6} and {m.bit_count() for m in many} == {26} and len(many) > len(few)
    assert np.bitwise_or.reduce([m & (1 << 32) - 1 for m in many]) == (1 << 32) - 1


# --- BPE --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coding():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def odd_texts():
    r = random.Random(4)
    out = ["", None, " ", "\n\n  a", "don't we'll I'M", "x" * 300, "ab" * 5000, "\u3000\x1c\x85 z", "1234 ²³ ५", "\U0003f84c림ë\U0001f3fa"]
    for _ in range(300):
        out.append("".join(r.choice([chr(r.randrange(32, 0x250)), chr(r.choice([9, 10, 13, 28, 31, 0x85, 0xA0, 0x2028, 0x200B, 0x3000])), chr(r.randrange(0x370, 0xD7FF)), chr(r.randrange(0x1F300, 0x1F900)), chr(r.randrange(0xE000, 0x110000)), "the ", "ing"]) for _ in range(r.randrange(60))))
    return out


def test_encoding_equals_the_library(coding):
    import tiktoken

    c = bpe.codec(*coding)
    library = tiktoken.Encoding("own", pat_str=coding[1], mergeable_ranks=c.ranks, special_tokens={})
    texts = [t or "" for t in odd_texts()]
    for t, ids in zip(texts, c.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    long = "word " * 300_000 + "é" * 1000
    assert np.frombuffer(c.encode(long), "<u4").tolist() == library.encode_ordinary(long)


def test_single_and_side_by_side_merges_agree(coding):
    c = bpe.codec(*coding)
    r = random.Random(9)
    pieces = sorted({bytes(r.choice(b"abcdeorinst \xc3\xa9") for _ in range(r.randint(2, 32))) for _ in range(400)} - set(c.ranks))
    got = bpe.merge_many(pieces, 32, c.byte_rank, c.pairs)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [bpe.merge(p, c.ranks, c.longest) for p in pieces]


def test_round_trip_frames(spark, coding):
    rows = list(enumerate(odd_texts()[:40])) + [(0, ""), (0, ""), (None, "z")]
    df = frame(spark, rows)
    made = bpe.tokenize(df, *coding)
    assert "ids_" in made.columns and made.count() == len(rows)
    back = bpe.detokenize(made, *coding, ids="ids_").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    d = {r.doc_id: r for r in bpe.digests(df, *coding, keep_ids=True).collect()}
    assert d[4].decoded_sha256 == hashlib.sha256(rows[4][1].encode()).hexdigest() and d[4].n_tokens == len(d[4].ids) // 4
    assert bpe.digests(df.limit(0), *coding).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def norm(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_scan(text, items):
    w, hit, found = norm(text), set(), set()
    for i, t in items:
        x = norm(t)
        n = min(13, len(x))
        if not x or i is None:
            continue
        grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def contaminated_case():
    items = [(k, " ".join(base_words(40, 100 + k))) for k in range(12)] + [(50, "Short Item"), (51, "one"), (52, ""), (53, None), (54, "..."), (10, " ".join(base_words(40, 110))), (None, " ".join(base_words(40, 5)))]
    w = base_words(300, 7)
    docs = [(0, " ".join(w)), (1, " ".join(w[:50] + norm(items[3][1])[5:30] + w[50:])), (2, "SHORT, item! and more short item"), (3, None), (4, ""), (5, "é" * 10), (6, items[4][1].upper() + "\n" + items[5][1]), (7, " ".join(norm(items[2][1])[:12])), (7, "one"), (8, items[0][1] + " " + " ".join(w * 40)), (None, items[1][1])]
    return docs, items


def test_scan_equals_brute_force(spark, monkeypatch):
    docs, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
        real = decontaminate.blocks
        monkeypatch.setattr(decontaminate, "blocks", lambda b, i, t, w, limit=limit, real=real: real(b, i, t, w, limit))
        got = decontaminate.scan(frame(spark, docs), bench).collect()
        monkeypatch.undo()
        assert sorted(((r.doc_id, r.text, r.n_words, r.n_hit, r["items_"]) for r in got), key=str) == sorted(((i, t, *brute_scan(t, items)) for i, t in docs), key=str)
        for r in got:
            raw = (r.text or "").encode()
            inside = sum(len(norm(raw[s.start : s.end].decode())) for s in r["spans_"])
            assert inside == r.n_hit


def test_removing_documents_and_spans(spark):
    docs, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    kept = decontaminate.remove_documents(df, bench)
    bad = [t for _, t in docs if (s := brute_scan(t, items))[1] and 20 * s[1] >= s[0]]
    assert kept.columns == df.columns and sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for _, t in docs if t not in bad)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench).collect()}
    assert cut[0] == docs[0][1] and norm(cut[1]) == norm(docs[0][1]) and cut[3] is None
    assert decontaminate.scan(df.limit(0), bench).count() == 0
    assert decontaminate.remove_documents(df, bench.limit(0)).count() == len(docs)


def test_items_without_an_id_hit(spark):
    item, known = " ".join(base_words(20, 1)), " ".join(base_words(20, 2))
    bench = spark.createDataFrame([(None, item), (None, None), (7, known)], "item_id long, text string")
    docs = frame(spark, [(1, item), (2, f"{item} {known}"), (3, " ".join(base_words(20, 3)))])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.scan(docs, bench, columns=["doc_id"]).collect()}
    assert got == {1: (20, []), 2: (40, ["7"]), 3: (0, [])}
    assert [r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()] == [3]


def test_blocks_are_bounded_by_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (50,))
    items = [(k, "\n".join(base_words(20, k))) for k in range(8)] + [(8, ".".join(base_words(170, 8))), (9, items_hot := " ".join(base_words(13, 99))), (10, items_hot)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = list(decontaminate.blocks(bench, "item_id", "text", 13))
    assert len(made) > 6 and all(len(b.words.start) <= 50 for b in made)
    docs = [(1, items[3][1]), (2, items[8][1]), (3, " ".join(base_words(170, 8)[100:130])), (4, f"{items_hot} x {items_hot}"), (5, " ".join(base_words(40, 50)))]
    got = {r.doc_id: r for r in decontaminate.scan(frame(spark, docs), bench).collect()}
    for i, t in docs:
        assert (got[i].n_words, got[i].n_hit, got[i]["items_"]) == brute_scan(t, items)


def test_words_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(decontaminate, "_CHUNK", 64)
    w = base_words(500, 3)
    a, b = decontaminate.Words([" ".join(w).encode()]), decontaminate.Words([b"  ".join(x.encode() for x in w), b"z"])
    assert (a.hash == b.hash[:500]).all() and a.joined(3, 2) == f"{w[3]} {w[4]}".encode()


# --- URL reputation ---------------------------------------------------------------------------------------------------

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow")]


def test_hosts_paths_and_rules(spark):
    cases = [
        (1, "https://A.Example.com/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7"), (2, "http://b.com/en/1", "b.com", "/en/1", "com/en/"),
        (3, "http://com/en/", "com", "/en/", "com/en/"), (4, "no scheme", "", "", None), (5, None, "", "", None), (6, "x://h?q/p", "h", "", None), (7, "://", "", "", None),
        (8, "http://notcom/en/", "notcom", "/en/", None), (9, "http://u.net/de/a#/z", "u.net", "/de/a", "net/de/"), (9, "http://u.net/de/a#/z", "u.net", "/de/a", "net/de/"),
        (None, "ftp://É.org/a", "É.org", "/a", None),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "x") for c in cases], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = urls.judge(pages, labels, RULES).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((c[0], *c[2:]) for c in cases), key=str)
    assert all(r.verdict == dict(RULES)[r.rule] for r in got if r.rule)
    assert urls.judge(pages.limit(0), labels, RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, labels.limit(0), []).collect()} <= {"allow", "block"}


def test_reputation_shrinks_towards_parents(spark):
    good, bad = [("g.site.com", 40, 39), ("bad.com", 40, 2)], [("new.site.com", 0, 0), ("one.bad.com", 1, 1), ("x.co.uk", 0, 0)]
    table = spark.createDataFrame(good + bad + [(f"h{k}.org", 10, 8) for k in range(10)], "host string, n long, k long")
    r = {x.host: x for x in urls.reputations(table).collect()}
    assert r["g.site.com"].mean > r["new.site.com"].mean > r["bad.com"].mean and r["g.site.com"].bound < r["g.site.com"].mean
    assert r["one.bad.com"].mean < 0.9 and r["g.site.com"].bound > r["new.site.com"].bound
    dom = table.select("host", *urls.levels(F.col("host"))).collect()
    assert [tuple(x)[1:] for x in dom if x.host == "x.co.uk"] == [("x.co.uk", "co.uk")]


def test_kept_pages_are_judged_by_their_own_url(spark):
    rows = [(1, "http://good.com/a"), (1, "http://bad.com/a"), (None, "http://good.com/b"), (None, "http://bad.com/b"), (1, "http://good.com/a"), (2, None)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, rule int")
    got = urls.keep(pages, spark.createDataFrame([], "doc_id long, quality int"), [("good.com/", "allow"), ("bad.com/", "block")])
    assert got.columns == pages.columns and sorted(str(r.url) for r in got.collect()) == ["http://good.com/a", "http://good.com/a", "http://good.com/b"]


# --- sharding ---------------------------------------------------------------------------------------------------------


def check_shards(rows, got, slack):
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in got)
    for s in range(8):
        have = size.get(s, [])
        assert sorted(r.slot for r in have) == list(range(len(have)))
        assert abs(sum(r.size for r in have) - total / 8) <= slack
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_shards_balance_bytes_and_keep_groups(spark):
    rows = [(k, " ".join(base_words(20 + k % 30, k))) for k in range(1200)] + [(5000 + k, "same text twice") for k in range(2)] + [(9000, None), (9001, ""), (None, "null id"), (9002, "é")]
    got = sharding.assign(frame(spark, rows)).collect()
    check_shards(rows, got, 400)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text twice")}) == 1


def test_shards_cut_hot_groups_and_repeated_rows(spark):
    rows = [(k, "copy " * 30) for k in range(500)] + [(k, " ".join(base_words(30, k))) for k in range(1000, 1600)] + [(7, "again " * 20)] * 300
    got = sharding.assign(frame(spark, rows)).collect()
    check_shards(rows, got, 800)


def test_shards_of_few_rows(spark):
    assert sharding.assign(frame(spark, []).limit(0)).count() == 0
    got = sharding.assign(frame(spark, [(1, "a"), (2, "b")])).collect()
    assert len(got) == 2 and all(r.slot == 0 or r.slot == 1 for r in got)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(k, " ".join(base_words(20, k))) for k in range(200)] + [(1, "again")] * 3 + [(None, "no id"), (None, "no id"), (None, None)]
    df = frame(spark, rows).drop("shard")
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard"}
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Found:
        path = None

        def isDefined(self):  # noqa: N802
            return self.path is not None

        def get(self):
            return self.path

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Found)}))})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context})
    for path in (None, "/tmp/checkpoints", "file:/tmp/checkpoints/x"):
        Found.path = path
        with pytest.raises(RuntimeError):
            common.shared_dir(session)
    Context.master = "local[2]"
    assert common.shared_dir(session) == common.LOCAL_SHARED
    Found.path = "hdfs://store/checkpoints/x"
    assert common.shared_dir(session) == Found.path


# --- top k ------------------------------------------------------------------------------------------------------------


def brute_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ok) if b != a and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("queries", "cell"), [(3, 2), (512, 64)])
def test_top_k_equals_brute_force(spark, queries, cell, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((700, 16)) / 4
    v[100:300] = v[99]  # a hot vector
    rows = [(int(k), [float(x) for x in np.float32(v[k])]) for k in range(700)] + [(1000, None), (1050, [None] * 16), (1100, [float("nan")] * 16), (1150, [float("inf")] * 16), (None, [0.5] * 16), (1200, [0.25] * 3), (1201, [0.5] * 3), (1250, [0.0] * 16), (50, [float(x) for x in np.float32(v[50])])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(topk, "QUERY_BLOCK", queries)
    monkeypatch.setattr(topk, "CELL", cell)
    index = topk.build(df, block=128)
    got = topk.search(df, F.col("id") % 50 == 0, index=index).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows)
    assert topk.search(df, F.col("id") % 50 == 0).count() == len(got) and index.count() > 3


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("id") % 50 == 0).count() == 0


def test_index_stops_early_and_only_on_proof():
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (2000, 24))
    v[5] = 2000  # far ahead
    index = topk.Index(np.arange(2000), v)
    again = topk.Index.unpacked(24, *index.packed())
    q = rng.integers(-200, 200, (20, 24))
    exact = v @ q.T
    least = np.sort(exact, axis=0)[-3]
    for floor in (np.full(20, -np.inf), least.astype(float)):
        rows, queries, done = again.possible(q, 3, floor)
        assert done < len(index.members) and len(rows) < 20 * 2000 / 2  # neither all postings nor all vectors were needed
        found = set(zip(rows.tolist(), queries.tolist()))
        assert {(int(i), int(j)) for i, j in zip(*np.nonzero(exact >= least))} <= found
    for r in range(index.rounds + 1):  # what is left is bounded by its length
        part = np.zeros_like(exact, float)
        for s, (at, d, impact, a) in enumerate(index.segments.tolist()):
            if at < r:
                end = index.segments[s + 1, 3] if s + 1 < len(index.segments) else len(index.members)
                part[index.members[a:end]] += q[:, d] * impact * index.step
        assert (np.abs(exact - part) <= index.left[r][:, None] * np.sqrt((q * q).sum(axis=1))).all()


# --- toxicity ---------------------------------------------------------------------------------------------------------


def toxic_rows():
    r = random.Random(3)
    rows, labels = [], []
    for k in range(500):
        w = base_words(r.randint(20, 120), k)
        bad = k % 4 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["zquirk", "zquarkle", "zquxxing"]) + r.choice(["", "s", "ed", "y"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_learns_subwords(spark):
    rows, labels = toxic_rows()
    df, lab = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, model, columns=["doc_id"]).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(got[k].h == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [(got[k].score >= 0.5) == bool(y) for k, y in labels if got[k].h]
    assert len(held) > 50 and np.mean(held) > 0.97
    extra = frame(spark, [(1, "plain words zquiirk zquarkled zquirkly here"), (2, ""), (3, None), (4, "x " * 200_000), (2, "")])
    s = toxicity.score(extra, model).collect()
    assert "score_" in s[0].asDict() and all(0 <= r["score_"] <= 1 for r in s) and s[0]["score_"] > 0.5 > s[1]["score_"] == s[2]["score_"]
    kept = toxicity.remove_toxic(extra, model)
    assert kept.columns == extra.columns and kept.count() == 4


def test_toxic_words_behind_the_start_of_a_long_run_count():
    r = random.Random(6)
    run = lambda n: "".join(r.choice("\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b") for _ in range(n))
    bad = "\u574f\u5766\u514b"
    long = run(100) + bad + run(30)
    held = toxicity.words_of(long.encode())
    seen = {g for x in held for g in toxicity.grams(x, 1 << 30)}
    marked = f"<{long}>"
    assert all(zlib.crc32(marked[i : i + n].encode()) % (1 << 30) in seen for n in (3, 4, 5) for i in range(len(marked) - n + 1))
    rows = [((run(100) + (bad if k % 2 else "") + run(30)).encode(), k % 2) for k in range(200)]
    model = toxicity.Model.__new__(toxicity.Model)
    model.__setstate__(toxicity.fit(rows).__getstate__())
    assert model.score(long.encode()) > 0.5 > model.score((run(100) + run(33)).encode())


def test_toxic_words_of_few_documents_are_trained():
    r = random.Random(9)
    rare = [f"{''.join(r.sample('bcdfghjklmnpqrstvwxz', 6))}" for _ in range(34)]
    rows = [(" ".join(base_words(30, k) + ([rare[k // 4 % 34]] * 3 if k % 4 == 0 else [])).encode(), int(k % 4 == 0)) for k in range(408)]
    model = toxicity.Model.__new__(toxicity.Model)
    model.__setstate__(toxicity.fit(rows).__getstate__())  # each rare word in three documents
    moved = sum(model._word(w.encode()) > 0 for w in rare)
    assert moved > len(rare) / 2


def test_toxicity_without_labels(spark):
    df = frame(spark, [(1, "a b")])
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 < toxicity.score(df, model, columns=["doc_id"]).first().score < 1
    assert toxicity.score(df.limit(0), model).count() == 0


# --- PII --------------------------------------------------------------------------------------------------------------


def test_permutations_have_no_fixed_points():
    for size in (2, 3, 10, 97, 1000):
        image = [pii.feistel(x, size, b"k", b"t") for x in range(size)]
        assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))


def test_formats_stay_valid():
    values = {
        "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], "ipv4": ["10.0.0.1", "192.168.100.200", "1.2.3.4"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
        "date": ["1999-12-31", "28.02.2004", "02/29/2000", "2001/01/02"], "ssn": ["123-45-6789"], "phone": ["+1 (988) 555-2485", "(212) 555-0199", "212-555-0199", "+44 20 7946 0958", "+4915112345678"], "email": ["Jo.Doe+tag@mail.example.org", "a1@b.de"],
    }
    key = b"secret"
    for kind, some in values.items():
        for v in some:
            new, found = pii.pseudonymise(f"see {v} now", key)
            assert [k for k, _, _ in found] == [kind] and len(new) == len(v) + 8 and v not in new
            again = new[4:-4]
            assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", again)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", v))
            assert [k for k, _, _ in pii.pseudonymise(f"see {again} now", key)[1]] == [kind]  # still valid
            assert pii.pseudonymise(f"{v}, {v}", key)[0] == f"{again}, {again}"  # linked
            assert pii.pseudonymise(f"see {v} now", b"other")[0] != new


def plain_permutation(size, key, tweak):
    """The permutation as a table: the network written out forwards only."""
    left = 1
    while (left + 1) ** 2 <= size:
        left += 1
    right = (size + left - 1) // left

    def f(r, half):
        return int(hmac.new(key, tweak + b"|" + f"{size}|{r}|{half}".encode(), "sha256").hexdigest()[:32], 16)

    table = []
    for x in range(size):
        while True:
            a, b = x // right, x % right
            for r in range(0, 10, 2):
                a = (a + f(r, b)) % left
                b = (b + f(r + 1, a)) % right
            x = a * right + b
            if x < size:
                break
        table.append(x)
    back = {y: x for x, y in enumerate(table)}
    step = 1 + f(255, 0) % (size - 1)
    return [back[(y + step) % size] for y in table]


def test_permutation_equals_the_one_written_out():
    for size in (2, 5, 64, 1000):
        assert [pii.feistel(x, size, b"k", b"t") for x in range(size)] == plain_permutation(size, b"k", b"t")


def test_days_and_addresses_have_one_pseudonym_in_all_notations():
    first = datetime.date(1900, 1, 1)
    image = plain_permutation((datetime.date(2099, 12, 31) - first).days + 1, b"key", b"date")
    for day in (datetime.date(2024, 1, 5), datetime.date(1999, 12, 31), datetime.date(2000, 2, 29)):
        new = first + datetime.timedelta(image[(day - first).days])
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%Y.%m.%d"):
            assert pii.pseudonymise(f"on {day.strftime(form)}.", b"key")[0] == f"on {new.strftime(form)}."
    one, two, three = (pii.pseudonymise(x, b"key")[0] for x in ("Bob.Li@Mail.Example.org", "bob.li@mail.example.org", "rob.li@mail.example.org"))
    assert one.lower() == two and one != two and two != three and one[0].isupper() and one.endswith(".Example.org")


def test_texts_full_of_values_take_linear_time():
    took = []
    for n in (4000, 16000):
        text = " ".join(f"user{k}@example{k % 7}.org" for k in range(n))
        pii.pseudonymise(text, b"k")  # fills the cache
        began = time.perf_counter()
        new, found = pii.pseudonymise(text, b"k")
        took.append(time.perf_counter() - began)
        assert len(found) == n and len(new) == len(text)
    assert took[1] < 12 * took[0]


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.scan(frame(spark, [(1, "x")]), b"")


def test_what_is_not_valid_stays():
    for t in ["4111111111111112", "999.1.1.1", "2001-02-30", "000-12-3456", "token0641917ea4e9", "version 1.2.3.4.5", "GB00WEST12345698765432", "", "a@b", "12-34"]:
        assert pii.pseudonymise(t, b"k") == (t, [])


def test_neighbouring_values_are_all_found():
    parts = ["4451718024887799", "27.65.93.188", "+1 (269) 555-3296", "27.65.93.189", "4111 1111 1111 1111", "1999-12-31", "a.b@c.example.org", "DE89 3704 0044 0532 0130 00", "123-45-6789", "212-555-0199", "10.0.0.1"]
    for sep in (" ", ", ", "\n"):
        text = sep.join(parts)
        new, found = pii.pseudonymise(text, b"k")
        assert [k for k, _, _ in found] == ["card", "ipv4", "phone", "ipv4", "card", "date", "email", "iban", "ssn", "phone", "ipv4"]
        assert [text[a:b] for _, a, b in found] == parts and not any(p in new for p in parts)


def test_numbers_behind_failed_and_shortened_matches():
    cases = {
        "12 212 555 0134": ["212 555 0134"], "555 234 5678 555 987 6543": ["555 234 5678", "555 987 6543"], "2001 555 234 5678 and 99 99 212-555-0199": ["555 234 5678", "212-555-0199"],
        "1234 4111 1111 1111 1111": ["4111 1111 1111 1111"], "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32": ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"],
        "+33 1 23 45 67 89": ["+33 1 23 45 67 89"], "+49 30 12345678": ["+49 30 12345678"], "+49 170 1234567": ["+49 170 1234567"], "+44 (0) 20 7946 0958": ["+44 (0) 20 7946 0958"],
        "+33 1 23 45 67 89 555 987 6543 555 987 6543": ["+33 1 23 45 67 89", "555 987 6543", "555 987 6543"], "+49 30 12345678 +49 170 1234567": ["+49 30 12345678", "+49 170 1234567"],
        "+1 2 3": [], "1 2 3 4 5 6 7 8 9 0 1 2": [],
    }
    for text, want in cases.items():
        new, found = pii.pseudonymise(f"call {text}, please", b"k")
        assert [f"call {text}, please"[a:b] for _, a, b in found] == want and len(new) == len(text) + 13
        assert not any(w in new for w in want)


def test_pii_frames(spark):
    df = frame(spark, [(1, "call +1 (988) 555-2485"), (2, None), (3, ""), (1, "call +1 (988) 555-2485"), (4, "x" * 300_000 + " 10.0.0.1")])
    got = pii.scan(df, b"k").collect()
    assert got[0].clean_text == got[3].clean_text != got[0].text and got[1].clean_text is None and got[2].clean_text == ""
    assert got[4].pii[0].kind == "ipv4" and got[4].pii[0].start == 300_001
    out = pii.replace(df, b"k")
    assert out.columns == df.columns and out.first().text == got[0].clean_text and pii.scan(df.limit(0), b"k").count() == 0


# --- licenses ---------------------------------------------------------------------------------------------------------


def test_license_lines_in_long_texts(spark):
    long = " ".join(base_words(3000, 1))
    rows = [(1, f"{long}\nReleased under the MIT License.\n{long}"), (2, "this work is licensed under the gnu general public license version 2"), (3, "Licensed under the Apache License, Version 2.0."), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "the license of the driver"), (7, long)]
    got = {r.doc_id: [(x.license, x.dice) for x in r.licenses] for r in licenses.scan(frame(spark, rows)).collect()}
    assert [k for k, _ in got[1]] == ["MIT"] and [k for k, _ in got[2]] == ["GPL-2.0"] and [k for k, _ in got[3]] == ["Apache-2.0"] and [k for k, _ in got[4]] == ["CC-BY-NC-4.0"]
    assert got[5] == got[6] == got[7] == []
    assert licenses.scan(frame(spark, rows), templates=[]).where(F.size("licenses") > 0).count() == 0


def test_dice_and_pruning_equal_brute_force():
    r = random.Random(8)
    some = [(f"L{k}", " ".join(base_words(r.randint(3, 40), k))) for k in range(30)]
    t = licenses.Templates(some, 0.8)
    for _ in range(300):
        name, text = r.choice(some)
        w = text.split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "other"
        x = licenses.bigrams(" ".join(w))
        dice = [2 * sum((x & g).values()) / (sum(x.values()) + n) for g, n in zip(t.grams, t.sizes)]
        best = t.best(" ".join(w))
        assert (best[1] == pytest.approx(max(dice)) if max(dice) >= 0.8 else best is None)


def test_licenses_inside_prose_whole_texts_and_versions():
    t = licenses.Templates(licenses.TEMPLATES + licenses.whole_texts(), licenses.THRESHOLD)
    whole = dict(licenses.whole_texts())
    prose = " ".join(base_words(300, 5))
    names = lambda text: [x[0] for x in t.scan(text)]
    text = f"{prose} Released under the MIT License, {prose}"
    (name, dice, a, b), = t.scan(text)
    assert (name, dice, text[a:b]) == ("MIT", 1.0, "Released under the MIT License")
    wrapped = " ".join(whole["MIT"].split()).replace(" ", "\n")
    for x in (whole["MIT"], wrapped, f"{prose}\nCopyright (c) 2020 A. Person\n\n{whole['MIT']}\n{prose}", whole["MIT"].replace("\n\n", f"\n\n{' '.join(base_words(8, 2))}\n")):
        assert names(x) == ["MIT"]
    for name, x in whole.items():
        assert names(f"{prose}\n{x}\n{prose}") == [name]
    header = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version %s of the License, or\n(at your option) any later version."
    for v in "123":
        assert names(prose + " " + header % v + " " + prose) == [f"GPL-{v}.0"]
    assert names(header % "9") == []
    assert names("Licensed under CC BY-NC-ND 4.0, as is Creative Commons Attribution 3.0") == ["CC-BY-NC-ND-4.0"]
    assert names("Licensed under the Apache License, Version 1.1.") == [] and names(prose) == []
    first = whole["BSD-2-Clause"].split("\n\n")[0]
    assert names(first) == ["BSD-2-Clause OR BSD-3-Clause"]  # what both share doesn't tell them apart
    assert names("\u0130 " + whole["ISC"]) == ["ISC"] and names(f"{whole['MIT']}\n{whole['BSD-3-Clause']}") == ["MIT", "BSD-3-Clause"]


def test_license_windows_equal_brute_force():
    r = random.Random(4)
    some = [(f"L{k}", " ".join(r.choice("abcdef") for _ in range(r.randint(2, 9)))) for k in range(6)]
    for one in some:
        t = licenses.Templates([one], 0.8)
        for _ in range(40):
            w = [r.choice("abcdefgh") for _ in range(25)]
            dice = []
            for i in range(25):
                for j in range(i + 2, 26):
                    x = licenses.bigrams(" ".join(w[i:j]))
                    dice.append((2 * sum((x & t.grams[0]).values()) / (j - i - 1 + t.sizes[0]), i, j))
            found = t.scan(" ".join(w))
            assert bool(found) == (max(dice)[0] >= 0.8)
            for _, d, a, b in found:
                assert (pytest.approx(d), a // 2, (b + 1) // 2) in [(x, i, j) for x, i, j in dice]


# --- language model ---------------------------------------------------------------------------------------------------


def plain_log_prob(net, around, target):
    """One token's log-probability, each sum written out."""
    s = [math.tanh(sum(float(net.embed[k][x][j]) for k, x in enumerate(around)) + float(net.bias[j])) for j in range(language_model.HIDDEN)] + [1.0]

    def share(table, at):
        z = [sum(a * float(b) for a, b in zip(s, table[:, k])) for k in range(table.shape[1])]
        return z[at] - math.log(sum(math.exp(x) for x in z))

    c = int(net.class_of[target])
    return share(net.to_class, c) + share(net.to_word[c], int(net.place[target]))


def test_scores_equal_the_sums_written_out(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARED", language_model.WORDS + 40)  # some counts with the network, some joined
    r = random.Random(3)
    often = [f"w{k}" for k in range(language_model.WORDS)]
    rows = [(k, " ".join([*r.sample(often, 30), f"rare{k % 90}x{k % 5}", "", f"rare{k % 7}", "! Only" + str(k)])) for k in range(300)] + [(400, " ".join(often * 3)), (401, None), (402, " "), (0, "w1")]
    df = frame(spark, rows)
    model = language_model.train(df)
    counts = Counter(w for _, t in rows for w in language_model.tokens((t or "").encode()))
    v, net = model.vocabulary, model.network
    assert {language_model.word_key(w): n for w, n in counts.items()} == {x.key: x.n for x in model.words.collect()}
    alone = {w for w in counts if language_model.word_key(w) in v.output}
    assert len(alone) == language_model.WORDS and min(counts[w] for w in alone) >= max(n for w, n in counts.items() if w not in alone)
    got = {x.doc_id: x for x in language_model.score(df, model, columns=["doc_id", "score"]).where("doc_id > 0").collect()}
    assert len(got) == len(rows) - 2
    for i, t in rows[1:60] + rows[301:303]:
        words = language_model.tokens((t or "").encode())
        out = [v.output.get(language_model.word_key(w), language_model.WORDS + language_model.bucket_of(w)) for w in words]
        padded = [language_model.OUTPUTS] * 2 + out + [language_model.OUTPUTS] * 2
        want, unseen = 0.0, 0
        for k, w in enumerate(words):
            want += plain_log_prob(net, [padded[k], padded[k + 1], padded[k + 3], padded[k + 4]], out[k])
            if w not in alone:
                same = [x for x in counts if x not in alone and language_model.bucket_of(x) == language_model.bucket_of(w)]
                other = counts[w] - words.count(w)
                unseen += other == 0
                want += math.log((other + 0.5) / (sum(counts[x] for x in same) + 0.5 * (len(same) + 1)))
        x = got[i]
        assert (x.n_tokens, x.n_unseen) == (len(words), unseen) and abs(x.log_likelihood - want) < 1e-3 * max(1, len(words))
        assert x.perplexity is None if not words else abs(math.log(x.perplexity) + want / len(words)) < 1e-3


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, language_model.OUTPUTS, (2000, 5))
    net = language_model.fit(windows, np.bincount(windows[:, 2], minlength=language_model.OUTPUTS), epochs=1)
    around = np.full(language_model.OUTPUTS, 7)
    total = np.exp(net._chunk([around] * 4, np.arange(language_model.OUTPUTS))).sum()
    assert abs(total - 1) < 1e-3 and np.bincount(net.class_of).tolist() == [language_model.SIZE] * language_model.CLASSES


def test_both_sides_are_read():
    """Of 'a x b', 'c y d', 'a y d' and 'c x b' only the right side tells x from y; then only the left one."""
    edge = language_model.OUTPUTS
    for right in (True, False):
        rows = [(0, 4, 1), (2, 5, 3), (0, 5, 3), (2, 4, 1)] if right else [(1, 4, 0), (3, 5, 2), (3, 5, 0), (1, 4, 2)]
        windows = np.array([(edge, a, x, b, edge) for a, x, b in rows] * 500)
        net = language_model.fit(windows, np.bincount(windows[:, 2], minlength=language_model.OUTPUTS))
        for a, x, b in rows:
            p = np.exp(net.log_prob(np.array([edge, edge, a, x, b, edge, edge]))[1])
            assert p > 0.8


def test_every_window_is_fitted(spark, monkeypatch):
    """Words that the few windows to begin with don't hold are learnt from the whole corpus; neighbours are counted whole."""
    rows = [(k, " ".join(f"left{c} mid{c} right{c} ." for c in [(7 * k + j) % 40 for j in range(20)])) for k in range(400)] + [(900, None), (901, " ")]
    df = frame(spark, rows)
    monkeypatch.setattr(language_model, "FULL_BATCH", 32)
    models = [language_model.train(df, windows=20), language_model.train(df)]
    few, whole = [language_model.score(df, m, inside=False).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first() for m in models]
    assert few[1] == whole[1] == 32000 and few[0] / few[1] > -2.5 and whole[0] / whole[1] > -2.5, (few, whole)  # by counts alone about -4.3
    v = models[0].vocabulary
    seen = language_model.all_neighbours(language_model.coded(df, "text", v))
    out = [[v.look(w)[0] for w in language_model.tokens((t or "").encode())] for _, t in rows]
    want = Counter((x[i + d], side + x[i]) for x in out for i in range(len(x)) for d, side in ((1, 0), (-1, language_model.NEAR)) if 0 <= i + d < len(x))
    assert {(int(a), int(b)): int(seen[a, b]) for a, b in np.argwhere(seen)} == want


def test_fit_sends_the_driver_networks_alone(spark, monkeypatch):
    """No windows and no counts of neighbours, and one network for all tasks."""
    df = frame(spark, [(k, " ".join(f"left{c} mid{c} right{c} ." for c in [(7 * k + j) % 40 for j in range(20)])) for k in range(400)]).repartition(4)
    kind, sent = type(df), []

    def watched(get):
        def run(self, *args, **more):
            got = list(get(self, *args, **more))
            sent.extend(len(x) for r in got for x in r if isinstance(x, (bytes, bytearray)))
            return got

        return run

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(kind, name, watched(getattr(kind, name)))
    model = language_model.train(df, windows=20)
    net = model.network
    size = sum(x.nbytes for x in (net.embed, net.bias, net.to_class, net.to_word))
    assert size < max(sent) and sum(sent) < 3.2 * size and len(sent) < 8, sent  # the begun network with its sums, the last one


def test_texts_are_told_into_words_once(spark, tmp_path):
    """The corpus's numbers do for fit and scores: they give what the texts give, and the files are read no more."""
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 60) ** 2) for _ in range(80)), k % 2 == 0) for k in range(200)] + [(900, None, None), (901, " ", True), (3, "a aa", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens boolean").repartition(3).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    model = language_model.train(df, windows=50, keep=["n_tokens", "doc_id"])
    for inside in (True, False):
        want = [tuple(x) for x in language_model.score(df, model, columns=["n_tokens", "doc_id"], inside=inside).collect()]
        got = [tuple(x) for x in language_model.score(model.numbers, model, inside=inside).collect()]
        assert len(got) == 203 and sum(x[2] for x in got) == sum(len(language_model.tokens((x[1] or "").encode())) for x in rows)
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    (tmp_path / "docs").rename(tmp_path / "gone")
    ids = language_model.score(model.numbers, model, columns=["doc_id"])
    assert ids.columns[:2] == ["doc_id", "n_tokens"] and sorted(x.doc_id for x in ids.collect()) == sorted(x[0] for x in rows)
    common.drop_staged(model.numbers)


def test_numbers_keep_every_word():
    for n in (70_000, 5, 0):
        xs = [" ".join(f"w{k % 69_000}" for k in range(n)).encode(), b"", b"A b ! a", b" "]
        told = language_model.Numbers.unpacked(*language_model.Numbers.of(xs).packed())
        words = [language_model.tokens(x) for x in xs]
        assert told.sizes.tolist() == [len(x) for x in words]
        assert told.keys[told.ids].tolist() == [language_model.word_key(w) for x in words for w in x]
        assert told.buckets[told.ids].tolist() == [language_model.bucket_of(w) for x in words for w in x]
        padded = told.padded(told.keys, -1, told.places())
        assert padded.tolist() == [-1, -1, *[k for x in words for k in [*map(language_model.word_key, x), -1, -1]]]


def test_a_step_moves_by_the_whole_gradient():
    """Against gradients of the mean cost by differences, for rows of frequent and of rare inputs."""
    rng = np.random.default_rng(2)
    target = rng.integers(0, 200, 300)
    around = [np.where(rng.random(300) < 0.5, 3, rng.integers(0, language_model.OUTPUTS + 1, 300)) for _ in range(4)]
    made = language_model.begin(np.zeros((0, 5), np.int64), np.bincount(target, minlength=language_model.OUTPUTS))
    net = made.network
    for x in made.weights():
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.1

    def cost():
        return -net._chunk(around, target).mean()

    places = [(0, (0, 3, 5)), (0, (2, 3, 0)), (0, (1, int(around[1][around[1] != 3][0]), 7)), (1, (4,)), (2, (6, 9)), (2, (32, 1)), (3, (int(net.class_of[target[0]]), 2, int(net.place[target[0]]))), (3, (int(net.class_of[3]), 32, 4))]
    want = []
    for k, at in places:
        x, old = made.weights()[k], made.weights()[k][at]
        x[at] = old + 0.02
        up = cost()
        x[at] = old - 0.02
        want.append((up - cost()) / 0.04)
        x[at] = old
    before = [x.copy() for x in made.sums]
    made.step(around, target)
    assert [float(made.sums[k][at] - before[k][at]) ** 0.5 for k, at in places] == pytest.approx(np.abs(want), abs=1e-3, rel=0.05)
    x, rows = rng.integers(0, 90, 4000).astype(np.uint16) ** 2, rng.standard_normal((4000, 4)).astype(np.float32)
    x[:1200] = 7
    own, total = language_model._added(x, rows)
    plain = np.zeros((8000, 4))
    np.add.at(plain, x, rows)
    assert own.tolist() == sorted(set(x.tolist())) and np.abs(total - plain[own]).max() < 1e-3


def test_scores_prefer_text_like_the_corpus(spark):
    phrase = "the quick brown fox jumps over the lazy dog and runs away . "
    df = frame(spark, [(k, phrase * 5) for k in range(60)] + [(100, None), (101, " ")])
    model = language_model.train(df)
    probe = frame(spark, [(1, phrase * 3), (2, " ".join(random.Random(1).sample((phrase * 3).split(), 39))), (3, "zzz qqq xxx yyy"), (4, None), (5, ""), (1, phrase * 3)])
    got = language_model.score(probe, model, inside=False).collect()
    s = {r.doc_id: r for r in got}
    assert s[1].perplexity < s[2].perplexity < s[3].perplexity and len({r.log_likelihood for r in got if r.doc_id == 1}) == 1 and len(got) == 6
    assert s[4].n_tokens == 0 and s[4].perplexity is None and s[5].log_likelihood == 0 and s[3].n_unseen == 4
    empty = language_model.train(df.limit(0))
    assert language_model.score(probe, empty).count() == 6 and language_model.score(df.limit(0), model).count() == 0


def test_texts_that_occur_twice_score_apart(spark):
    rows = [(k, " ".join(base_words(60, k // 2 if k < 40 else k))) for k in range(140)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in language_model.score(df, language_model.train(df)).collect()}
    twice, once = ([got[k] for k in ks] for ks in (range(40), range(40, 140)))
    assert max(r.n_unseen for r in twice) < min(r.n_unseen for r in once)
    assert np.median([r.perplexity for r in twice]) < np.median([r.perplexity for r in once])
