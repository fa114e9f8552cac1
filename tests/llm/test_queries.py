"""The opN_ queries: against their SQL, and against the contract written out plainly where SQL can't say it."""

import hashlib
import json
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import queries, toxicity

from ..compare import rows
from .test_operators import base_words, brute_components, brute_copies, brute_fingerprint, brute_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())


def documents(duck):
    return duck.execute("select doc_id, text from documents order by 1").fetchall()


def test_op4_against_the_library(spark, duck):
    import public_tokenizers as P
    import tiktoken

    from quillon.llm.bpe import load_ranks

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path(queries.TOKENIZER)), special_tokens={})
    got = {r.doc_id: r for r in queries.op4_byte_bpe(spark, SF).collect()}
    for i, t in documents(duck):
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_op5_on_the_held_out_fold(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.01")
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())
    assert len(held) > 50 and np.mean([r.predicted == r.toxic for r in held]) > 0.93


def plain_toxicity(model, text):
    """The score written out: a word's weight is the mean over its distinct 3- to 5-grams and itself, marked at its ends; a
    text's logit the bias and the mean over its words, repeated ones weighing the root of their number, and 20 empty ones."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"(?:[a-z0-9']|[^\x00-\x7f])+", low)
    total, size = 0.0, 20.0
    for w in sorted(set(words)):
        assert len(w) <= 64
        marked = f"<{w}>"
        grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
        own = sum(model.weight.get(zlib.crc32(g.encode()) % model.buckets, 0.0) for g in grams) / len(grams)
        times = words.count(w) ** 0.5
        total, size = total + own * times, size + times
    return 1 / (1 + np.exp(-(model.bias + total / size)))


def test_op5_by_plain_sums(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    some = [(i, t or "") for i, t in documents(duck) if not re.search(r"(?:[A-Za-z0-9']|[^\x00-\x7f]){65}", t or "")]
    assert len(some) > 150 and len(got) == len(documents(duck))
    for i, t in some:
        assert abs(got[i].score - plain_toxicity(model, t)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5)


def test_op6_by_brute_force(spark, duck):
    docs = documents(duck)
    fps = [brute_fingerprint(t) for _, t in docs]
    comp = brute_components(fps)
    want = sorted((i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, comp))
    assert sorted(tuple(r) for r in queries.op6_simhash(spark, SF).collect()) == want


def test_op7_op10_cover_all_documents(spark, duck):
    docs = dict(documents(duck))
    found = {r.doc_id: r for r in queries.op7_licenses(spark, SF).collect()}
    assert set(found) == set(docs) and all(("License" in (docs[i] or "")) or not r.n_licenses or "CC" in r.licenses for i, r in found.items())
    scored = queries.op10_language_model(spark, SF).collect()
    assert len(scored) == len(docs) and all(r.n_tokens >= 0 and r.log_likelihood <= 0 for r in scored)


def test_op8_by_plain_rules(spark, duck):
    """Plain patterns and checks find what must be replaced; equal values stay equal, different ones different."""
    docs = dict(documents(duck))
    got = {r.doc_id: r for r in queries.op8_pii(spark, SF).collect()}
    assert set(got) == set(docs)
    image, n_plain = {}, 0
    for i, t in docs.items():
        new, spans = got[i].text, json.loads(got[i].spans)
        assert got[i].n_found == len(spans) and (new is None) == (t is None)
        at = 0
        for s in spans:
            a, b = s["start"], s["end"]
            assert new[at:a] == t[at:a] and a >= at
            old, fresh = t[a:b], new[a:b]
            assert old != fresh and [c.isdigit() for c in old] == [c.isdigit() for c in fresh] if s["kind"] != "email" else old.lower() != fresh.lower()
            assert image.setdefault((s["kind"], old), fresh) == fresh
            at = b
        assert (new or "")[at:] == (t or "")[at:]
        inside = lambda m: any(s["start"] <= m.start() and m.end() <= s["end"] for s in spans)
        for m in re.finditer(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w.])", t or ""):
            if all(str(int(x)) == x and int(x) < 256 for x in m.groups()) and 0 < int(m[1]) < 224:
                n_plain += 1
                assert inside(m)
        for m in re.finditer(r"(?<![\w.+-])\d{16}(?![\w-])", t or ""):
            doubled = [int(c) if k % 2 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(m[0])]
            if sum(doubled) % 10 == 0 and len(set(m[0])) > 1:
                n_plain += 1
                assert inside(m)
        for m in re.finditer(r"(?<!\S)[a-z]+[.][a-z]+\d*@[a-z]+[.][a-z]{2,3}(?!\S)", t or ""):
            n_plain += 1
            assert inside(m)
    by_kind = {}
    for (kind, old), fresh in image.items():
        by_kind.setdefault((kind, len(old)), []).append((old, fresh))
    for some in by_kind.values():
        assert len({f for _, f in some}) == len({o for o, _ in some})
    assert n_plain > 0


def test_op9_obeys_its_law(spark, duck):
    got = queries.op9_shards(spark, SF).collect()
    docs = dict(documents(duck))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    total = sum(r.size for r in got)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r.size for r in own) - total / 8) < 0.1 * total / 8 + max(r.size for r in got)


def test_pipeline_stage_by_stage(spark, tmp_path):
    r = random.Random(1)
    items = [(k, " ".join(base_words(40, 900 + k))) for k in range(5)]
    docs, labels = [], []
    for k in range(240):
        w = base_words(r.randint(40, 120), k)
        if k % 4 == 0:
            for _ in range(5):
                w[r.randrange(len(w))] = r.choice(["zquirk", "zquarkle"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0), 1))
    docs += [(300, docs[1][1]), (301, items[2][1] + " end"), (302, docs[2][1] + " 10.1.2.3 +1 (988) 555-2485"), (303, None), (304, ""), (302, docs[2][1] + " 10.1.2.3 +1 (988) 555-2485"), (305, " ".join(base_words(900, 77) + items[1][1].split()))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, kept_id int"
    spark.createDataFrame([(i, t, "en", "s", 0, 1, 1) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, text = now.columns, dict(docs)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, before, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = [x.asDict() for x in now.collect()]
        if name != "bpe":
            assert now.columns == columns
        ids = [x["doc_id"] for x in steps[name]]
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            assert sorted(ids) == sorted(x.doc_id for x in toxicity.score(before, model).collect() if x["score_"] < 0.5)
            assert not [i for i in ids if i < 240 and i % 4 == 0] and len([i for i in ids if i < 240]) >= 178
        elif name == "simhash":
            prior = [(x["doc_id"], x["text"]) for x in steps["toxicity"]]
            comp = brute_copies([t for _, t in prior])
            least = {c: min(i for (i, _), k in zip(prior, comp) if k == c) for c in comp}
            assert sorted(ids) == sorted(least.values())
        elif name == "decontamination":
            keep = [x for x in steps["simhash"] if not ((s := brute_scan(x["text"], items))[1] and 20 * s[1] >= s[0])]
            assert sorted(map(str, steps[name])) == sorted(map(str, keep)) and 301 not in ids and 305 in ids
        elif name == "pii":
            assert sorted(ids) == sorted(x["doc_id"] for x in steps["decontamination"])
            assert not any("10.1.2.3" in (x["text"] or "") or "555-2485" in (x["text"] or "") for x in steps[name])
        else:
            clean = {x["doc_id"]: x["text"] for x in steps["pii"]}
            assert all(x["decoded_sha256"] == hashlib.sha256((clean[x["doc_id"]] or "").encode()).hexdigest() for x in steps[name])
    assert text and now.where(F.col("n_tokens") * 4 != F.length("ids")).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x.doc_id for x in whole.collect()) == sorted(x["doc_id"] for x in steps["bpe"])


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
