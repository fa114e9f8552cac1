"""Operators whose cases the driver's tables don't hold: mixed signs, suppressed patterns, large constants, odd JSON."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import dsl
from quillon.operators import calibration, cross, nested, quality, shapes, store, texts
from quillon.plans import audits, portfolio, relational, search
from quillon.plans.base import ORACLES
from quillon.sources import panels, readers


def test_weights_of_mixed_signs(spark):
    t = spark.createDataFrame([("a", 0.3, 1.0, 2.0), ("b", -0.2, 0.5, 1.0), ("c", 0.05, -0.4, 4.0)], "factor string, ic double, sharpe double, vol double")
    got = lambda how: {r.factor: round(r.weight, 4) for r in quality.combination_weights(t, how).collect()}
    assert got("ic") == {"a": 0.5455, "b": -0.3636, "c": 0.0909} and got("equal") == {"a": 0.3333, "b": 0.3333, "c": 0.3333}
    assert got("sharpe") == {"a": 0.5263, "b": -0.2632, "c": -0.2105}
    assert got("risk_parity") == {"a": 0.2857, "b": -0.5714, "c": 0.1429}
    even = spark.createDataFrame([("a", 0.2), ("b", -0.2)], "factor string, ic double")
    assert {r.weight for r in quality.combination_weights(even, "ic").collect()} == {0.5}


def brute_triggers(runs, cooldown):
    since, seen, out = 0, set(), []
    for failed, pattern, kept in runs:
        since += 1
        start = bool(failed) and since >= cooldown and pattern not in seen
        if start:
            since = 0
            if kept:
                seen.add(pattern)
        out.append(start)
    return out


@pytest.mark.parametrize("cooldown", [1, 2, 5])
def test_triggers_forget_suppressed_runs(spark, cooldown):
    r = random.Random(cooldown)
    runs = [[(r.random() < 0.7, r.choice("ABC"), r.random() < 0.8) for _ in range(40)] for _ in range(5)] + [[(True, x, True) for x in "ABBBB"], [(None, "A", True), (True, "A", None)]]
    rows = [(k, i, f, p, c) for k, some in enumerate(runs) for i, (f, p, c) in enumerate(some)]
    df = spark.createDataFrame(rows, "k int, i int, f boolean, p string, c boolean")
    got = store.triggers(df, ["k"], "i", F.col("f"), F.col("p"), cooldown, F.col("c")).orderBy("k", "i").collect()
    assert [x.trigger for x in got] == [t for some in runs for t in brute_triggers(some, cooldown)]
    abb = [x.trigger for x in got if x.k == 5]
    assert abb == {1: [True, True, False, False, False], 2: [False, True, False, False, False], 5: [False, False, False, False, True]}[cooldown]


def test_large_constants_are_degenerate(spark):
    for value, days in ((99999.9, 50), (1234567.891, 10), (0.1, 1)):
        p = spark.range(5000).select(F.col("id").cast("string").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % days).cast("int")).alias("date"), F.lit(value).alias("x"))
        for sample in (False, True):
            r = quality.degenerate(p, "x", sample=sample).first()
            assert r.degenerate and r.spread == 0
    some = p.withColumn("x", F.when(F.col("symbol").cast("int") % 4 > 0, F.col("symbol").cast("double")))
    assert not quality.degenerate(some, "x").first().degenerate and quality.degenerate(some, "x", 0.2, 0.5, sample=True).first().degenerate
    assert quality.degenerate(p.where("false"), "x").first().degenerate


def test_canonical_json_equals_the_module(spark):
    rows = [(1, 'a "quoted" \\ line\n\ttab', True), (2, "Grüße, 人 😀  ", False), (3, None, None), (4, "", True)]
    df = spark.createDataFrame(rows, "id long, text string, flag boolean").select("*", *[nested.content_hash({c: F.col(c) for c in ("text", "id", "flag")}, spaced, ascii_only).alias(f"h{spaced:d}{ascii_only:d}") for spaced in (False, True) for ascii_only in (False, True)])
    for r in df.collect():
        for spaced in (0, 1):
            for ascii_only in (0, 1):
                text = json.dumps({"id": r.id, "text": r.text, "flag": r.flag}, sort_keys=True, ensure_ascii=bool(ascii_only), separators=(", ", ": ") if spaced else (",", ":"))
                assert r[f"h{spaced}{ascii_only}"] == hashlib.sha256(text.encode()).hexdigest()


def test_hashed_texts_end_where_the_class_ends(spark, tmp_path):
    """A line break as the 40th character isn't printable ASCII, so the SQL leaves such a text out."""
    rows = [(1, "en", "a" * 39 + "\nmore"), (2, "en", "a" * 40 + "\n"), (3, "de", "short\n"), (4, "de", "b" * 39 + "\u2028"), (5, "fr", None), (6, None, ""), (7, "en", "c" * 39 + "\r\n")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in audits.canonical_hash(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert [r[0] for r in got] == [2, 5, 6] and got == sorted(con.execute(ORACLES["nested_canonical_hash"]).fetchall())


def test_whole_texts_of_any_characters_are_hashed(spark, tmp_path):
    """Texts that differ after their 40th character, or in characters past ASCII, have hashes of their own, those of the json module."""
    texts = ["a" * 50 + "b", "a" * 50 + "c", "Grüße\n" * 9, "人 😀\u2028\x7f\x80", "".join(map(chr, range(32))) + '"/\\', "\\u000B \\\\\x0b\x0b\x1f\\", None, "", " ", "\U0010ffff\ue000"]
    rows = [(k, (None, "en", "é\"")[k % 3], x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in audits.canonical_hash(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    form = lambda o, a, c, s: hashlib.sha256(json.dumps(o, sort_keys=True, ensure_ascii=a, separators=(c, s)).encode()).hexdigest()
    objects = [(k, {"doc_id": k, "lang": lang, "text": x or None}) for k, lang, x in rows]
    want = [(k, form(o, True, ",", ":"), form(o, True, ", ", ": "), form(o, False, ",", ":")) for k, o in objects]
    assert got == want and sorted(con.execute(ORACLES["nested_canonical_hash"]).fetchall()) == want


def test_extremes_that_tie_are_the_least_key(spark, tmp_path):
    nan = float("nan")
    rows = [(1, "a", 5.0), (2, "a", 9.0), (3, "a", 9.0), (4, "a", -1.0), (5, "a", 1.0), (None, "a", 99.0), (None, "a", 0.0), (6, "b", None), (7, "c", -0.0), (8, "c", 0.0), (9, "d", nan), (10, "d", nan), (11, "d", 3.0), (12, None, 2.0), (13, None, 2.0)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_mktsegment: (r.richest, r.nearest_zero) for r in relational.extremes(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = {a: (b, c) for a, b, c in con.execute(ORACLES["rank_extremes"]).fetchall()}
    assert got == want == {"a": (2, 4), "b": (None, None), "c": (7, 7), "d": (9, 11), None: (12, 12)}


def test_chains_are_verified_to_the_end(spark):
    rows = [(k, i, f"p{i}") for k in range(3) for i in range(50)] + [(9, 0, None)]
    linked = nested.link(spark.createDataFrame(rows, "log int, i int, payload string"), ["log"], "i", "payload")
    ok = lambda df: {(r.log, r.i) for r in nested.chain(df, ["log"], "i", F.col("payload"), "previous", "hash").where("not ok").collect()}
    assert linked.count() == len(rows) and not ok(linked.where("log < 9"))
    assert ok(linked.withColumn("payload", F.when((F.col("log") == 1) & (F.col("i") == 37), "x").otherwise(F.col("payload"))).where("log < 9")) == {(1, 37)}
    assert ok(linked.where("log < 9 and not (log = 2 and i = 20)")) == {(2, 21)}


def test_acceptance_and_one_sided_scores(spark):
    one = lambda s, f=True, r=True: spark.createDataFrame([(s, f, r)], "average_score double, passed_floors boolean, passed_regression boolean")
    none = one(0.0).limit(0)
    assert calibration.acceptance(one(0.5), one(0.6), none).first().accepted
    r = calibration.acceptance(one(0.5), one(0.5, False, False), one(0.4, False)).first()
    assert not r.accepted and r.reasons.count(";") == 4 and "0.400 below baseline 0.500" in r.reasons
    x = calibration.one_sided(spark.createDataFrame([(True, True, False), (False, True, True), (None, True, True)], "is_event boolean, hit boolean, strict boolean")).collect()
    assert [(r.exact_match, r.strict_exact_match, r.false_positive, r.strict_false_positive) for r in x] == [(True, False, None, None), (None, None, True, True), (None, None, None, None)]


def test_places_over_all_rows(spark):
    rows = [(k, float(k % 17) if k % 5 else None) for k in range(2000)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(5)
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))}
    for pieces in (3, 64):
        assert {r.id: r.rank for r in shapes.ranked(df, F.col("x"), [F.col("id")], pieces=pieces).collect()} == want
    assert shapes.ranked(df.limit(0), F.col("x"), [F.col("id")]).count() == 0


def test_pieces_give_what_one_order_gives(spark):
    rows = [(f"s{k}", f"2024-01-0{1 + k % 3}", float(k % 11) if k % 4 else 5.0, None if k % 3 == 2 else float((k * 7919) % 1009)) for k in range(3000)] + [("z", None, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "symbol string, date string, a double, b double").withColumn("date", F.col("date").cast("date"))
    items = {"ra": ("cs_rank", "a"), "rb": ("cs_rank", "b"), "wa": ("winsorize", "a"), "wb": ("winsorize", "b", 0.1, 0.8), "ba": ("bucket", "a", 4), "bb": ("bucket", "b", 7)}
    one, other = ({r.symbol: [None if v is None else round(float(v), 9) for v in (r.ra, r.rb, r.wa, r.wb, r.ba, r.bb)] for r in cross.with_columns(p, items, wide=w).where("date is not null").collect()} for w in (False, True))
    assert one == other and len(one) == 3000
    assert cross.with_columns(p, items, wide=True).count() == 3001


def test_neutralising_by_what_is_there(spark):
    p = panels.synthetic(spark, 12, 6).withColumn("sector", F.substring("symbol", 6, 1))
    got = cross.neutralise(p, "close", "v", sector="sector", cap="market_cap")
    assert set(got.columns) == {*p.columns, "v"} and abs(got.groupBy("date", "sector").agg(F.avg("v").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-9
    with pytest.raises(ValueError):
        cross.neutralise(p, "close", "v", cap="market_cap", strict=True)


def test_portfolios_breed_and_rank(spark):
    train, test = panels.split(panels.synthetic(spark, 20, 30, seed=3), "2020-01-22")
    library = ["neg(close)", "volume", "sub(high, low)", "cs_rank(open)"]
    search = portfolio.PortfolioSearch(train, test, library, size=4, n_factors=3, max_generations=2, seed=1)
    assert all(abs(sum(p.weights) - 1) < 1e-6 and len(p.formulas) == 3 for p in search.population.values())
    history = search.run()
    assert len(history) == 2 and len(search.population) == 4 and history[1]["best_test_sharpe"] >= history[0]["best_test_sharpe"] - 1e-9
    board = search.leaderboard(3).collect()
    assert [r["rank"] for r in board] == [1, 2, 3] and board[0].test_sharpe >= board[1].test_sharpe >= board[2].test_sharpe
    assert all(r.n_factors == len(r.weights) == r.expressions.count("|") + 1 for r in board)
    p = portfolio.Portfolio(tuple(library), (0.4, 0.3, 0.2, 0.1))
    for _ in range(40):
        p = search.bred(p)
        assert len(p.formulas) == len(p.weights) >= 2 and min(p.weights) >= 0 and set(p.formulas) <= set(library)
    with pytest.raises(ValueError):
        portfolio.PortfolioSearch(train, test, library[:1])


def test_retrieval_is_the_same_both_ways(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    q = spark.createDataFrame([(k, " ".join(rng.sample(words, 5))) for k in range(12)] + [(99, None), (98, "nowhere")], "q int, t string")
    rows = [(rng.choice(["a", "b", None]), f"p{k}", rng.sample(words, rng.randint(0, 12))) for k in range(300)] + [("a", "none", None), ("a", None, words), ("b", "twice", ["w1", "w1", "w2"])]
    p = spark.createDataFrame(rows, "s string, p string, k array<string>").repartition(5)
    for k in (1, 3):
        one, other = (sorted(map(str, texts.retrieve(q, p.where("p is not null"), "q", "t", "s", "p", "k", k, most_terms=n).collect())) for n in (0, 1000))
        assert one == other and len(one) > 12 * k
    assert texts.retrieve(q, p.limit(0), "q", "t", "s", "p", "k").count() == 0


def test_edits_of_formulas():
    rng = random.Random(5)
    node = dsl.parse("add(cs_rank(ts_mean(close, 5)), mul(volume, 2.0))")
    for kind in search.EDITS:
        made = {str(search.edit(node, rng, kind=kind)) for _ in range(30)}
        assert len(made - {str(node)}) > 0 and all(not dsl.problems(dsl.parse(x)) for x in made)
        if kind == "window":
            assert all(x.startswith("add(cs_rank(ts_mean(close, ") for x in made)
        if kind == "lag":
            assert all(x.startswith("ts_shift(add(") or x == str(node) for x in made)
    moved = search.perturb_constant(node, rng)
    assert 1.8 <= next(n.value for n in moved.walk() if n.op == "const") <= 2.2 and search.perturb_constant(dsl.parse("close"), rng) == dsl.parse("close")


def test_cleaning_with_a_validation_fold(spark):
    p = panels.synthetic(spark, 15, 40, seed=2)
    a, b, c = panels.three_way(p, "2020-01-20", "2020-02-10")
    loose = {"train_ic": 0.0, "test_ic": 0.0, "test_sharpe": -1e9, "val_sharpe": -1e9, "turnover": 1e9}
    got = {r.name: r for r in portfolio.clean_library({"x": "close", "y": "ts_corr(close, 1.0, 5)", "z": "(", "n": "volume"}, {"train": a, "val": b, "test": c}, loose).collect()}
    assert got["y"].reason == "constant_correlation" and got["z"].reason == "parse_error"
    for k in ("x", "n"):
        same = (got[k].train_ic > 0) - (got[k].train_ic < 0) == (got[k].val_ic > 0) - (got[k].val_ic < 0)
        assert got[k].reason == (None if same else "below_threshold")


def test_configs_stores_and_corpora(spark, tmp_path):
    text = "# a comment\nname: run 1\nseed: 7\nnested:\n  deep:\n    on: true\n    rate: 0.5\n  list:\n    - 1\n    - two # words\nempty:\nlast: 'x'\n"
    assert readers.config(text) == {"name": "run 1", "seed": 7, "nested": {"deep": {"on": True, "rate": 0.5}, "list": [1, "two"]}, "empty": None, "last": "x"}
    root = str(tmp_path / "store")
    assert [readers.save_version({"v": k}, root, "agent", "a", spark) for k in range(11)] == list(range(1, 12))
    assert readers.load_version(spark, root, "agent", "a") == {"v": 10} and readers.load_version(spark, root, "agent", "a", 2) == {"v": 1}
    with pytest.raises(KeyError):
        readers.load_version(spark, root, "agent", "b")
    good = {"source_id": "s", "passage_id": "p", "title": "t", "summary": "u", "keywords": ["K"]}
    (tmp_path / "c.jsonl").write_text("﻿" + json.dumps(good) + "\n\n" + "nonsense\n" + json.dumps(good | {"full_text": "x"}) + "\n")
    passages, rejected = readers.passages(spark, str(tmp_path / "c.jsonl"))
    assert passages.count() == 1 and sorted((r.number, r.reason) for r in rejected.collect()) == [(3, "not JSON"), (4, "forbidden full_text")]
    manifest = spark.createDataFrame([("s", "p", "t", "u", ["K"], None)], "source_id string, passage_id string, title string, summary string, keywords array<string>, full_text string")
    with pytest.raises(ValueError):
        readers.ingest(manifest, str(tmp_path / "out"))
    assert readers.ingest(manifest.drop("full_text"), str(tmp_path / "out")).first().keywords == ["k"]
    (tmp_path / "lib.csv").write_text('expression\n"neg(close)"\n"broken("\n')
    with pytest.raises(ValueError):
        readers.formula_library(spark, str(tmp_path / "lib.csv"), 2)
    assert readers.formula_library(spark, str(tmp_path / "lib.csv"))[0] == ["neg(close)"]
