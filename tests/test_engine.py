"""Sources, search, registry, shapes and streams."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import dsl, registry
from quillon.operators import nested, shapes, store, texts
from quillon.plans import search
from quillon.sources import panels, readers
from quillon.streaming import panel_stream

SF = "/root/testdata/sf0.001"


def test_synthetic_panels_are_reproducible(spark):
    a, b = panels.synthetic(spark, 5, 30, seed=3), panels.synthetic(spark, 5, 30, seed=3).repartition(7)
    assert a.count() == 150 and a.exceptAll(b).count() == 0 and panels.synthetic(spark, 5, 30, seed=4).exceptAll(a).count() > 0
    assert a.where("dayofweek(date) in (1, 7) or high < low or close <= 0").count() == 0


def test_load_by_config(spark, tmp_path):
    cfg = readers.config("data_source: synthetic # a comment\nsymbols: 4\ndays: 20\nsplit_date: '2020-01-10'\nempty:\n")
    assert cfg["symbols"] == 4 and cfg["empty"] is None and cfg["split_date"] == "2020-01-10"
    train, test = readers.load(spark, cfg)
    assert train.count() + test.count() == 4 * 20 + 4
    path = str(tmp_path / "cache")
    assert readers.cached(spark, path, ["symbol"]) is None
    readers.write_cache(panels.synthetic(spark, 4, 20), path, files=2)
    assert readers.cached(spark, path, ["no_such"]) is None
    assert readers.load(spark, {"data_source": "parquet", "path": path, "split_date": "2020-01-10"})[0].count() > 0
    assert readers.load(spark, {"data_source": "bars", "path": SF, "split_date": "2024-01-15"})[1].count() > 0
    with pytest.raises(ValueError, match="unknown"):
        readers.load(spark, {"data_source": "?"})


def test_sector_maps(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("symbol,sector,market_cap\na,bank,1e12\nb,,5e11\n")
    symbols = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    got = {r.symbol: (r.sector, r.market_cap) for r in readers.sector_map(spark, str(path), symbols).collect()}
    assert got == {"a": ("bank", 1e12), "b": ("unknown", 5e11), "c": ("unknown", 7.5e11)}
    made = readers.sector_map(spark, None, symbols)
    assert made.collect() == readers.sector_map(spark, None, symbols.repartition(3)).orderBy("symbol").collect() or made.count() == 3


def test_enriched_prices(spark):
    d = datetime.date
    prices = spark.createDataFrame([("a", d(2024, 1, k), float(k)) for k in (1, 2, 3, 4)], "symbol string, date date, close double")
    fund = spark.createDataFrame([("a", d(2024, 1, 2), 0.1, None), ("a", d(2024, 1, 4), None, 2.0), ("b", d(2024, 1, 1), 9.0, 9.0)], "symbol string, ann_date date, roe double, eps double")
    flow = spark.createDataFrame([("a", d(2024, 1, 3), 7.0)], "symbol string, date date, net double")
    got = readers.enrich(prices, fund, flow).orderBy("date").collect()
    assert [(r.roe, r.eps, r.net) for r in got] == [(None, None, None), (0.1, None, None), (0.1, None, 7.0), (0.1, 2.0, None)]
    f = readers.forward_returns(prices, 2).orderBy("date").collect()
    assert [r.forward_return for r in f] == [2.0, 1.0, None, None]


def test_formula_libraries_and_reports(spark, tmp_path):
    path = tmp_path / "lib.csv"
    path.write_text('"expression"\n"cs_rank(ts_mean(return,5))"\n"bad("\n')
    good, bad = readers.formula_library(spark, str(path))
    assert good == ["cs_rank(ts_mean(return,5))"] and bad[0][0] == "bad("
    df = spark.createDataFrame([(1, 0.5)], "rank int, ic double")
    readers.write_report(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().rank == "1" and "| 1 | 0.5000 |" in readers.markdown(df)


def test_passages_and_logs(spark, tmp_path):
    ok = {"source_id": "s", "passage_id": "1", "title": "t", "summary": "x", "keywords": ["A"]}
    path = tmp_path / "c.jsonl"
    path.write_text("﻿" + json.dumps(ok) + "\n\n{not json\n" + json.dumps({**ok, "full_text": "no"}) + "\n" + json.dumps({"source_id": "s"}) + "\n", encoding="utf-8")
    good, bad = readers.passages(spark, str(path))
    assert good.count() == 1 and good.first().provenance == {"status": "unstated"}
    assert sorted(r.reason for r in bad.collect())[0] == "forbidden full_text" and bad.count() == 3 and bad.first().file.endswith("c.jsonl")
    again = readers.ingest(good, str(tmp_path / "out"))
    assert again.first().keywords == ["a"] and len(again.first().sha256) == 64
    log = str(tmp_path / "log")
    assert readers.log(spark, log, "a int").count() == 0
    for k in (1, 2):
        readers.append(spark.createDataFrame([(k,)], "a int"), log)
    assert readers.log(spark, log, "a int").count() == 2


def test_store_versions(spark):
    s = spark.createDataFrame([("x", 1, "one"), ("x", 10, "ten"), ("x", 2, "two"), ("y", 1, None)], "name string, version int, doc string")
    assert {r.name: (r.version, r.doc) for r in store.latest(s, ["name"]).collect()} == {"x": (10, "ten"), "y": (1, None)}
    back = store.rollback(s, ["name"], 2).collect()
    assert [(r.name, r.version, r.doc, r.rolled_back_from) for r in back] == [("x", 11, "two", 10)]


def test_search_is_seeded_and_valid(spark):
    rng = random.Random(1)
    for _ in range(200):
        n = search.valid(rng)
        m = search.mutate(search.cross(n, search.valid(rng), rng), rng)
        assert dsl.parse(str(m)) == m and not dsl.problems(m)
    train, test = panels.split(panels.synthetic(spark, 8, 60, seed=1), "2020-02-14")
    train, test = train.cache(), test.cache()
    s = search.Search(train, size=4, seed=2)
    history = s.run(2)
    assert len(history) == 2 and history[1]["best_score"] >= history[0]["best_score"] - 1e-9
    assert search.Search(train, size=4, seed=2).population == search.Search(train, size=4, seed=2).population
    board = s.leaderboard(test, 3).collect()
    assert [r["rank"] for r in board] == [1, 2, 3] and board[0].train_score >= board[1].train_score
    tuned = search.tune_constants(dsl.parse("div(close, add(volume, 3.0))"), train, tries=3)
    assert tuned.op == "div"
    reasons = dict(search.clean(["cs_rank(close)", "nope(1)", "sub(close, close)", "add(missing, close)", "ts_corr(close, 1.0, 5)"], train))
    assert reasons["cs_rank(close)"] is None and reasons["sub(close, close)"] == "degenerate" and reasons["add(missing, close)"] == "no column missing"
    assert reasons["nope(1)"] and reasons["ts_corr(close, 1.0, 5)"]


def test_registry(spark):
    registry.python_metric("length_gap", lambda a, b: 1.0 if len(a or "") == len(b or "") else 0.0)
    df = spark.createDataFrame([("ab", "ab"), ("ab", "xy"), (None, "x")], "r string, e string")
    got = registry.scored(df, {"exact_match": 1.0, "length_gap": 1.0}, "r", "e", 0.7).collect()
    assert [r.score for r in got] == [1.0, 0.5, 0.0] and [r.passed for r in got] == [True, False, False]
    registry.transform("only_ab")(lambda d: d.where("r = 'ab'"))
    assert registry.pipeline(df, ["only_ab"]).count() == 2 and registry.resolve("math:sqrt")(4) == 2
    with pytest.raises(KeyError):
        registry.resolve("missing")


def test_asof_with_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 2, 2), ("b", 5, 3), ("a", None, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, None, 1), ("a", 3, "x", 2), ("a", None, "z", 3)], "k string, u int, v string, w int")
    got = {r.id: (r.v, r.w) for r in shapes.asof(left, right, ["k"], "t", "u", ["v", "w"]).collect()}
    assert got == {1: (None, 1), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_pareto_front_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, float(r.randint(0, 9)), float(r.randint(0, 9)), None if i % 9 == 0 else float(r.randint(0, 9))) for i in range(300)]
    got = {x.i for x in shapes.pareto_front(spark.createDataFrame(rows, "i int, a double, b double, c double").repartition(5), ["a", "b", "c"]).collect()}
    v = {i: (a, b, c or 0.0) for i, a, b, c in rows}
    want = {i for i in v if not any(all(p >= q for p, q in zip(v[j], v[i])) and v[j] != v[i] for j in v)}
    assert got == want


def test_chain_restarts_after_legacy_rows(spark):
    import hashlib

    h = lambda p, x: hashlib.sha256(f"{p}|{x}".encode()).hexdigest()
    a = h("", "1")
    rows = [("k", 1, "1", "", a), ("k", 2, "2", a, h(a, "2")), ("k", 3, "old", None, None), ("k", 4, "4", "", h("", "4")), ("k", 5, "5", "wrong", h("wrong", "5"))]
    df = spark.createDataFrame(rows, "k string, n int, p string, previous string, own string")
    assert [r.ok for r in nested.chain(df, ["k"], "n", F.col("p"), "previous", "own").orderBy("n").collect()] == [True, True, True, True, False]


def test_text_measures(spark):
    md = "intro\n- no\n## a\n- one\ntext\n## b\n- two\n-x\n## c\n- two\n"
    df = spark.createDataFrame([(md, "中文ab", "A b a"), (None, None, None), ("", "", "")], "m string, c string, w string")
    got = df.select(texts.tail_bullets(F.col("m"), 2).alias("b"), texts.cjk_count(F.col("c")).alias("n"), texts.overlap_ratio(F.col("w"), F.lit("a z")).alias("o"), texts.safety_score(F.lit("Guaranteed"), F.lit(True)).alias("s")).collect()
    assert got[0].b == ["- two", "- two"] and got[0].n == 2 and got[0].o == 0.5 and got[1].b == [] and got[1].o == 0.0 and got[0].s == 0.0


def test_stream_of_bars(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.repartitionByRange(4, "ts").write.parquet(src)
    q = panel_stream.write(panel_stream.daily(panel_stream.read(spark, src), "40 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    bars = panel_stream.daily(spark.read.schema(panel_stream.EVENTS).parquet(src))
    assert bars.count() == panels.user_day(spark, SF).count()
