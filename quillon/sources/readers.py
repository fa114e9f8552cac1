"""Sources and sinks: dispatch by config, panel caches, maps, libraries, JSONL corpora, entity stores and append-only logs.

All paths go through Spark's readers and writers, so any store that the cluster knows will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dsl
from ..operators.nested import fingerprint
from . import panels

# The columns of an enriched price panel.
PANEL_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume", "vwap", "amount", "return", "forward_return"]
FUNDAMENTALS = ["roe", "roe_dt", "netprofit_yoy", "dt_netprofit_yoy", "grossprofit_margin", "debt_to_assets", "ocfps", "eps"]
PASSAGE = "source_id string, passage_id string, title string, tradition string, summary string, caution string, keywords array<string>, provenance map<string,string>"
PASSAGE_REQUIRED = ["source_id", "passage_id", "title", "summary", "keywords"]
FORBIDDEN_FIELDS = ["full_text", "raw_text", "content"]


def config(text: str) -> dict:
    """A "key: value" document of the plain kind of YAML: nested by indentation, lists by "- ", scalars as JSON or plain text,
    # begins a comment."""
    rows = []
    for raw in text.splitlines():
        line = raw.split(" #", 1)[0].rstrip()
        if line.strip() and not line.lstrip().startswith("#"):
            rows.append((len(line) - len(line.lstrip()), line.strip()))

    def scalar(x: str):
        x = x.strip()
        if x in ("", "~"):
            return None
        try:
            return json.loads(x)
        except ValueError:
            return {"yes": True, "no": False, "True": True, "False": False}.get(x, x.strip("'\""))

    def block(at: int, depth: int):
        out: dict | list | None = None
        while at < len(rows) and rows[at][0] >= depth:
            own, line = rows[at]
            if own > depth:
                raise ValueError(f"indented without a key: {line}")
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                out.append(scalar(line[1:]))
                at += 1
                continue
            key, _, value = line.partition(":")
            out = {} if out is None else out
            at += 1
            if value.strip() or at >= len(rows) or rows[at][0] < own or (rows[at][0] == own and not rows[at][1].startswith("-")):
                out[key.strip()] = scalar(value)
            else:
                out[key.strip()], at = block(at, rows[at][0])
        return out, at

    return (block(0, rows[0][0])[0] or {}) if rows else {}


def load(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """Train and test folds of the source that cfg names: synthetic, parquet (a cached panel) or bars (single values)."""
    kind, day = cfg.get("data_source", "synthetic"), cfg.get("split_date", "2020-04-01")
    if kind == "synthetic":
        panel = panels.synthetic(spark, int(cfg.get("symbols", 20)), int(cfg.get("days", 100)), cfg.get("start", "2020-01-01"), int(cfg.get("seed", 0)))
    elif kind == "parquet":
        panel = cached(spark, cfg["path"], PANEL_COLUMNS)
        if panel is None:
            raise ValueError(f"{cfg['path']} lacks columns of the panel")
    elif kind == "bars":
        panel = panels.user_day(spark, cfg["path"])
    else:
        raise ValueError(f"unknown data_source {kind}")
    return panels.split(panel, day)


def cached(spark: SparkSession, path: str, required: list[str]) -> DataFrame | None:
    """The Parquet table at path if it has every required column, else None: the caller makes it anew."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return found if set(required) <= set(found.columns) else None


def write_cache(panel: DataFrame, path: str, by: str = "symbol", files: int = 64) -> None:
    """Clustered by key and sorted inside files, so that min/max statistics prune reads. Not a folder a key: there may be
    millions of keys."""
    panel.repartitionByRange(files, by).sortWithinPartitions(by, "date").write.mode("overwrite").parquet(path)


def enrich(prices: DataFrame, fundamentals: DataFrame, flows: DataFrame) -> DataFrame:
    """Prices with the latest announcement at or before each day, carried on, and the day's flows (left)."""
    from ..operators.shapes import asof

    columns = [c for c in fundamentals.columns if c not in ("symbol", "ann_date")]
    out = asof(prices, fundamentals, ["symbol"], "date", "ann_date", columns)
    from pyspark.sql.window import Window

    seen = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})
    return out.join(flows, ["symbol", "date"], "left")


def forward_returns(panel: DataFrame, k: int, price: str = "close") -> DataFrame:
    from pyspark.sql.window import Window

    return panel.withColumn("forward_return", F.lead(price, k).over(Window.partitionBy("symbol").orderBy("date")) / F.nullif(F.col(price), F.lit(0.0)) - 1)


def sector_map(spark: SparkSession, path: str | None, symbols: DataFrame, sectors: list[str] | None = None) -> DataFrame:
    """symbol, sector, market_cap of every symbol: from CSV, unknown sector and the median cap where missing; without a path
    a reproducible map by hash."""
    if path is None:
        names = sectors or ["bank", "tech", "health", "energy", "consumer"]
        pick = F.get(F.array(*[F.lit(s) for s in names]), F.pmod(F.xxhash64("symbol"), F.lit(len(names))).cast("int"))
        return symbols.select("symbol", pick.alias("sector"), F.pow(10.0, 9 + F.pmod(F.xxhash64("symbol", F.lit(1)), F.lit(3000)) / 1000).alias("market_cap"))
    m = spark.read.schema("symbol string, sector string, market_cap double").csv(path, header=True)
    mapped = symbols.select("symbol").join(m, "symbol", "left")
    mid = mapped.agg(F.percentile("market_cap", F.lit(0.5)).alias("_mid"))  # one row
    return mapped.crossJoin(F.broadcast(mid)).select("symbol", F.coalesce("sector", F.lit("unknown")).alias("sector"), F.coalesce("market_cap", "_mid").alias("market_cap"))


def universe(panel: DataFrame, top: int | None = None, keywords: list[str] | None = None) -> DataFrame:
    """The panel of the `top` symbols of greatest market_cap (ties by symbol), or of those whose sector matches one of the
    patterns."""
    if keywords is not None:
        return panel.where(F.coalesce("sector", F.lit("")).rlike("|".join(keywords)))
    largest = panel.groupBy("symbol").agg(F.max("market_cap").alias("c")).orderBy(F.col("c").desc_nulls_last(), "symbol").limit(top or 0)
    return panel.join(F.broadcast(largest.select("symbol")), "symbol", "left_semi")  # at most `top` symbols


def formula_library(spark: SparkSession, path: str, least: int = 0) -> tuple[list[str], list[tuple[str, str]]]:
    """Formulas of a CSV with a column expression, and those that can't be read, with the reason. A library is small: it is
    read by the driver. Fewer than `least` formulas that can be read raise (a portfolio needs two)."""
    rows = [r.expression for r in spark.read.csv(path, header=True, quote='"').select("expression").collect()]
    good, bad = [], []
    for text in rows:
        try:
            dsl.parse(text or "")
            good.append(text)
        except dsl.FormulaError as e:
            bad.append((text, str(e)))
    if len(good) < least:
        raise ValueError(f"{path} has {len(good)} formulas that can be read, of {least} needed")
    return good, bad


def passages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Passages of a JSONL corpus, and rejected lines with file, number and reason. Blank lines are skipped but count, a BOM
    is cut off. A file is one task's, as its lines are numbered: a corpus is many files."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    lines = text.select(F.regexp_replace(F.trim("value"), "^﻿", "").alias("line"), "file", (F.col("pos") + 1).alias("number")).where("line <> ''")
    rows = lines.select("line", "file", "number", F.from_json("line", PASSAGE).alias("p"))
    checks = [F.when(F.col("p").isNull() | ~F.coalesce(F.get_json_object("line", "$").startswith("{"), F.lit(False)), "not JSON"), *[F.when(F.col(f"p.{c}").isNull(), f"missing {c}") for c in PASSAGE_REQUIRED], *[F.when(F.get_json_object("line", f"$.{c}").isNotNull(), f"forbidden {c}") for c in FORBIDDEN_FIELDS]]
    rows = rows.withColumn("reason", F.coalesce(*checks))
    good = rows.where("reason is null").select("p.*").withColumn("provenance", F.coalesce("provenance", F.map_from_arrays(F.array(F.lit("status")), F.array(F.lit("unstated")))))
    return good, rows.where("reason is not null").select("file", "number", "line", "reason")


def ingest(manifest: DataFrame, path: str) -> DataFrame:
    """Manifest rows as passages with lower-cased keywords and a content hash, written as JSONL and returned. A manifest with a
    field for whole texts, or with a row that lacks a required one, is refused before anything is written."""
    if held := [c for c in manifest.columns if c.lower() in FORBIDDEN_FIELDS]:
        raise ValueError(f"forbidden fields: {', '.join(held)}")
    if lacking := [c for c in PASSAGE_REQUIRED if c not in manifest.columns]:
        raise ValueError(f"missing fields: {', '.join(lacking)}")
    empty = manifest.where(" or ".join(f"{c} is null" for c in PASSAGE_REQUIRED)).limit(1).collect()
    if empty:
        raise ValueError(f"a row lacks a required field: {empty[0].asDict()}")
    out = manifest.withColumn("keywords", F.transform("keywords", lambda k: F.lower(k))).withColumn("sha256", fingerprint(["source_id", "passage_id", "title", "summary"]))
    out.write.mode("overwrite").json(path)
    return manifest.sparkSession.read.schema(out.schema).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows appended so far; an empty frame before the first."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def save_version(doc: dict, root: str, kind: str, name: str, spark: SparkSession) -> int:
    """doc as the next version of an entity: one JSON document under root/kind/name/vN. Returns N, from 1."""
    now = versions(spark, root, kind, name)
    n = (now[-1] if now else 0) + 1
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/{kind}/{name}/v{n}")
    return n


def versions(spark: SparkSession, root: str, kind: str, name: str) -> list[int]:
    """Versions of an entity, ascending; the number counts, not its spelling."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit())


def load_version(spark: SparkSession, root: str, kind: str, name: str, version: int | None = None) -> dict:
    """An entity's document, by default the greatest version."""
    have = versions(spark, root, kind, name)
    wanted = have[-1] if version is None and have else version
    if wanted not in have:
        raise KeyError(f"{kind}/{name} has no version {version}")
    return json.loads(spark.read.text(f"{root}/{kind}/{name}/v{wanted}", wholetext=True).first().value)


def write_history(history: list[dict], path: str, spark: SparkSession) -> None:
    """A search's generations (a few records) as JSON lines in one file."""
    spark.createDataFrame([(json.dumps(h, sort_keys=True),) for h in history], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A table as CSV (with header) or JSON lines."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else w.json(path)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A short report table of the first rows: for leaderboards, not for data."""
    rows = df.limit(limit).collect()
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]])
