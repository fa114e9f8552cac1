"""The opN_ queries: each applies its operator, with production parameters, to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, urls

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document; a null text is empty."""
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document; null and empty texts have fingerprint zero."""
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth id; vectors with nulls or non-finite components take no part."""
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, and whether a twentieth of it is hit; a null text has no words."""
    from .decontaminate import contaminated, scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


# Fixed values of the query's contract.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; outcomes are the quality labels of the same id."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of every document; the model is fitted to labels outside the held-out fold."""
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and names of the licenses found in every document, and the best coefficient (null where there is none)."""
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"), columns=["doc_id"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), names.alias("licenses"), F.round(F.array_max(F.transform("licenses", lambda x: x["dice"])), 6).alias("best_dice"))


#: Key of the query and the pipeline where the session names none. It is public: made-up tables and tests only.
TEST_KEY = b"a test key, not a secret"


def pii_key(spark: SparkSession) -> bytes:
    """The session's spark.quillon.pii.key, or the test key."""
    return spark.conf.get("spark.quillon.pii.key", "").encode() or TEST_KEY


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and spans (JSON) of every document; the key is the session's."""
    from .pii import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return found.select("doc_id", F.col("clean_text").alias("text"), F.size("pii").alias("n_found"), F.to_json("pii").alias("spans"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law of near equal bytes."""
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, log-likelihood and perplexity of every document under a model of all documents."""
    from .common import drop_staged
    from .language_model import score, train

    model = train(table(spark, sf_dir, "documents"), keep=["doc_id"])
    scored = score(model.numbers, model)
    drop_staged(model.numbers)
    return scored


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_reputation": op3_url_reputation,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_shards": op9_shards,
    "op10_language_model": op10_language_model,
}

ORACLES: dict[str, str] = {
    "op1_top_k": oracles.TOP_K,
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op6_simhash": oracles.simhash(42, 3, 3),
    "op3_url_reputation": oracles.url_reputation(URL_RULES, urls.TWO_LABEL_SUFFIXES, urls.Z, urls.THRESHOLD, urls.WEAKEST, urls.STRONGEST),
}
