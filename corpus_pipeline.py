"""A training corpus from documents: toxic documents out, one of each class of near-duplicates, contaminated ones out,
personal data replaced, texts encoded.

Every stage gets the rows that the one before it kept, written as Parquet, and all but the last return the columns of
documents. An empty table, null texts and repeated rows go through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, pii, simhash, toxicity
from quillon.llm.common import n_staged, release, staged
from quillon.llm.queries import pii_key


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted to the labels of this stage's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.remove_toxic(docs, toxicity.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each class of near copies: Jaccard similarity of five-word shingles of 0.8 or more,
    linked transitively. SimHash finds the pairs, the shingles decide."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark windows; these stay as they are."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates and addresses replaced by pseudonyms of the same length and format, by the key of the session
    (spark.quillon.pii.key; a public test key where it is unset)."""
    return pii.replace(docs, pii_key(spark))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and the ids (little-endian unsigned 32-bit)."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", encoding_stage),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows are written to the shared folder; what the stage before it has written is
    deleted then, so one copy of the corpus lies there at most, besides the one being written."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), n_staged()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
            release(spark, first, docs)
    return docs
