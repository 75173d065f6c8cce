"""A training corpus from documents: language, near-duplicates, secrets, mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, language, minhash, mixing, secrets
from docmill.llm.common import discard, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    return language.recognised(docs.select(*COLUMNS))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (5 words, similarity 0.8)."""
    return minhash.without_copies(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, dealt to shards and shuffled there."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, for each row of the mix."""
    return bpe.digests(docs.select(*COLUMNS), path=bpe.default_path())


STAGES = [("language", recognise), ("near_dedup", deduplicate), ("secrets", redact), ("mixing", mix), ("bpe", tokenise)]
#: Compression, MinHash and merges are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)  # what the stage has read is not read again
        before = docs
    return docs
