"""The corpus pipeline: quality rules, near-dedup, secrets, mixing, encoding. Each stage reads what the last one wrote.

An empty table gives an empty one; further columns are kept by all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, perplexity, secrets, sentencepieces, simhash
from tessera.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; a null language is one of its own, and
    repeated rows stay or go alike."""
    return perplexity.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id; of repeated rows one stays, null ids come last."""
    return simhash.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; null and empty texts stay as they are."""
    return secrets.masked_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target takes it; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of pieces of each document's whole text; a null text has null ids."""
    return sentencepieces.encode_documents(docs, "doc_id", "source", "lang")


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("secret_scans", secret_scan), ("source_mixing", mix), ("sentencepieces", encode)]

#: SQL can't express the trained perplexity model. Each stage's operator is tested against a brute-force version of its own,
#: the stages one after another by what each has to keep, change and drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = materialize(docs, name)
    return docs
