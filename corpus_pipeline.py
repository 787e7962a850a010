"""A packed training corpus from the documents table: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from marketgrid.llm import decontam, neardup, packing, quality, secrets
from marketgrid.llm.common import stored, table
from marketgrid.llm.queries import ADDED, TOKENIZER
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id, or one without an id where no other has one."""
    return neardup.drop_near_duplicates(docs, unnamed=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontam.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also encoded ones, are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training window."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), added=packing.added_tokens(public_tokenizers.path(ADDED)))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("hide_secrets", hide_secrets), ("pack", pack)]

ORACLE_SQL = None  # packing has no SQL form; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
