"""A corpus pipeline: five stages, each of them one of the text operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet, and read again as the next one's ``docs``.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm import decontamination, linededup, packing, simhash, toxicity
from gaugeworks.llm.base import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go."""
    model = toxicity.learn(spark, docs, sf_dir)
    return docs.filter(toxicity.score_of(F.col("text"), spark, model) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to many sources stay in one document; ``n_chars`` follows."""
    lines = linededup.dedup_lines(docs)
    return lines.select("doc.*").withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fingerprints and token ids are beyond SQL; a test compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
