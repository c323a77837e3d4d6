"""The corpus pipeline: stages in order, each written and read again before the next.

All stages but the last return the columns of documents; n_chars follows the text. Rows without doc_id pass the filtering stages as they are and are not packed by id order but
like any other row; rows that repeat a doc_id are judged each by its own text, and stay or go together if that is the same, too. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_dedup, ngram_join, packing, pii, toxicity
from textloom.llm.common import table, written


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below one half."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line equals or nearly equals."""
    return _sized(line_dedup.dedup(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near duplicates."""
    gone = ngram_join.copies(docs)
    return docs.join(gone, (docs["doc_id"] == gone["doc"]) & (F.xxhash64(docs["text"]) == gone["th"]), "left_anti")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _sized(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: No SQL can express a fitted grammar, the field's spans or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
