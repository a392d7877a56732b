"""A corpus pipeline over ``documents``: rules, line dedup, near-dedup, secrets, packing. Each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retail_spark.llm import linededup, neardup, packing, quality, secrets
from retail_spark.llm.common import table
from retail_spark.session import discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them.

    Null and empty texts have no words and go. Repeated rows are judged alike, each for itself.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that three or more share, but for the one with the largest id.

    Null and empty texts stay as they are; a text that loses all its lines is empty and stays. Repeated rows are one document, and
    rows of a null id are one before all others.
    """
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    All texts without a word, null ones too, are copies of each other. Of rows that share an id and are of one group one stays, so
    repeated rows go. A null id is the smallest.
    """
    return neardup.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced by a mark. Null, empty and repeated rows stay, each for itself."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in token windows: which document, where from, how long, which window, where in it.

    Null and empty texts are one piece of one token. Repeated rows are packed each for itself.
    """
    return packing.packing_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Shingles, samples and byte pairs have no SQL: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again by the next; what a stage read goes once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
