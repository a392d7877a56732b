"""Validated appends: product views, reviews, contact messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retail_spark.functions import semantics as sem
from retail_spark.operators.maintenance import valid_contacts, valid_reviews
from retail_spark.sources.tables import split_corrupt


def _whole_number(column: str) -> Column:
    number = sem.js_trim(column).try_cast("double")  # 5.0 and 1e3 are whole numbers too
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def valid_views(requests: DataFrame, products: DataFrame) -> DataFrame:
    """View requests with a number as product id, of products that exist. Works on streams and tables."""
    numeric = requests.filter(sem.is_number_text("product_id")).withColumn("product_id", _whole_number("product_id"))
    return numeric.join(products.select("product_id"), "product_id", "left_semi").select(*requests.columns)


def split_views(requests: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The view requests that ``valid_views`` takes, and the others as they came, with a reason. For tables and micro-batches."""
    known = products.select(F.col("product_id").alias("_known")).withColumn("_exists", F.lit(True))
    marked = requests.withColumn("_id", F.when(sem.is_number_text("product_id"), _whole_number("product_id"))).join(
        known, F.col("_id") == F.col("_known"), "left"
    )
    good = marked.filter(F.col("_exists")).withColumn("product_id", F.col("_id")).select(*requests.columns)
    reason = F.when(sem.is_number_text("product_id"), F.lit("unknown_product")).otherwise(F.lit("bad_product_id"))
    return good, marked.filter(F.col("_exists").isNull()).withColumn("reason", reason).select(*requests.columns, "reason")


def with_unreadable(
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """``split`` for requests as ``read_requests`` gives them: lines that are no JSON are refused too, with their text in ``line``."""

    def both(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        readable, unreadable = split_corrupt(requests)
        good, bad = split(readable)
        return good, bad.unionByName(unreadable, allowMissingColumns=True)

    return both


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet table until its source is drained."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def ingest_views(requests: DataFrame, products: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append_stream(valid_views(requests, products), path, checkpoint)


def ingest_reviews(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append_stream(valid_reviews(requests)[0], path, checkpoint)


def ingest_contacts(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append_stream(valid_contacts(requests)[0], path, checkpoint)
