"""Helpers that keep work spread out: numbering, hot keys, salted joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.session import materialise

# A key with more rows than this is spread over several tasks, whatever the size of the table.
ROWS_PER_SPLIT = 250_000
NULL_KEY_SPLITS = 1024


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "seq", label: str = "numbered") -> DataFrame:
    """Add a dense 1-based number in the given order without a one-task sort.

    Rows are range-partitioned and sorted; each row's number is its place in its
    partition plus the size of the partitions before it. The sorted rows are
    written once, so a retried task cannot renumber them. The only unpartitioned
    window runs over one row per partition.
    """
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), in_partition.alias("_place")),
        label,
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_place") + 1)
        .drop("_part", "_place", "_start")
    )


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The keys that hold too many rows for one task, with the splits each needs.

    There is one row out for more than ``rows_per_split`` rows in. How the list is
    joined is left to Spark, which sees its size when it has run.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_split)
        .select(*keys, F.ceil(F.col("_n") / F.lit(rows_per_split)).cast("int").alias("_splits"))
    )


def hot_among_many(df: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT, buckets: int = 1 << 16) -> DataFrame:
    """As the keys of ``hot_keys``, null too, of a table with about as many keys as rows.

    A key is in a bucket by its hash. Only keys of buckets with too many rows are counted themselves, so few rows are sent.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    full = (
        df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_split).select("_bucket")
    )
    return (
        df.select(key, bucket.alias("_bucket"))
        .join(F.broadcast(full), "_bucket")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_split)
        .select(key)
    )


def with_split(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Add ``_split``: 0 for normal keys, a hash of ``spread`` for hot and null keys."""
    place = F.xxhash64(*spread)
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    split = (
        F.when(any_null, F.pmod(place, F.lit(NULL_KEY_SPLITS)))
        .when(F.col("_splits").isNotNull(), F.pmod(place, F.col("_splits")))
        .otherwise(F.lit(0))
        .cast("int")
    )
    return df.join(hot, list(keys), "left").withColumn("_split", split).drop("_splits")


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join where a key of ``many`` may be hot and ``one`` has few rows per key.

    Hot keys of ``many`` are spread over several tasks and their match in ``one``
    is repeated for each; all other keys join as usual. ``how`` is inner or left.
    """
    if hot is None:
        hot = hot_keys(many, keys)
    repeated = (
        one.join(hot, list(keys), "left")
        .withColumn("_split", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
        .drop("_splits")
    )
    return with_split(many, keys, hot, spread).join(repeated, [*keys, "_split"], how).drop("_split")


def spread_nulls(key: str, row_id: str) -> Column:
    """A second join key that spreads the rows whose key is null.

    Those rows match nothing, yet a plain join would send them all to one task.
    The other side carries 0 in its place.
    """
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(NULL_KEY_SPLITS))).otherwise(F.lit(0))
