"""How many orders are pending at every look, and when to raise the alarm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending_monitor(changes: DataFrame, every_seconds: int = 30) -> DataFrame:
    """Pending orders at each look that sees a change, and whether to alert.

    ``changes`` has (changed_at, delta): 1 when an order becomes pending, -1 when it no longer is.
    The alert rings when some are pending and more than at the last look. Counts run over time, so
    they are summed per look, then within each day, and carried from day to day: the
    window over days has one row per calendar day, the one within a day at most a look's worth
    per interval.
    """
    seconds = F.unix_timestamp(F.col("changed_at").cast("timestamp"))
    look = (F.floor(seconds / every_seconds) + 1) * every_seconds
    looks = (
        changes.groupBy(look.alias("poll_second"))
        .agg(F.sum("delta").alias("_delta"))
        .withColumn("_day", F.floor(F.col("poll_second") / 86400))
    )
    days = looks.groupBy("_day").agg(F.sum("_delta").alias("_sum"))
    earlier_days = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("_day", F.coalesce(F.sum("_sum").over(earlier_days), F.lit(0)).alias("_carried"))
    in_day = Window.partitionBy("_day").orderBy("poll_second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        looks.withColumn("_run", F.sum("_delta").over(in_day))
        .join(carried, "_day")
        .select(
            F.timestamp_seconds("poll_second").cast("timestamp_ntz").alias("poll_at"),
            (F.col("_carried") + F.col("_run")).alias("pending_count"),
            (F.col("_carried") + F.col("_run") - F.col("_delta")).alias("previous_count"),
        )
        .withColumn("alert", (F.col("pending_count") > 0) & (F.col("pending_count") > F.col("previous_count")))
    )
