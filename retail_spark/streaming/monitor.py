"""The pending-order alarm on a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retail_spark.sources.tables import SnapshotTable

LOOK_SCHEMA = "pending_count BIGINT, previous_count BIGINT, alert BOOLEAN"


def count_batches(looks: SnapshotTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: every micro-batch is one look at the pending orders."""

    def look(changes: DataFrame, batch_id: int) -> None:
        change = changes.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("bigint").alias("_delta"))
        before = looks.current().agg(F.coalesce(F.max("pending_count"), F.lit(0)).alias("n")).scalar()
        row = change.select(
            (before + F.col("_delta")).alias("pending_count"), before.alias("previous_count")
        ).withColumn("alert", (F.col("pending_count") > 0) & (F.col("pending_count") > F.col("previous_count")))
        looks.replace(row, batch_id)

    return look


def pending_monitor_stream(
    changes: DataFrame, looks: SnapshotTable, checkpoint: str, every: str | None = "30 seconds"
) -> StreamingQuery:
    """Look every 30 seconds; with ``every`` None, once over all that is there."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        changes.writeStream.foreachBatch(count_batches(looks))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
