"""Carts kept up to date from a stream of cart events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retail_spark.operators.cart import cart_state
from retail_spark.session import discard, materialise
from retail_spark.sources.tableset import TableSet, TableSpec

EVENT = "user_id BIGINT, product_id BIGINT, event_id BIGINT, kind STRING, quantity INT, ts TIMESTAMP_NTZ"


def next_quantity(kind: str, current: int, quantity: int | None, stock: int) -> int:
    """The quantity in the cart after one event; 0 means not in the cart."""
    if kind in ("remove", "clear"):
        return 0
    if quantity is None or quantity < 0 or (kind == "add" and quantity == 0):
        return current
    if kind == "add":
        return min(current + quantity, stock) if stock > 0 else current
    return min(quantity, stock) if current else 0


def with_guests(events: DataFrame, browser: str = "browser_id") -> DataFrame:
    """Events in which every guest has a cart of their own: a null user becomes a negative number made of the browser's."""
    return events.withColumn("user_id", F.coalesce("user_id", -1 - F.abs(F.xxhash64(browser) % F.lit(2**62))))


def open_carts(spark: SparkSession, path: str, buckets: int = 64) -> TableSet:
    """Cart lines, dealt by user and product, so that a user's lines are spread; and for each user how often a batch cleared the cart."""
    return TableSet(
        spark,
        path,
        {
            "cart": TableSpec("line BIGINT, user_id BIGINT, product_id BIGINT, quantity INT, generation BIGINT", "line", buckets),
            "owner": TableSpec("user_id BIGINT, generation BIGINT", "user_id", buckets),
        },
    )


def _line() -> Column:
    return F.xxhash64("user_id", "product_id").alias("line")


def _with_generation(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """Lines that no later batch cleared."""
    named = owners.withColumnRenamed("generation", "_now")
    current = F.col("generation") == F.coalesce("_now", F.lit(0))
    return lines.join(named, "user_id", "left").filter(current).drop("_now")


def cart_batches(carts: TableSet, products: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds a micro-batch of cart events into the carts, exactly once.

    The lines the batch names are read, stand for an add before all of it, and go through the same aggregates as a whole log
    in batch, so that neither a user nor a line need fit a task. A clear concerns lines the batch does not name, too: it
    raises the user's generation, one row, and lines of an older one count no more. ``products`` is asked for in
    every batch: adds and sets meet the stock of the day, and a line whose product is sold out by then leaves the cart when it is
    next named. Events without user belong to no cart (see ``with_guests``).
    """

    def fold(events: DataFrame, batch_id: int) -> None:
        if carts.has_batch("carts", batch_id):
            return
        rows = materialise(events.filter(F.col("user_id").isNotNull()).select(
            "user_id", "product_id", "event_id", "kind", "quantity", F.col("ts").cast("timestamp_ntz").alias("ts")
        ), "cart_events")
        users = materialise(
            rows.groupBy("user_id").agg(F.count_if(F.col("kind") == "clear").alias("_clears")), "cart_users"
        )
        named = rows.filter(F.col("product_id").isNotNull()).select("user_id", "product_id").distinct()
        lines = materialise(named.select(_line(), "user_id", "product_id"), "cart_lines")
        owners = carts.read("owner", users)
        held = _with_generation(carts.read("cart", lines), owners)
        first = held.select(
            "user_id", "product_id", F.lit(None).cast("bigint").alias("event_id"), F.lit("add").alias("kind"), "quantity",
            F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        )
        left = cart_state(first.unionByName(rows), products())
        generations = users.join(owners, "user_id", "left").select(
            "user_id", (F.coalesce("generation", F.lit(0)) + F.when(F.col("_clears") > 0, 1).otherwise(0)).alias("generation")
        )
        new = left.join(generations, "user_id").select(_line(), "user_id", "product_id", "quantity", "generation")
        cleared = generations.join(users.filter("_clears > 0").select("user_id"), "user_id", "left_semi")
        carts.commit({"cart": (lines, new), "owner": (cleared, cleared)}, batch=("carts", batch_id))
        for table in (rows, users, lines):
            discard(table)

    return fold


def current_carts(carts: TableSet) -> DataFrame:
    """(user_id, product_id, quantity) of all carts as they are."""
    return _with_generation(carts.read("cart"), carts.read("owner")).select("user_id", "product_id", "quantity")


def cart_stream(events: DataFrame, products: Callable[[], DataFrame], carts: TableSet, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the carts from a stream of events; without a trigger, until the source is drained."""
    return (
        events.writeStream.foreachBatch(cart_batches(carts, products))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
