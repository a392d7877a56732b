"""Carts: totals, cleaning, stock, and the cart left by a log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.functions import semantics as sem
from retail_spark.functions.scale import ROWS_PER_SPLIT, hot_keys, salted_join
from retail_spark.schemas import RAW_CART


def cart_totals(items: DataFrame) -> DataFrame:
    """Sum and item count per user of loosely typed items; what is no number counts 0."""
    price = F.coalesce(sem.js_float("price"), F.lit(0.0)).cast("decimal(18,2)")
    quantity = F.coalesce(sem.js_int("quantity"), F.lit(0))
    return items.groupBy("user_id").agg(
        F.sum((price * quantity).cast("decimal(28,2)")).alias("subtotal"), F.sum(quantity).alias("item_count")
    ).withColumn("total", F.col("subtotal"))


def clean_cart(carts: DataFrame, column: str = "cart_text") -> DataFrame:
    """Cart texts as arrays: items without product drop out, anything but an array is empty."""
    is_array = F.coalesce(F.col(column).rlike(r"^\s*\["), F.lit(False))
    parsed = F.when(is_array, F.from_json(column, RAW_CART))
    items = F.filter(parsed, lambda item: item.isNotNull() & item["productId"].isNotNull())
    return carts.withColumn("cart", F.coalesce(items, F.array().cast(RAW_CART)))


def enrich_cart(items: DataFrame, products: DataFrame) -> DataFrame:
    """Cart items with today's stock, 0 for unknown products."""
    return items.join(products.select("product_id", "stock"), "product_id", "left").withColumn(
        "stock", F.coalesce("stock", F.lit(0))
    )


def cart_state(events: DataFrame, products: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The cart every user is left with after all add, set, remove and clear events.

    An add fills up to the stock; a set changes only what is in the cart, within the stock;
    set to 0 and remove take the product out; clear empties the user's cart. Events without a
    product or with an unusable quantity are passed over.

    Folding a user's events in order would need them all in one task. The result depends on
    less: the last time the product left the cart, the first add after that, the last set after
    that add, and the sum of the adds after that set. A set before the first add changes nothing, so
    the last set counts when it is later than the first add. All of these are plain
    aggregates, reduced before the shuffle; the log is joined to them with hot keys spread out.
    """
    keys = ["user_id", "product_id"]
    at = F.struct("ts", "event_id").alias("at")
    log = events.select(*keys, "event_id", "kind", "quantity", at)
    cleared = log.filter(F.col("kind") == "clear").groupBy("user_id").agg(F.max("at").alias("_cleared"))
    leaves = (F.col("kind") == "remove") | ((F.col("kind") == "set") & (F.col("quantity") == 0))
    changes = (F.col("kind").isin("add", "set")) & (F.col("quantity") > 0)
    moves = log.filter(F.col("product_id").isNotNull() & (leaves | changes))
    left_at = moves.groupBy(*keys).agg(F.max(F.when(leaves, F.col("at"))).alias("_removed"))
    reset = (
        left_at.join(cleared, "user_id", "left")
        .withColumn("_reset", F.greatest("_removed", "_cleared"))
        .join(products.select("product_id", "stock"), "product_id")
        .filter(F.col("stock") > 0)
        .select(*keys, "_reset", "stock")
    )
    hot = hot_keys(moves, keys, rows_per_split)
    spread = ["event_id"]
    recent = salted_join(moves.filter(changes), reset, keys, spread, hot=hot).filter(
        F.col("_reset").isNull() | (F.col("at") > F.col("_reset"))
    )
    is_add = F.col("kind") == "add"
    added = F.sum(F.when(is_add, F.col("quantity").cast("bigint")))
    stays = (
        recent.groupBy(*keys)
        .agg(
            F.min(F.when(is_add, F.col("at"))).alias("_entered"),
            F.max(F.when(~is_add, F.struct("at", "quantity"))).alias("_set"),
            added.alias("_added"),
            F.max("stock").alias("stock"),
        )
        .filter(F.col("_entered").isNotNull())
        .withColumn("_set", F.when(F.col("_set.at") > F.col("_entered"), F.col("_set")))
    )
    sets = stays.filter(F.col("_set").isNotNull()).select(*keys, F.col("_set.at").alias("_set_at"))
    after_set = (
        salted_join(recent.filter(is_add).drop("stock", "_reset"), sets, keys, spread, hot=hot)
        .filter(F.col("at") > F.col("_set_at"))
        .groupBy(*keys)
        .agg(F.sum(F.col("quantity").cast("bigint")).alias("_after"))
    )
    total = F.when(F.col("_set").isNull(), F.col("_added")).otherwise(
        F.least("_set.quantity", "stock") + F.coalesce("_after", F.lit(0))
    )
    return stays.join(after_set, keys, "left").select(
        *keys, F.least(total, F.col("stock").cast("bigint")).cast("int").alias("quantity")
    )
