"""All-or-nothing admission of orders against limited stock, in order of arrival.

Served one by one, an order is accepted when every product it asks for is left in
sufficient quantity by the orders accepted before it. Whether an order is accepted thus
depends on earlier ones through several products at once, and one running sum is not
enough. The batch method narrows the answer round by round. For every line of an
undecided order it compares what is left

* at best, if no undecided order before it takes anything, and
* at worst, if all of them do.

A line short even at best refuses its order; an order whose lines all hold at worst is
accepted. The earliest undecided order is always decided, so the rounds end, and the
answer is the one-by-one answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions.scale import ROWS_PER_SPLIT, hot_keys
from retail_spark.session import new_path

OPEN, ACCEPTED, REFUSED = "open", "accepted", "refused"
ROUNDS_AT_ONCE = 4  # rounds between two writes
STATE_SCHEMA = "seq BIGINT, product_id BIGINT, need BIGINT, take BIGINT, remaining BIGINT, state STRING"


def admit_orders(
    items: DataFrame,
    stock: DataFrame,
    seq: str = "seq",
    rows_per_split: int = ROWS_PER_SPLIT,
    orders: DataFrame | None = None,
) -> DataFrame:
    """Decide every order of ``items`` (``seq``, product_id, quantity): one row (``seq``, accepted).

    ``seq`` is a whole number per order that grows with arrival. An order that names a
    product twice needs its largest line and takes the sum. Unknown products have no stock.
    ``orders`` are the rows to add ``accepted`` to, one per order with its ``seq``, where they are known; else the items are read for them.
    """
    # Only products asked for beyond their stock can refuse an order. The lines of all others drop
    # out before anything is shuffled by order.
    remaining = F.coalesce(F.col("stock").cast("bigint"), F.lit(0))
    contended = (
        items.groupBy("product_id")
        .agg(F.sum("quantity").alias("_demand"))
        .join(stock.select("product_id", "stock"), "product_id", "left")
        .filter(F.col("_demand") > remaining)
        .select("product_id", remaining.alias("remaining"))
    )
    # Dealt out by order, so that orders no stock could serve are refused here, before any round. A round claims nothing for them.
    whole = Window.partitionBy("seq")
    opened = _without_refused(
        items.join(contended, "product_id")
        .select(F.col(seq).alias("seq"), "product_id", "quantity", "remaining")
        .repartition("seq")
        .groupBy("seq", "product_id")
        .agg(
            F.max("quantity").cast("bigint").alias("need"),
            F.sum("quantity").cast("bigint").alias("take"),
            F.max("remaining").alias("remaining"),
        )
        .withColumn(
            "state",
            F.when(F.bool_or(F.col("need") > F.col("remaining")).over(whole), F.lit(REFUSED)).otherwise(F.lit(OPEN)),
        )
    )
    spark = items.sparkSession
    table = new_path(spark, "admission")

    def save(round_no: int, df: DataFrame) -> DataFrame:
        """Write one round into the shared folder; the next starts from the files, not from the plan."""
        path = f"{table}/round={round_no}"
        df.write.parquet(path)
        return spark.read.schema(STATE_SCHEMA).parquet(path)

    state = save(0, opened)
    hot = hot_keys(state, ["product_id"], rows_per_split)
    hot_products = None if hot.isEmpty() else hot.select("product_id")
    round_no = 0
    while not state.filter(F.col("state") == OPEN).isEmpty():
        round_no += 1
        current = state.filter(F.col("state") != REFUSED)
        for _ in range(ROUNDS_AT_ONCE):
            current = _next_round(current, hot_products, rows_per_split)
        state = save(round_no, current)

    if orders is None:
        orders = items.select(seq).distinct()
    refused = (
        spark.read.schema(f"{STATE_SCHEMA}, round INT")
        .parquet(table)
        .filter(F.col("state") == REFUSED)
        .select(F.col("seq").alias(seq))
        .distinct()
        .withColumn("_refused", F.lit(True))
    )
    return orders.join(refused, seq, "left").select(*orders.columns, F.col("_refused").isNull().alias("accepted"))


def _without_refused(lines: DataFrame) -> DataFrame:
    """Lines without those of refused orders, of which one each stays to tell. Rows must be dealt out by ``seq``."""
    first = F.min("product_id").over(Window.partitionBy("seq"))
    return (
        lines.withColumn("_first", first)
        .filter((F.col("state") != REFUSED) | (F.col("product_id") == F.col("_first")))
        .drop("_first")
    )


def _next_round(state: DataFrame, hot_products: DataFrame | None, rows_per_split: int) -> DataFrame:
    """Decide what can be decided.

    Lines accepted last round are charged to those after them and leave; of a refused order one line passes through.
    """
    charged = F.when(F.col("state") == ACCEPTED, F.col("take")).otherwise(0)
    claimed = F.when(F.col("state") == OPEN, F.col("take")).otherwise(0)
    sums = _sums_before(
        state.withColumns({"_charged": charged, "_claimed": claimed}), hot_products, rows_per_split
    )
    at_best = F.col("remaining") - F.col("_charged_before")
    checked = sums.filter(F.col("state") != ACCEPTED).select(
        "seq", "product_id", "need", "take",
        at_best.alias("remaining"),
        (at_best - F.col("_claimed_before") >= F.col("need")).alias("_holds"),
        ((F.col("state") == REFUSED) | (at_best < F.col("need"))).alias("_short"),
    )
    # An order's lines name different products, all of them contended, so the group stays small.
    order = Window.partitionBy("seq")
    verdict = (
        F.when(F.bool_or("_short").over(order), F.lit(REFUSED))
        .when(F.bool_and("_holds").over(order), F.lit(ACCEPTED))
        .otherwise(F.lit(OPEN))
    )
    return _without_refused(checked.select("seq", "product_id", "need", "take", "remaining", verdict.alias("state")))


def _sums_before(lines: DataFrame, hot_products: DataFrame | None, rows_per_split: int) -> DataFrame:
    """Charged and claimed quantities of earlier lines of the same product.

    A product most orders ask for is cut into blocks of arrival numbers: the sum before a line is
    the sum of the blocks before it and of the lines before it in its own. An order has one line per
    product, so a block holds at most as many lines as it spans numbers.
    """
    if hot_products is None:
        window = Window.partitionBy("product_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return lines.select(
            "*",
            *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"{c}_before") for c in ("_charged", "_claimed")],
        )
    marked = lines.join(hot_products.withColumn("_hot", F.lit(True)), "product_id", "left").withColumn(
        "_block", F.when(F.col("_hot"), F.floor(F.col("seq") / rows_per_split)).otherwise(F.lit(0))
    )
    blocks = marked.groupBy("product_id", "_block").agg(
        F.sum("_charged").alias("_charged_sum"), F.sum("_claimed").alias("_claimed_sum")
    )
    earlier = Window.partitionBy("product_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "product_id",
        "_block",
        *[F.coalesce(F.sum(f"{c}_sum").over(earlier), F.lit(0)).alias(f"{c}_offset") for c in ("_charged", "_claimed")],
    )
    within = Window.partitionBy("product_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = marked.select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_local") for c in ("_charged", "_claimed")]
    )
    return local.join(offsets, ["product_id", "_block"]).withColumns(
        {f"{c}_before": F.col(f"{c}_local") + F.col(f"{c}_offset") for c in ("_charged", "_claimed")}
    )
