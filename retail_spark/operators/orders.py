"""Order and user reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark import constants
from retail_spark.functions import semantics as sem
from retail_spark.functions.scale import number_rows, spread_nulls
from retail_spark.session import materialise

HISTORY_COLUMNS = ["order_id", "created_at", "total", "status", "payment_method", "payment_ref"]
PAGE_SIZE = 100_000  # items in one row of an order; the next ones go to the next page


def order_items(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with the product's name and first image. Lines of missing products fall out."""
    return lines.join(products.select("product_id", F.col("name").alias("product_name"), "image_url"), "product_id")


def user_order_history(
    orders: DataFrame, lines: DataFrame, products: DataFrame, user_id: int | None = None
) -> DataFrame:
    """Orders of one user, or of all who have an account, newest first, one row per line.

    An order none of whose lines survives keeps one row with null item columns.
    """
    mine, items = _mine(orders, lines, products, user_id)
    history = mine.join(items, "order_id", "left")
    return _newest_first(history, user_id, "product_id", "quantity", "price_paid")


def _mine(
    orders: DataFrame, lines: DataFrame, products: DataFrame, user_id: int | None
) -> tuple[DataFrame, DataFrame]:
    """The orders of one user or of all accounts, and their items. Lines of other orders drop out before products are joined."""
    mine = orders.filter(F.col("user_id").isNotNull() if user_id is None else F.col("user_id") == user_id).select(
        "user_id", *HISTORY_COLUMNS
    )
    own = lines.join(mine.select("order_id"), "order_id", "left_semi")
    return mine, order_items(own, products).withColumnRenamed("unit_price", "price_paid")


def _newest_first(history: DataFrame, user_id: int | None, *then: str) -> DataFrame:
    """Newest orders first; for all users, account by account.

    Rows are dealt out by ranges of account, time and order, so that an account with any number of rows spans as many tasks as
    it needs, and partitions follow each other in this order.
    """
    by = [F.desc("created_at"), F.desc("order_id"), *then]
    if user_id is not None:
        return history.orderBy(*by)
    return history.repartitionByRange("user_id", *by).sortWithinPartitions("user_id", *by)


def nest_items(
    headers: DataFrame, items: DataFrame, key: str, columns: Sequence[str], page_size: int = PAGE_SIZE
) -> DataFrame:
    """Headers with their items in pages: arrays of at most ``page_size`` items, in the order of ``columns``.

    The place of an item among those of its order, divided by ``page_size``, is
    its page; pages in order, joined, are the whole list. An order without items has one empty page.
    Only orders with more items than a page holds need those places: their items are numbered
    in a range partitioning, so that no task holds them all.
    """
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long_ones = materialise(counts.filter(F.col("_n") > page_size).select(key), "long_orders")
    if long_ones.isEmpty():
        placed = items.withColumn("page", F.lit(0))
    else:
        numbered = number_rows(items.join(long_ones, key, "left_semi"), [key, *columns], "_item_no", "order_items")
        first = numbered.groupBy(key).agg(F.min("_item_no").alias("_first"))
        page = F.floor((F.col("_item_no") - F.col("_first")) / page_size).cast("int")
        placed = (
            items.join(long_ones, key, "left_anti")
            .withColumn("page", F.lit(0))
            .unionByName(numbered.join(first, key).withColumn("page", page).drop("_item_no", "_first"))
        )
    paged = placed.groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))
    empty = F.array().cast(paged.schema["items"].dataType)
    return headers.join(paged, key, "left").withColumns(
        {"page": F.coalesce("page", F.lit(0)), "items": F.coalesce("items", empty)}
    )


def user_order_documents(
    orders: DataFrame, lines: DataFrame, products: DataFrame, user_id: int | None = None
) -> DataFrame:
    """The order history with each order's items nested, newest first."""
    mine, items = _mine(orders, lines, products, user_id)
    nested = nest_items(mine, items, "order_id", ["product_id", "product_name", "image_url", "quantity", "price_paid"])
    return _newest_first(nested, user_id, "page")


def with_customer_names(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Name and address of the account, else those of the delivery.

    Guest orders have no user; a second key spreads them so they do not meet in one task.
    """
    accounts = users.select("user_id", "username", F.col("email").alias("user_email"), F.lit(0).alias("_spread"))
    named = orders.withColumn("_spread", spread_nulls("user_id", "order_id").cast("int"))
    return (
        named.join(accounts, ["user_id", "_spread"], "left")
        .withColumn("customer_name", F.coalesce("username", "ship_name"))
        .withColumn("customer_email", F.coalesce("user_email", "ship_email"))
        .drop("_spread", "username", "user_email")
    )


def admin_orders(orders: DataFrame, users: DataFrame) -> DataFrame:
    """All orders with the customer, newest first."""
    return (
        with_customer_names(orders, users)
        .select(*HISTORY_COLUMNS, "customer_name", "customer_email")
        .orderBy(F.desc("created_at"), F.desc("order_id"))
    )


def admin_order_detail(
    orders: DataFrame, users: DataFrame, lines: DataFrame, products: DataFrame, order_id: int | None = None
) -> DataFrame:
    """All header columns and the lines, one row per line, of one order or of all."""
    if order_id is not None:
        orders = orders.filter(F.col("order_id") == order_id)
        lines = lines.filter(F.col("order_id") == order_id)
    items = order_items(lines, products)
    return with_customer_names(orders, users).join(items, "order_id", "left")


def admin_order_documents(
    orders: DataFrame, users: DataFrame, lines: DataFrame, products: DataFrame, order_id: int | None = None
) -> DataFrame:
    """As ``admin_order_detail`` with the lines nested."""
    if order_id is not None:
        orders = orders.filter(F.col("order_id") == order_id)
        lines = lines.filter(F.col("order_id") == order_id)
    return nest_items(
        with_customer_names(orders, users),
        order_items(lines, products),
        "order_id",
        ["product_id", "product_name", "image_url", "quantity", "unit_price"],
    )


def with_display_bucket(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {
            "bucket": F.when(F.col("status").isin(constants.SETTLED_STATUSES), F.lit("green")).otherwise(F.lit("yellow")),
            "method_label": sem.or_default("payment_method", "N/A"),
        }
    )


def pending_order_count(
    orders: DataFrame, statuses: Sequence[str] = tuple(constants.PENDING_STATUSES), last_count: int = 0
) -> DataFrame:
    """Pending orders, and whether there are more than at the last look."""
    count = F.count_if(F.col("status").isin(list(statuses)))
    return orders.agg(count.alias("pending_count")).withColumn(
        "rose", (F.col("pending_count") > 0) & (F.col("pending_count") > F.lit(last_count))
    )


def admin_users(users: DataFrame) -> DataFrame:
    """Accounts by falling id, without the password hash."""
    return users.select("user_id", "username", "email", "role").orderBy(F.desc("user_id"))


def user_by_email(users: DataFrame, email: str, collation: str | None = None) -> DataFrame:
    """The account with this address, under ``collation``; accounts without a role count as customers."""
    return (
        users.filter(sem.comparable("email", collation) == sem.comparable(F.lit(email), collation))
        .orderBy("user_id")
        .limit(1)
        .withColumn("role", sem.or_default("role", constants.DEFAULT_ROLE))
    )


def with_valid_user(requests: DataFrame, users: DataFrame, column: str = "user_ref") -> tuple[DataFrame, DataFrame]:
    """Requests whose user id is a number and exists, with ``user_id``; and the others with a reason."""
    parsed = requests.withColumn("user_id", sem.js_int(column))
    ids = users.select("user_id")
    numeric = parsed.filter(F.col("user_id").isNotNull())
    valid = numeric.join(ids, "user_id", "left_semi")
    unknown = numeric.join(ids, "user_id", "left_anti").withColumn("reason", F.lit("unknown_user"))
    unreadable = parsed.filter(F.col("user_id").isNull()).withColumn("reason", F.lit("no_user_id"))
    return valid, unreadable.unionByName(unknown)


def attach_email(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """The account's address for each payment attempt, null when there is none."""
    return attempts.join(users.select("user_id", F.col("email").alias("user_email")), "user_id", "left")
