"""Checkout of a batch of orders: validation, pricing, buyers, order rows, stock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark import constants
from retail_spark.functions import semantics as sem
from retail_spark.functions.scale import number_rows
from retail_spark.operators.admission import admit_orders
from retail_spark.operators.maintenance import split_by_rules
from retail_spark.session import materialise

REQUIRED_FIELDS = ["name", "phone", "address", "department", "city", "email"]


def _cart_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_items"),
        F.count_if(F.coalesce("quantity", F.lit(0)) <= 0).alias("_bad"),
    ]


def _cart_prices() -> list[Column]:
    line_total = (F.col("unit_price") * F.col("quantity")).cast("decimal(28,2)")
    return [F.sum(line_total).alias("total"), F.bool_and(F.col("unit_price").isNotNull()).alias("_known")]


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with nested carts as heads and as one row per cart item."""
    heads = requests.select("request_id", "created_at", "method", "customer.*")
    items = requests.select("request_id", F.explode("cart").alias("_item")).select("request_id", "_item.*")
    return heads, items


def validate_checkout(heads: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refuse empty carts, missing delivery fields and quantities that are not positive."""
    good, bad = _checked(heads.join(items.groupBy("request_id").agg(*_cart_counts()), "request_id", "left"))
    return good.drop("_items", "_bad"), bad.drop("_items", "_bad")


def _checked(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads with the counts of their carts, told apart by the rules of ``validate_checkout``."""
    complete = F.lit(True)
    for field in REQUIRED_FIELDS:
        complete = complete & sem.has_text(field)
    rules = [
        ("empty_cart", F.col("_items").isNull()),
        ("missing_field", ~complete),
        ("bad_quantity", F.col("_bad") > 0),
    ]
    return split_by_rules(heads, rules)


def price_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Cart items with the table's name and price, null for unknown products."""
    known = products.select("product_id", F.col("name").alias("product_name"), "unit_price")
    return items.drop("price").join(known, "product_id", "left")


def price_carts(items: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The total of every cart. One unknown product refuses the whole cart."""
    totals, refused = _priced(price_items(items, products).groupBy("request_id").agg(*_cart_prices()))
    return totals.select("request_id", "total"), refused


def _priced(carts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Carts with their total, and those refused for an unknown product."""
    refused = carts.filter(~F.col("_known")).select("request_id", F.lit("unknown_product").alias("reason"))
    return carts.filter("_known").withColumn("total", sem.money("total")).drop("_known"), refused


def apply_stock(products: DataFrame, accepted_items: DataFrame) -> DataFrame:
    """Take the accepted quantities off the stock, never below 0."""
    taken = accepted_items.groupBy("product_id").agg(F.sum("quantity").alias("_taken"))
    left = F.greatest(F.lit(0).cast("bigint"), F.col("stock") - F.col("_taken")).cast("int")
    return products.join(taken, "product_id", "left").select(
        *[
            F.when(F.col("_taken").isNull(), F.col("stock")).otherwise(left).alias("stock") if c == "stock" else F.col(c)
            for c in products.columns
        ]
    )


def resolve_customers(
    customers: DataFrame,
    requests: DataFrame,
    order: str = "request_id",
    largest: Column | None = None,
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The buyer of every request by address, creating those not known yet.

    ``requests`` has (request_id, name, email) and ``order``, by which the first request of
    an address names the new buyer. Returns (customers, request_id with customer_id, rejects without address).
    New ids follow ``largest``, or the largest in ``customers`` where it is not given. Addresses are equal under ``collation``.
    """
    good, bad = split_by_rules(requests, [("missing_email", ~sem.has_text("email"))])
    key = sem.comparable("email", collation)
    known = customers.groupBy(key.alias("_key")).agg(F.min("customer_id").alias("customer_id"))
    first = (
        good.groupBy(key.alias("_key"))
        .agg(F.min_by(F.struct(F.col(order).alias("_order"), "name", "email"), F.col(order)).alias("_v"))
        .join(known, "_key", "left_anti")
        .select("_v.*")
    )
    if largest is None:
        largest = customers.agg(F.coalesce(F.max("customer_id"), F.lit(0)).cast("bigint").alias("m")).scalar()
    numbered = number_rows(first, ["_order", "email"], "_seq", "new_customers")
    created = numbered.select(
        (F.col("_seq") + largest).alias("customer_id"),
        sem.or_default("name", F.split_part("email", F.lit("@"), F.lit(1))).alias("first_name"),
        F.lit("").alias("last_name"),
        "email",
    )
    everyone = known.unionByName(created.select(key.alias("_key"), "customer_id"))
    resolved = good.withColumn("_key", key).join(everyone, "_key").select("request_id", "customer_id")
    return customers.unionByName(created, allowMissingColumns=True), resolved, bad


def new_order_status(method: str | Column = "method") -> Column:
    column = F.col(method) if isinstance(method, str) else method
    return F.when(column == constants.CASH_ON_DELIVERY, F.lit(constants.STATUS_OF_NEW_CASH_ORDER)).otherwise(
        F.lit(constants.STATUS_OF_NEW_PAID_ORDER)
    )


def build_orders(
    heads: DataFrame, totals: DataFrame, buyers: DataFrame, orders: DataFrame | None = None, largest: Column | None = None
) -> DataFrame:
    """Order rows of accepted requests, numbered in arrival order after ``largest`` or the largest of ``orders``.

    Without either the request id serves as order id.
    """
    rows = heads.join(totals, "request_id").join(buyers, "request_id")
    if orders is None and largest is None:
        numbered = rows.withColumn("order_id", F.col("request_id"))
    else:
        if largest is None:
            largest = orders.agg(F.coalesce(F.max("order_id"), F.lit(0)).cast("bigint").alias("m")).scalar()
        numbered = number_rows(rows, ["created_at", "request_id"], "_seq", "new_orders").withColumn(
            "order_id", F.col("_seq") + largest
        )
    reference = F.col("payment_ref") if "payment_ref" in heads.columns else F.lit(None).cast("string")
    return numbered.select(
        "request_id",
        "order_id",
        "user_id",
        "total",
        new_order_status().alias("status"),
        F.col("method").alias("payment_method"),
        reference.alias("payment_ref"),
        F.col("name").alias("ship_name"),
        F.col("address").alias("ship_address"),
        F.col("department").alias("ship_department"),
        F.col("city").alias("ship_city"),
        sem.null_if_empty("complement").alias("ship_reference"),
        F.col("phone").alias("ship_phone"),
        F.col("email").alias("ship_email"),
        "created_at",
        "customer_id",
    )


def build_order_lines(new_orders: DataFrame, priced_items: DataFrame) -> DataFrame:
    return priced_items.join(new_orders.select("request_id", "order_id"), "request_id").select(
        "order_id", "product_id", "quantity", "unit_price"
    )


@dataclass
class Checkout:
    """What a checkout batch changes."""

    orders: DataFrame
    lines: DataFrame
    products: DataFrame
    customers: DataFrame
    rejects: DataFrame


def place_orders(
    heads: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, orders: DataFrame | None,
    largest_order: Column | None = None, largest_customer: Column | None = None,
) -> Checkout:
    """A batch of checkouts from request to stock, as if served one by one in order of arrival.

    ``products`` and ``customers`` need only hold those that the requests name. New ids follow the numbers given, or the
    largest in ``orders`` and ``customers``.
    """
    # One grouping of the priced items serves both the check and the price of every cart.
    carts = price_items(items, products).groupBy("request_id").agg(*_cart_counts(), *_cart_prices())
    valid, invalid = _checked(heads.join(carts, "request_id", "left"))
    priced, unpriced = _priced(valid.drop("_items", "_bad"))
    # Numbering writes the priced requests once; everything below starts from those files.
    arrivals = number_rows(priced, ["created_at", "request_id"], "seq", "arrivals")
    numbers = arrivals.select("request_id", "seq")
    decided = materialise(
        admit_orders(items.join(numbers, "request_id"), products.select("product_id", "stock"), orders=numbers),
        "decided",
    )
    admitted = decided.filter("accepted").select("request_id")
    short = decided.filter("not accepted").select("request_id", F.lit("out_of_stock").alias("reason"))
    kept = materialise(arrivals.join(admitted, "request_id", "left_semi"), "kept")
    buyers, buyer_of, _ = resolve_customers(
        customers, kept.select("request_id", "name", "email", "seq"), order="seq", largest=largest_customer
    )
    new_orders = build_orders(
        kept.drop("total", "seq"), kept.select("request_id", "total"), buyer_of, orders, largest=largest_order
    )
    kept_items = items.join(admitted, "request_id", "left_semi")
    return Checkout(
        orders=new_orders,
        lines=build_order_lines(new_orders, price_items(kept_items, products)),
        products=apply_stock(products, kept_items),
        customers=buyers,
        rejects=invalid.select("request_id", "reason").unionByName(unpriced.distinct()).unionByName(short),
    )


def completed_captures(captures: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkout heads whose payment was captured, with the provider's number as reference."""
    done = captures.filter(F.col("status") == "COMPLETED").select(
        "request_id", F.col("provider_order_id").alias("payment_ref")
    )
    failed = captures.filter(~F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).select(
        "request_id", F.concat(F.lit("capture_"), F.coalesce("status", F.lit("unknown"))).alias("reason")
    )
    return heads.join(done, "request_id").withColumn("method", F.lit(constants.PAYPAL)), failed


def capture_paypal_batch(
    captures: DataFrame, heads: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame,
    orders: DataFrame,
) -> Checkout:
    """Place the orders of completed captures only."""
    paid, failed = completed_captures(captures, heads)
    placed = place_orders(
        paid, items.join(paid.select("request_id"), "request_id", "left_semi"), products, customers, orders
    )
    placed.rejects = placed.rejects.unionByName(failed)
    return placed


def convert_currency(amounts: DataFrame, rates: DataFrame, currency: str = "USD", amount: str = "total") -> DataFrame:
    """Pesos as another currency, by the newest rate of the feed or the fixed one when the feed is empty."""
    newest = rates.filter(F.col("currency") == currency).agg(F.max_by("rate", "as_of").alias("r")).scalar()
    return amounts.withColumn("rate", sem.first_rate(newest)).withColumn(
        f"{amount}_{currency.lower()}", sem.amount_2dp(F.col(amount) / F.col("rate"))
    )
