"""Sales and view figures of the back office."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark import constants


def _window_start(as_of: date, days: int):
    """Midnight ``days`` days before ``as_of``. The window has no end."""
    return F.lit(f"{as_of - timedelta(days=days)} 00:00:00").cast("timestamp_ntz")


def sold(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(constants.SOLD_STATUSES))


def sales_kpis(orders: DataFrame, users: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Sales of the window from sold orders; counts of all orders and of all users.

    The window's filter reaches the scan, and the counts read no column.
    """
    recent = sold(orders).filter(F.col("created_at") >= _window_start(as_of, days))
    return recent.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_sales_30_days")).select(
        "total_sales_30_days", _count(orders).alias("total_orders"), _count(users).alias("total_users")
    )


def _count(rows: DataFrame) -> Column:
    return rows.agg(F.count(F.lit(1)).alias("n")).scalar()


def daily_sales(orders: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Sold totals per day of the window."""
    return (
        sold(orders)
        .filter(F.col("created_at") >= _window_start(as_of, days))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("sale_day"))
        .agg(F.sum("total").alias("total_sales"))
        .orderBy("sale_day")
    )


def top_products_sold(lines: DataFrame, products: DataFrame, orders: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` products with most units in sold orders.

    The one big join is lines with sold order ids. Units are summed per product
    before names are attached, so the product join sees one row per product.
    """
    units = (
        lines.select("order_id", "product_id", "quantity")
        .join(sold(orders).select("order_id"), "order_id")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units_sold"))
    )
    return (
        units.join(products.select("product_id", "name"), "product_id")
        .select("product_id", "name", "units_sold")
        .orderBy(F.desc("units_sold"), "product_id")
        .limit(k)
    )


def top_products_viewed(views: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most viewed products."""
    counts = views.groupBy("product_id").agg(F.count("view_id").alias("view_count"))
    return (
        counts.join(products.select("product_id", "name"), "product_id")
        .select("product_id", "name", "view_count")
        .orderBy(F.desc("view_count"), "product_id")
        .limit(k)
    )


def sales_overview(
    orders: DataFrame, users: DataFrame, lines: DataFrame, products: DataFrame, as_of: date, days: int = 30, k: int = 5
) -> DataFrame:
    """Key figures, days and best sellers as one document in one row.

    The collected lists are bounded: one entry per calendar day of the window, and ``k`` products.
    """
    by_day = daily_sales(orders, as_of, days).agg(
        F.sort_array(F.collect_list(F.struct("sale_day", "total_sales"))).alias("v")
    )
    ranked = top_products_sold(lines, products, orders, k).select(
        F.struct((-F.col("units_sold")).alias("rank_key"), "product_id", "name", "units_sold").alias("row")
    )
    best = ranked.agg(
        F.transform(
            F.sort_array(F.collect_list("row")), lambda r: F.struct(r["name"].alias("name"), r["units_sold"].alias("units_sold"))
        ).alias("v")
    )
    # The window's sales are the sum of its days.
    total = F.aggregate(
        F.col("v"), F.lit(0).cast("decimal(28,2)"), lambda s, day: (s + day["total_sales"]).cast("decimal(28,2)")
    )
    return by_day.select(
        F.struct(
            total.alias("total_sales_30_days"), _count(orders).alias("total_orders"), _count(users).alias("total_users")
        ).alias("kpis"),
        F.col("v").alias("daily_sales"),
        best.scalar().alias("top_products"),
    )
