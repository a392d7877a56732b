"""Catalogue reads: products with ratings, featured products, galleries, stock status."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark import constants
from retail_spark.functions import semantics as sem
from retail_spark.session import materialise

DETAIL_COLUMNS = [
    "product_id", "name", "description", "unit_price", "brand", "barcode", "category_id", "stock",
    "image_url", "image_url_2", "image_url_3", "image_url_4", "image_url_5",
]
IMAGE_COLUMNS = DETAIL_COLUMNS[-5:]


def ratings(reviews: DataFrame) -> DataFrame:
    """Mean rating and review count per product. Partial sums leave the scan, so a hot product costs nothing."""
    return reviews.groupBy("product_id").agg(
        F.avg("rating").alias("average_rating"), F.count(F.lit(1)).alias("review_count")
    )


def catalog_with_ratings(products: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """All products with mean rating and count, 0 without reviews; the first ``limit`` by id when it is above 0."""
    if isinstance(limit, int) and limit > 0:
        # Cut before the join: the left join keeps one row per product, and only its reviews are counted.
        products = products.orderBy("product_id").limit(limit)
        reviews = reviews.join(F.broadcast(products.select("product_id")), "product_id", "left_semi")
    rated = products.join(ratings(reviews), "product_id", "left").withColumns(
        {
            "average_rating": F.coalesce("average_rating", F.lit(0.0)),
            "review_count": F.coalesce("review_count", F.lit(0)),
        }
    )
    return rated.orderBy("product_id") if limit else rated


def product_by_id(products: DataFrame, product_id: int | str) -> DataFrame:
    """Detail columns of one product; no row when it is missing. Ids that are no numbers are refused."""
    return products.filter(F.col("product_id") == checked_id(product_id)).select(*DETAIL_COLUMNS)


def checked_id(value: int | str) -> int | None:
    """The id as a number. Empty text and numbers that are not whole are accepted and match nothing, as for the store."""
    if isinstance(value, str):
        found = re.fullmatch(sem.WHOLE_NUMBER_TEXT, value)
        if not found:
            raise ValueError(f"id must be a number: {value!r}")
        number = float(found[1] or "nan")
        return int(number) if number.is_integer() else None
    return value


def product_reviews(reviews: DataFrame, product_id: int) -> DataFrame:
    """Reviews of one product, newest first."""
    return reviews.filter(F.col("product_id") == checked_id(product_id)).orderBy(
        F.desc("created_at"), F.desc("review_id")
    )


def featured_products(products: DataFrame, reviews: DataFrame, views: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` most viewed products with their rating, null when nobody reviewed them.

    When no product has views, the first ``k`` products take their place, rated 0.
    The winners are found on counts alone; reviews are aggregated only for them.
    """
    counts = views.groupBy("product_id").agg(F.count(F.lit(1)).alias("view_count"))
    # Rank ids alone; the wide product rows are fetched for the winners, never shuffled.
    best = materialise(
        counts.join(products.select("product_id"), "product_id")
        .orderBy(F.desc("view_count"), "product_id")
        .limit(k),
        "featured",
    )
    top = products.join(F.broadcast(best), "product_id").withColumn("_fallback", F.lit(False))
    chosen = top.unionByName(featured_fallback(products, best, k))
    rated = ratings(reviews.join(F.broadcast(chosen.select("product_id")), "product_id", "left_semi"))
    unrated = F.when(F.col("_fallback"), F.lit(0.0))
    return (
        chosen.join(rated, "product_id", "left")
        .withColumns(
            {
                "average_rating": F.coalesce("average_rating", unrated),
                "review_count": F.coalesce("review_count", F.lit(0)),
            }
        )
        .drop("_fallback")
        .orderBy(F.desc("view_count"), "product_id")
    )


def featured_fallback(products: DataFrame, best: DataFrame, k: int = 4) -> DataFrame:
    """The first ``k`` products, but only when ``best``, the most viewed ones, is empty."""
    viewed_count = best.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        products.orderBy("product_id")
        .limit(k)
        .filter(viewed_count == 0)
        .withColumns({"view_count": F.lit(0).cast("bigint"), "_fallback": F.lit(True)})
    )


def first_products(catalog: DataFrame, n: int = 3) -> DataFrame:
    return catalog.orderBy("product_id").limit(n)


def carousel(catalog: DataFrame, n: int = 5, blurb: int = 70) -> DataFrame:
    """The first ``n`` products with a short text: the start of the description and three dots."""
    text = F.when(
        sem.has_text("description"), F.concat(F.substring("description", 1, blurb), F.lit("..."))
    ).otherwise(F.lit(constants.CAROUSEL_BLURB))
    return first_products(catalog, n).withColumn("blurb", text)


def category_list(categories: DataFrame, collation: str | None = None) -> DataFrame:
    return categories.select("category_id", "name").orderBy(sem.comparable("name", collation), "category_id")


def with_stock_status(df: DataFrame) -> DataFrame:
    return df.withColumn("out_of_stock", F.coalesce("stock", F.lit(0)) <= 0)


def with_gallery(df: DataFrame, placeholder: str = constants.GALLERY_PLACEHOLDER) -> DataFrame:
    """The images a product has, in order, and the one to show first."""
    images = F.filter(F.array(*IMAGE_COLUMNS), lambda url: sem.has_text(url))
    return df.withColumn("images", images).withColumn(
        "main_image", F.coalesce(F.try_element_at("images", F.lit(1)), F.lit(placeholder))
    )


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Loose price and stock texts as numbers, 0 when they hold none."""
    return raw.withColumns(
        {
            "unit_price": F.coalesce(sem.js_float("unit_price"), F.lit(0.0)),
            "stock": F.coalesce(sem.js_int("stock"), F.lit(0)),
        }
    )


def admin_products(products: DataFrame, product_id: int | str | None = None) -> DataFrame:
    """All columns of all products by id, or of one."""
    if product_id is not None:
        return products.filter(F.col("product_id") == checked_id(product_id))
    return products.orderBy("product_id")
