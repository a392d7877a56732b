"""Change sets applied to tables. Every function returns the new table and the refused rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark import constants
from retail_spark.functions import semantics as sem
from retail_spark.functions.scale import number_rows
from retail_spark.operators.barcodes import standing_edits

PRODUCT_TEXTS = [
    "description", "barcode", "image_url", "image_url_2", "image_url_3", "image_url_4", "image_url_5",
]
COLOUR_PATTERN = "^#[0-9A-Fa-f]{3}([0-9A-Fa-f]{3})?$"  # fixed pattern


def split_by_rules(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the first rule they break. A rule is (reason, condition for bad)."""
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    marked = rows.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def latest(changes: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """One change per key, the last. A partial aggregate, so a hot key is reduced before the shuffle."""
    values = [c for c in changes.columns if c not in keys]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.col(position)).alias("_v"))
        .select(*keys, "_v.*")
        .drop(position)
    )


def merge(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], mode: str, position: str = "position"
) -> tuple[DataFrame, DataFrame]:
    """Apply changes in order of ``position``; the last one per key wins.

    Modes: insert (keys in the table are refused, and so are later rows of a key),
    update and delete (unknown keys are refused), upsert. Columns the changes lack keep their value.
    All but delete need a position, one for each change: without it no change of a key comes first or last.
    """
    keys = list(keys)
    if mode != "delete" and position not in changes.columns:
        raise ValueError(f"changes to {mode} need a column {position!r}")
    known = target.select(*keys)
    if mode == "insert":
        values = [c for c in changes.columns if c not in keys]
        first = (
            changes.groupBy(*keys)
            .agg(F.min_by(F.struct(*values), F.col(position)).alias("_v"))
            .select(*keys, "_v.*")
            .join(known, keys, "left_anti")
        )
        refused = changes.join(first, [*keys, position], "left_anti").withColumn("reason", F.lit("duplicate"))
        return target.unionByName(first.drop(position), allowMissingColumns=True), refused
    unknown = changes.join(known, keys, "left_anti").withColumn("reason", F.lit("not_found"))
    if mode == "delete":
        return target.join(changes.select(*keys), keys, "left_anti"), unknown
    newest = latest(changes, keys, position)
    changed = [c for c in newest.columns if c not in keys]
    new = newest.select(*keys, F.struct(*changed).alias("_new"))
    how = {"update": "left", "upsert": "full_outer"}[mode]
    result = target.join(new, keys, how).select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in target.columns
        ]
    )
    return result, unknown if mode == "update" else unknown.filter(F.lit(False))


def with_new_ids(table: DataFrame, new: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Give new rows the ids after the table's largest, in order of arrival."""
    largest = table.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("m")).scalar()
    numbered = number_rows(new, order, "_seq", "new_ids")
    return numbered.withColumn(id_column, F.col("_seq") + largest).drop("_seq")


# --- reviews and contact messages -------------------------------------------------------


def valid_reviews(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = ~sem.has_text("name") | ~sem.has_text("comment") | (F.coalesce("rating", F.lit(0)) == 0)
    good, bad = split_by_rules(
        new, [("missing_field", missing), ("rating_out_of_range", ~F.col("rating").between(1, 5))]
    )
    return good, bad


def add_reviews(reviews: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append reviews with name, comment and a rating of 1 to 5. The product is not checked."""
    good, bad = valid_reviews(new)
    rows = with_new_ids(reviews, good.withColumnRenamed("name", "reviewer_name"), "review_id", ["request_id"])
    return reviews.unionByName(rows.select(*reviews.columns)), bad


def valid_contacts(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    complete = sem.has_text("name") & sem.has_text("email") & sem.has_text("message")
    good, bad = split_by_rules(new, [("missing_field", ~complete)])
    return good.withColumn("subject", sem.null_if_empty("subject")), bad


def add_contacts(messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = valid_contacts(new)
    rows = with_new_ids(messages, good, "message_id", ["request_id"]).withColumns(
        {"status": F.lit("unread"), "is_starred": F.lit(False)}
    )
    return messages.unionByName(rows.select(*messages.columns)), bad


# --- products ---------------------------------------------------------------------------


def valid_products(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check loose product rows and bring their values to the table's types."""
    price, stock = sem.js_float("unit_price"), sem.js_int("stock")
    category = F.when(sem.has_text(F.col("category_id").cast("string")), sem.js_int("category_id"))
    missing = (
        ~sem.has_text("name") | ~sem.has_text("brand") | F.col("unit_price").isNull() | F.col("stock").isNull()
    )
    bad_number = (
        price.isNull() | (price < 0) | stock.isNull() | (stock < 0)
        | (sem.has_text(F.col("category_id").cast("string")) & category.isNull())
    )
    good, bad = split_by_rules(new, [("missing_field", missing), ("bad_number", bad_number)])
    typed = good.withColumns(
        {
            "unit_price": sem.money(price),
            "stock": stock.cast("int"),
            "category_id": category.cast("int"),
            **{name: sem.null_if_empty(name) for name in PRODUCT_TEXTS},
        }
    )
    return typed, bad


def _first_per_barcode(rows: DataFrame, position: str) -> DataFrame:
    """Rows whose barcode nobody claimed before them in the batch. Rows without one never clash."""
    values = [c for c in rows.columns if c != "barcode"]
    coded = (
        rows.filter(F.col("barcode").isNotNull())
        .groupBy("barcode")
        .agg(F.min_by(F.struct(*values), F.col(position)).alias("_v"))
        .select("barcode", "_v.*")
    )
    return coded.unionByName(rows.filter(F.col("barcode").isNull()))


def create_products(products: DataFrame, new: DataFrame, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """Add checked products. A barcode in the table or earlier in the batch is refused."""
    good, bad = valid_products(new)
    taken = products.select("barcode").filter(F.col("barcode").isNotNull())
    fresh = _first_per_barcode(good, position).join(taken, "barcode", "left_anti")
    clashing = good.join(fresh.select(position), position, "left_anti").select(position)
    rejects = bad.select(position, "reason").unionByName(
        clashing.withColumn("reason", F.lit("duplicate_barcode"))
    )
    rows = with_new_ids(products, fresh, "product_id", [position])
    return products.unionByName(rows.select(*products.columns)), rejects


def update_products(
    products: DataFrame, changes: DataFrame, position: str = "position"
) -> tuple[DataFrame, DataFrame]:
    """Replace whole rows by id, as if edit by edit in order of ``position``; the last edit of a product that stands wins.

    An edit is refused if the id is unknown, or if another product bears its barcode at its turn: one that bore it before
    the batch, or took it with an earlier edit, and has not left it since.
    """
    good, bad = valid_products(changes)
    known = good.join(products.select("product_id"), "product_id", "left_semi")
    missing = good.join(products.select("product_id"), "product_id", "left_anti")
    stands = known.join(standing_edits(products, known, position), position, "left_semi")
    updated, _ = merge(products, stands.select(*products.columns, position), ["product_id"], "update", position)
    clashing = known.join(stands.select(position), position, "left_anti")
    rejects = (
        bad.select(position, "product_id", "reason")
        .unionByName(missing.select(position, "product_id", F.lit("not_found").alias("reason")))
        .unionByName(clashing.select(position, "product_id", F.lit("duplicate_barcode").alias("reason")))
    )
    return updated, rejects


def delete_unreferenced(
    table: DataFrame, ids: DataFrame, key: str, references: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete rows by id unless ``references`` still points at them."""
    used = references.select(key).filter(F.col(key).isNotNull())
    known = ids.join(table.select(key), key, "left_semi")
    unknown = ids.join(table.select(key), key, "left_anti").withColumn("reason", F.lit("not_found"))
    held = known.join(used, key, "left_semi").withColumn("reason", F.lit("referenced"))
    gone = known.join(used, key, "left_anti")
    return table.join(gone, key, "left_anti"), unknown.unionByName(held)


def delete_products(products: DataFrame, ids: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete_unreferenced(products, ids.select("product_id"), "product_id", lines)


# --- users ------------------------------------------------------------------------------


def register_users(
    users: DataFrame, customers: DataFrame, new: DataFrame, position: str = "position", collation: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add accounts and the buyers that go with them. Returns users, customers, rejects.

    ``new`` carries ``password_length`` and ``password_hash``: hashing happens before. Addresses are equal under ``collation``.
    """
    from retail_spark.operators.checkout import resolve_customers

    invalid = (
        ~sem.has_text("username") | ~sem.has_text("email") | (F.coalesce("password_length", F.lit(0)) < 6)
    )
    good, bad = split_by_rules(new, [("invalid_registration", invalid)])
    key = sem.comparable("email", collation).alias("_key")
    first = (
        good.groupBy(key)
        .agg(F.min_by(F.struct(*good.columns), F.col(position)).alias("_v"))
        .join(users.select(key), "_key", "left_anti")
        .select("_v.*")
    )
    rejects = bad.select(position, "email", "reason").unionByName(
        good.join(first.select(position), position, "left_anti").select(
            position, "email", F.lit("email_taken").alias("reason")
        )
    )
    rows = with_new_ids(users, first.withColumn("role", F.lit(constants.DEFAULT_ROLE)), "user_id", [position])
    buyers, _, _ = resolve_customers(
        customers, rows.select(F.col(position).alias("request_id"), F.col("username").alias("name"), "email"), collation=collation
    )
    return users.unionByName(rows.select(*users.columns)), buyers, rejects


def set_user_role(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _set_checked(users, changes, "user_id", "role", constants.ROLES)


def delete_users(users: DataFrame, ids: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete_unreferenced(users, ids.select("user_id"), "user_id", orders)


def _set_checked(
    table: DataFrame, changes: DataFrame, key: str, column: str, allowed: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    allowed_value = F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    good, bad = split_by_rules(changes, [(f"bad_{column}", ~allowed_value)])
    updated, unknown = merge(table, good, [key], "update")
    return updated, bad.unionByName(unknown, allowMissingColumns=True)


# --- orders and messages ----------------------------------------------------------------


def set_order_status(orders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Any of the seven statuses may follow any other."""
    return _set_checked(orders, changes, "order_id", "status", constants.ORDER_STATUSES)


def set_message_status(messages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unknown messages are passed over in silence."""
    updated, rejects = _set_checked(messages, changes, "message_id", "status", constants.MESSAGE_STATUSES)
    return updated, rejects.filter(F.col("reason") != "not_found")


def star_messages(messages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    updated, rejects = merge(messages, changes, ["message_id"], "update")
    return updated, rejects.filter(F.lit(False))


def delete_messages(messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    updated, rejects = merge(messages, ids.select("message_id"), ["message_id"], "delete")
    return updated, rejects.filter(F.lit(False))


# --- settings ---------------------------------------------------------------------------


def upsert_settings(settings: DataFrame, changes: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Insert or overwrite the 13 known settings; texts are trimmed, null becomes empty.

    ``strict`` also asks for colours as #abc or #aabbcc and for social links that start
    with http, and writes only values that differ.
    """
    rules = [("unknown_key", ~F.coalesce(F.col("setting_key").isin(constants.SETTING_KEYS), F.lit(False)))]
    if strict:
        given = F.col("setting_value").isNotNull()
        rules += [
            ("bad_colour", F.startswith(F.col("setting_key"), F.lit("color")) & given
             & ~F.col("setting_value").rlike(COLOUR_PATTERN)),
            ("bad_link", F.startswith(F.col("setting_key"), F.lit("social")) & sem.has_text("setting_value")
             & ~F.startswith(F.col("setting_value"), F.lit("http"))),
        ]
    good, bad = split_by_rules(changes, rules)
    cleaned = good.withColumn("setting_value", F.coalesce(sem.js_trim("setting_value"), F.lit("")))
    if strict:
        newest = latest(cleaned, ["setting_key"])
        kept = settings.withColumnRenamed("setting_value", "_old")
        differing = newest.join(kept, "setting_key", "left").filter(~F.col("setting_value").eqNullSafe(F.col("_old")))
        cleaned = differing.drop("_old").withColumn("position", F.lit(0))  # one change a key
    return merge(settings, cleaned, ["setting_key"], "upsert")[0], bad


# --- policies and questions ---------------------------------------------------------------


def create_content(content: DataFrame, new: DataFrame, id_column: str, position: str = "position") -> DataFrame:
    """Append policies or questions with new ids, unchecked and without a place."""
    rows = with_new_ids(content, new, id_column, [position]).drop(position)
    return content.unionByName(rows, allowMissingColumns=True)


def update_content(content: DataFrame, changes: DataFrame, id_column: str) -> DataFrame:
    """Apply a list of edits as one change: the last edit of an id wins, unknown ids are passed over."""
    return merge(content, changes, [id_column], "update")[0]


def edits_from_lists(requests: DataFrame, column: str, order: str) -> DataFrame:
    """Edits out of request lists, with a position that follows request and place in the list."""
    return requests.select(order, F.posexplode(column).alias("_place", "_edit")).select(
        F.struct(order, "_place").alias("position"), "_edit.*"
    )


def delete_content(content: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return merge(content, ids.select(id_column), [id_column], "delete")[0]
