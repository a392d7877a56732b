"""All queries over the test data, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark import constants, schemas
from retail_spark.functions import semantics as sem
from retail_spark.operators import (
    admission,
    analytics,
    cart,
    catalog,
    checkout,
    content,
    maintenance,
    monitor,
    orders,
    payments,
    text,
)
from retail_spark.plans import oracle
from retail_spark.sources import tables
from retail_spark.sources.testdata import TEST_SECRET, Store
from retail_spark.streaming import ingest

AS_OF = date(2001, 8, 1)
DAYS_START = "timestamp '2001-07-02 00:00:00'"
ONE_PRODUCT = 42
ONE_USER_EMAIL = "user51@example.com"
STORE_NAME = constants.STORE_NAME

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def at_edge(df: DataFrame) -> DataFrame:
    """Money leaves a query as DOUBLE."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(key: str, sql: str | None = None):
    """Register ``key`` with its SQL, written over the named views."""

    def register(build: Callable[[Store], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return at_edge(build(Store(spark, folder)))

        QUERIES[key] = run
        if sql:
            ORACLE[key] = oracle.with_views(sql)
        return build

    return register


P_COLUMNS = (
    "p.product_id, p.name, p.description, cast(p.unit_price as double) as unit_price, p.brand, p.barcode, "
    "p.category_id, p.stock, p.image_url, p.image_url_2, p.image_url_3, p.image_url_4, p.image_url_5"
)
RATED = "coalesce(r.average_rating, 0) as average_rating, coalesce(r.review_count, 0) as review_count"
TABLE_P = f"select {P_COLUMNS} from product p"


def constants_table(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), schemas.TABLES["site_setting"])


# --- catalogue ------------------------------------------------------------------------


@query(
    "catalog_with_ratings",
    f"select {P_COLUMNS}, {RATED} from product p left join rating r using (product_id)",
)
def _(s: Store):
    return catalog.catalog_with_ratings(s.products(), s.reviews())


@query(
    "catalog_limited",
    f"select {P_COLUMNS}, {RATED} from product p left join rating r using (product_id) order by p.product_id limit 7",
)
def _(s: Store):
    return catalog.catalog_with_ratings(s.products(), s.reviews(), limit=7)


@query("product_by_id", f"{TABLE_P} where product_id = {ONE_PRODUCT}")
def _(s: Store):
    return catalog.product_by_id(s.products(), ONE_PRODUCT)


@query("product_reviews", f"select * from review where product_id = {ONE_PRODUCT}")
def _(s: Store):
    return catalog.product_reviews(s.reviews(), ONE_PRODUCT)


@query(
    "featured_products",
    f"select {P_COLUMNS}, v.view_count, (select avg(rating) from review where product_id = p.product_id) as "
    "average_rating, (select count(*) from review where product_id = p.product_id) as review_count from product p "
    "join (select product_id, count(*) as view_count from product_view group by 1) v using (product_id) "
    "order by v.view_count desc, p.product_id limit 4",
)
def _(s: Store):
    return catalog.featured_products(s.products(), s.reviews(), s.views())


@query(
    "featured_fallback",
    f"select {P_COLUMNS}, cast(0 as bigint) as view_count, {RATED} from product p left join rating r "
    "using (product_id) where not exists (select 1 from product_view where product_id < 0) order by p.product_id limit 4",
)
def _(s: Store):
    """The fallback branch: nobody viewed a product with a negative id."""
    return catalog.featured_products(s.products(), s.reviews(), s.views().filter("product_id < 0"))


@query(
    "featured_first3",
    f"select {P_COLUMNS}, {RATED} from product p left join rating r using (product_id) order by p.product_id limit 3",
)
def _(s: Store):
    return catalog.catalog_with_ratings(s.products(), s.reviews(), limit=3)


@query(
    "carousel",
    "select product_id, name, cast(unit_price as double) as unit_price, image_url, "
    f"case when coalesce(description, '') <> '' then substring(description, 1, 70) || '...' "
    f"else {oracle.quoted(constants.CAROUSEL_BLURB)} end as blurb from product order by product_id limit 5",
)
def _(s: Store):
    return catalog.carousel(s.goods()).select("product_id", "name", "unit_price", "image_url", "blurb")


@query("category_list", "select category_id, name from category order by name")
def _(s: Store):
    return catalog.category_list(s.categories())


@query("stock_status", "select product_id, stock, coalesce(stock, 0) <= 0 as out_of_stock from product")
def _(s: Store):
    return catalog.with_stock_status(s.goods()).select("product_id", "stock", "out_of_stock")


@query(
    "image_gallery",
    "select product_id, array_to_string(images, '|') as images, cast(len(images) as int) as image_count, "
    f"coalesce(images[1], {oracle.quoted(constants.GALLERY_PLACEHOLDER)}) as main_image from (select product_id, "
    "list_filter([nullif(image_url, ''), image_url_2, image_url_3, image_url_4, image_url_5], lambda x: x is not null) "
    "as images from product)",
)
def _(s: Store):
    return catalog.with_gallery(s.goods()).select(
        "product_id", F.array_join("images", "|").alias("images"), F.size("images").alias("image_count"), "main_image"
    )


@query(
    "clean_catalog",
    f"select product_id, coalesce({oracle.js_float('unit_price')}, 0) as unit_price, "
    f"coalesce({oracle.js_int('stock')}, 0) as stock from raw_product",
)
def _(s: Store):
    return catalog.clean_catalog(s.raw_products())


@query("admin_product_list", f"{TABLE_P} order by product_id")
def _(s: Store):
    return catalog.admin_products(s.products())


@query("admin_product_by_id", f"{TABLE_P} where product_id = {ONE_PRODUCT}")
def _(s: Store):
    return catalog.admin_products(s.products(), str(ONE_PRODUCT))


# --- orders and users -------------------------------------------------------------------

O_COLUMNS = "o.order_id, o.created_at, cast(o.total as double) as total, o.status, o.payment_method, o.payment_ref"
ITEMS_SQL = (
    "select l.order_id, l.product_id, l.quantity, cast(l.unit_price as double) as unit_price, p.name as product_name, "
    "p.image_url from order_line l join product p using (product_id)"
)
ITEM_TEXT_SQL = (
    "select l.order_id, string_agg(l.product_id || ':' || l.quantity || ':' || l.unit_price, ';' "
    "order by l.product_id, l.quantity, l.unit_price) as items, cast(count(*) as int) as item_count "
    "from order_line l join product p using (product_id) group by 1"
)
NAMES_SQL = "coalesce(u.username, o.ship_name) as customer_name, coalesce(u.email, o.ship_email) as customer_email"


def item_text(price: str) -> Column:
    return F.array_join(
        F.transform(
            "items", lambda i: F.concat_ws(":", *[i[c].cast("string") for c in ("product_id", "quantity", price)])
        ),
        ";",
    )


@query(
    "user_order_history",
    f"select o.user_id, {O_COLUMNS}, i.product_id, i.quantity, i.unit_price as price_paid, i.product_name, i.image_url "
    f"from orders_v o left join ({ITEMS_SQL}) i using (order_id) where o.user_id is not null",
)
def _(s: Store):
    return orders.user_order_history(s.orders(), s.order_lines(), s.goods())


@query(
    "user_order_documents",
    f"select o.user_id, {O_COLUMNS}, 0 as page, coalesce(i.items, '') as items, coalesce(i.item_count, 0) as item_count "
    f"from orders_v o left join ({ITEM_TEXT_SQL}) i using (order_id) where o.user_id is not null",
)
def _(s: Store):
    return orders.user_order_documents(s.orders(), s.order_lines(), s.goods()).select(
        "user_id", *orders.HISTORY_COLUMNS, "page", item_text("price_paid").alias("items"),
        F.size("items").alias("item_count"),
    )


@query(
    "admin_orders",
    f"select {O_COLUMNS}, {NAMES_SQL} from orders_v o left join users u using (user_id)",
)
def _(s: Store):
    return orders.admin_orders(s.orders(), s.users())


@query(
    "admin_order_detail",
    f"select o.order_id, o.user_id, cast(o.total as double) as total, o.status, o.ship_address, {NAMES_SQL}, "
    f"i.product_id, i.quantity, i.unit_price, i.product_name, i.image_url from orders_v o left join users u "
    f"using (user_id) left join ({ITEMS_SQL}) i using (order_id)",
)
def _(s: Store):
    return orders.admin_order_detail(s.orders(), s.users(), s.order_lines(), s.goods()).select(
        "order_id", "user_id", "total", "status", "ship_address", "customer_name", "customer_email", "product_id",
        "quantity", "unit_price", "product_name", "image_url",
    )


@query(
    "admin_order_documents",
    f"select o.order_id, {NAMES_SQL}, coalesce(i.items, '') as items from orders_v o left join users u using (user_id) "
    f"left join ({ITEM_TEXT_SQL}) i using (order_id)",
)
def _(s: Store):
    return orders.admin_order_documents(s.orders(), s.users(), s.order_lines(), s.goods()).select(
        "order_id", "customer_name", "customer_email", item_text("unit_price").alias("items")
    )


@query(
    "order_display_bucket",
    f"select order_id, case when status in ({oracle.listed(constants.SETTLED_STATUSES)}) then 'green' else 'yellow' end "
    "as bucket, coalesce(nullif(payment_method, ''), 'N/A') as method_label from orders_v",
)
def _(s: Store):
    return orders.with_display_bucket(s.orders()).select("order_id", "bucket", "method_label")


@query(
    "pending_order_count",
    "select n as pending_count, n > 0 as rose from (select count(*) as n from orders_v "
    f"where status in ({oracle.listed(constants.PENDING_STATUSES)}))",
)
def _(s: Store):
    return orders.pending_order_count(s.orders())


@query("admin_users", "select user_id, username, email, role from users")
def _(s: Store):
    return orders.admin_users(s.users())


@query(
    "user_lookup_by_email",
    "select user_id, username, email, password_hash, coalesce(nullif(role, ''), 'cliente') as role from users "
    f"where email = '{ONE_USER_EMAIL}' limit 1",
)
def _(s: Store):
    return orders.user_by_email(s.users(), ONE_USER_EMAIL)


@query(
    "requests_with_valid_user",
    f"select request_id, user_ref, {oracle.js_int('user_ref')} as user_id from user_header "
    f"where {oracle.js_int('user_ref')} in (select user_id from users)",
)
def _(s: Store):
    return orders.with_valid_user(s.user_headers(), s.users())[0]


@query(
    "requests_without_valid_user",
    f"select request_id, user_ref, {oracle.js_int('user_ref')} as user_id, case when {oracle.js_int('user_ref')} is null "
    f"then 'no_user_id' else 'unknown_user' end as reason from user_header where {oracle.js_int('user_ref')} is null or "
    f"{oracle.js_int('user_ref')} not in (select user_id from users)",
)
def _(s: Store):
    return orders.with_valid_user(s.user_headers(), s.users())[1]


@query(
    "attempt_user_email",
    "select a.reference, a.user_id, cast(a.total as double) as total, u.email as user_email from payment_attempt a "
    "left join users u using (user_id)",
)
def _(s: Store):
    return orders.attach_email(s.payment_attempts(), s.users()).select("reference", "user_id", "total", "user_email")


# --- sales analytics ----------------------------------------------------------------------

KPIS_SQL = (
    f"select cast(coalesce(sum(case when status in {oracle.SOLD} and created_at >= {DAYS_START} then total end), 0) as "
    "double) as total_sales_30_days, count(*) as total_orders, (select count(*) from users) as total_users from orders_v"
)
TOP_SOLD_SQL = (
    "select p.product_id, p.name, cast(sum(l.quantity) as bigint) as units_sold from order_line l join product p "
    f"using (product_id) join orders_v o using (order_id) where o.status in {oracle.SOLD} group by 1, 2 "
    "order by units_sold desc, p.product_id limit 5"
)


@query("sales_kpis", KPIS_SQL)
def _(s: Store):
    return analytics.sales_kpis(s.orders(), s.users(), AS_OF)


@query(
    "daily_sales",
    "select strftime(created_at, '%Y-%m-%d') as sale_day, cast(sum(total) as double) as total_sales from orders_v "
    f"where status in {oracle.SOLD} and created_at >= {DAYS_START} group by 1 order by 1",
)
def _(s: Store):
    return analytics.daily_sales(s.orders(), AS_OF)


@query("top_products_sold", TOP_SOLD_SQL)
def _(s: Store):
    return analytics.top_products_sold(s.order_lines(), s.goods(), s.orders())


@query(
    "top_products_viewed",
    "select p.product_id, p.name, count(v.view_id) as view_count from product_view v join product p using (product_id) "
    "group by 1, 2 order by view_count desc, p.product_id limit 10",
)
def _(s: Store):
    return analytics.top_products_viewed(s.views(), s.goods())


@query(
    "sales_overview",
    "select '{\"kpis\":{\"total_sales_30_days\":' || (select sum(total) from orders_v where status in "
    f"{oracle.SOLD} and created_at >= {DAYS_START}) || ',\"total_orders\":' || (select count(*) from orders_v) || "
    "',\"total_users\":' || (select count(*) from users) || '},\"daily_sales\":[' || (select string_agg("
    "'{\"sale_day\":\"' || d || '\",\"total_sales\":' || t || '}', ',' order by d) from (select "
    f"strftime(created_at, '%Y-%m-%d') as d, sum(total) as t from orders_v where status in {oracle.SOLD} and "
    f"created_at >= {DAYS_START} group by 1)) || '],\"top_products\":[' || (select string_agg('{{\"name\":\"' || name || "
    "'\",\"units_sold\":' || units_sold || '}', ',' order by units_sold desc, product_id) from "
    f"({TOP_SOLD_SQL})) || ']}}' as json",
)
def _(s: Store):
    return tables.to_json_rows(
        analytics.sales_overview(s.orders(), s.users(), s.order_lines(), s.goods(), AS_OF)
    )


# --- content, messages, settings ------------------------------------------------------------


@query("policy_list", "select * from policy order by sort_order nulls first, policy_id")
def _(s: Store):
    return content.content_list(s.policies(), "policy_id")


@query("faq_list", "select * from faq order by sort_order nulls first, faq_id")
def _(s: Store):
    return content.content_list(s.faqs(), "faq_id")


@query("message_list", "select * from contact_message")
def _(s: Store):
    return content.message_list(s.messages())


@query("settings_map", "select setting_key, setting_value from setting")
def _(s: Store):
    return content.settings_map(s.settings()).select(F.explode("settings").alias("setting_key", "setting_value"))


@query(
    "settings_with_defaults",
    "select setting_key, setting_value from setting union all select * from setting_default where setting_key not in "
    "(select setting_key from setting)",
)
def _(s: Store):
    defaults = constants_table(s.spark, constants.setting_defaults(STORE_NAME))
    return content.settings_with_defaults(s.settings(), defaults)


# --- texts ------------------------------------------------------------------------------------

POLICY_LINE = "'- ' || coalesce(title, 'null') || ': ' || coalesce(body, 'null')"
FAQ_LINE = "'- P: ' || coalesce(question, 'null') || chr(10) || '  R: ' || coalesce(answer, 'null')"
PRODUCT_LINE = "'- ID:' || product_id || ', Nombre:' || name || ', Precio:' || unit_price || ', Stock:' || stock"


@query(
    "assistant_context_lines",
    f"select 'policies' as section, policy_id as item_id, {POLICY_LINE} as line from policy union all "
    f"select 'faqs', faq_id, {FAQ_LINE} from faq union all select 'products', product_id, {PRODUCT_LINE} from "
    "(select * from product order by product_id limit 10)",
)
def _(s: Store):
    return text.context_lines(s.policies(), s.faqs(), s.goods()).drop("section_no")


# The instruction cut at its slots; each piece but the first and the last stands between two lists of lines.
CONTEXT_PIECES = [
    oracle.fill(piece.strip("\n"), store=oracle.quoted(STORE_NAME))
    for piece in re.split(r"\{(?:policies|faqs|products)\}", text.ASSISTANT_INSTRUCTION)
]


@query(
    "assistant_context",
    "select cast(1 as bigint) as context_id, row_number() over (order by section, after, item_id) as line_no, line from ("
    + " union all ".join(
        f"select {no} as section, 0 as after, cast(null as bigint) as item_id, {piece} as line"
        for no, piece in enumerate(CONTEXT_PIECES)
    )
    + f" union all select 0, 1, policy_id, {POLICY_LINE} from policy union all select 1, 1, faq_id, {FAQ_LINE} from faq "
    f"union all select 2, 1, product_id, {PRODUCT_LINE} from (select * from product order by product_id limit 10))",
)
def _(s: Store):
    return text.assistant_context(s.policies(), s.faqs(), s.goods(), store_name=STORE_NAME)


@query(
    "assistant_prompts",
    "select message_id, cast(1 as bigint) as context_id, message from contact_message where message <> ''",
)
def _(s: Store):
    return text.assistant_prompts(s.messages()).select("message_id", "context_id", "message")


@query(
    "chat_history_window",
    "select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
)
def _(s: Store):
    return text.chat_history_window(s.raw("conversations"), n=3)


CONFIRMATION_HEAD, _, CONFIRMATION_FOOT = text.CONFIRMATION.partition("{items}")
CONFIRMATION_SLOTS = {
    "name": "o.ship_name", "order": "o.order_id", "store": oracle.quoted(STORE_NAME), "total": oracle.es_number("o.total"),
}
RECIPIENT = "'whatsapp:+57' || regexp_replace(o.ship_phone, '[^0-9]', '', 'g') as recipient"


@query(
    "order_confirmation_text",
    f"select o.order_id, 0 as part, {RECIPIENT}, {oracle.fill(CONFIRMATION_HEAD, **CONFIRMATION_SLOTS)} as body from "
    f"orders_v o union all select o.order_id, 2, {RECIPIENT}, {oracle.fill(CONFIRMATION_FOOT, **CONFIRMATION_SLOTS)} from "
    f"orders_v o union all select o.order_id, 1, {RECIPIENT}, coalesce(i.items, '') from orders_v o left join "
    "(select l.order_id, string_agg('- ' || l.quantity || 'x ' || p.name || ' ($' || "
    + oracle.es_number("l.unit_price")
    + " || ')', chr(10) order by l.product_id, l.quantity, l.unit_price) as items from order_line l join product p "
    "using (product_id) group by 1) i using (order_id)",
)
def _(s: Store):
    return text.order_confirmation_text(s.orders(), s.order_lines(), s.goods(), STORE_NAME)


@query(
    "normalize_phone",
    "select order_id, 'whatsapp:+57' || regexp_replace(ship_phone, '[^0-9]', '', 'g') as recipient from orders_v",
)
def _(s: Store):
    return s.orders().select("order_id", sem.normalize_phone("ship_phone").alias("recipient"))


REPLY_SQL = oracle.fill(text.REPLY_HTML, store=oracle.quoted(STORE_NAME), body="body")


@query(
    "reply_message_body",
    f"select reply_id, recipient, subject, body, 'Re: ' || subject as mail_subject, {REPLY_SQL} as html from reply "
    "where recipient <> '' and subject <> '' and body <> ''",
)
def _(s: Store):
    return text.reply_message_body(s.replies(), STORE_NAME)[0]


@query(
    "format_cop",
    "select product_id, case when v is null then '$ 0' else '$' || chr(160) || translate(format('{:,}', "
    "cast(floor(v + 0.5) as bigint)), ',', '.') end as price_text from (select product_id, case when "
    "trim(coalesce(unit_price, '')) = '' then 0 else try_cast(unit_price as double) end as v from raw_product "
    "union all select p_partkey, p_retailprice * 1000.5 from part)",
)
def _(s: Store):
    texts = s.raw_products().select("product_id", "unit_price")
    amounts = s.raw("part").selectExpr("p_partkey as product_id", "cast(p_retailprice * 1000.5D as string) as unit_price")
    return texts.unionByName(amounts).select("product_id", sem.format_cop("unit_price").alias("price_text"))


# --- checkout ---------------------------------------------------------------------------------


@query("validate_checkout", "select request_id, reason from checkout_verdict")
def _(s: Store):
    good, bad = checkout.validate_checkout(s.checkout_heads(), s.checkout_lines())
    return good.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("request_id", "reason")
    )


@query(
    "price_cart",
    "select request_id, cast(case when known then total end as double) as total, "
    "case when not known then 'unknown_product' end as reason from cart_total",
)
def _(s: Store):
    totals, refused = checkout.price_carts(s.checkout_lines(), s.goods())
    return totals.unionByName(refused, allowMissingColumns=True)


def admitted(s: Store) -> DataFrame:
    """Every order line against the stock, served by order number."""
    return admission.admit_orders(s.order_lines(), s.goods().select("product_id", "stock"), seq="order_id")


def served_sql(need: str, result: str) -> str:
    """Serve orders strictly one by one. ``need`` numbers them 1, 2, ... in column n.

    The table under way is keyed: products hold what is left, -1 the last order served, and -2 - n
    whether order n was accepted.
    """
    return (
        f"with recursive need as materialized ({need}), served(k, v) using key (k) as (select product_id, "
        "cast(stock as bigint) from product union all select -1, cast(0 as bigint) union select k, v from (with turn as (select "
        "n, unnest(items, recursive := true) from need where n = (select v + 1 from recurring.served where k = -1)), now as "
        "(select t.*, s.v as remaining from turn t join recurring.served s on s.k = t.product_id), verdict as (select bool_and(remaining >= need) as ok, min(n) as n from now "
        "having count(*) > 0) select -1 as k, n as v from verdict union all select -2 - n, cast(ok as bigint) from verdict "
        "union all select product_id, cast(greatest(0, remaining - take) as bigint) from now where (select ok from "
        f"verdict))) {result}"
    )


def need_sql(lines: str, *order: str) -> str:
    """Orders numbered by ``order``, the last column of which is the key, each with a list of what it needs."""
    by, key = ", ".join(order), order[-1]
    return (
        f"select cast(row_number() over (order by {by}) as bigint) as n, {key}, items from (select {by}, "
        f"list({{'product_id': product_id, 'need': need, 'take': take}}) as items from (select {by}, product_id, "
        f"max(quantity) as need, sum(quantity) as take from {lines} group by all) group by all)"
    )


@query(
    "admit_orders",
    "select * from ("
    + served_sql(
        need_sql("order_line", "order_id"),
        "select order_id, v = 1 as accepted from need join served on k = -2 - n",
    )
    + ")",
)
def _(s: Store):
    return admitted(s)


@query(
    "apply_stock",
    "select * from ("
    + served_sql(
        need_sql("order_line", "order_id"),
        "select k as product_id, cast(v as int) as stock from served where k >= 0",
    )
    + ")",
)
def _(s: Store):
    """What the admitted orders leave."""
    taken = s.order_lines().join(admitted(s).filter("accepted"), "order_id", "left_semi")
    return checkout.apply_stock(s.goods(), taken).select("product_id", "stock")


@query(
    "resolve_customers",
    "select * from buyer union all select customer_id, first_name, last_name, email from buyer_created",
)
def _(s: Store):
    return checkout.resolve_customers(s.customers(), s.checkout_heads())[0]


@query(
    "customer_of_request",
    "select e.request_id, coalesce(k.customer_id, c.customer_id) as customer_id from checkout_head e left join buyer k "
    "using (email) left join buyer_created c using (email) where coalesce(e.email, '') <> ''",
)
def _(s: Store):
    return checkout.resolve_customers(s.customers(), s.checkout_heads())[1]


def shouting(heads: DataFrame) -> DataFrame:
    """Every other request with its address in capitals."""
    return heads.withColumn("email", F.when(F.col("request_id") % 2 == 0, F.upper("email")).otherwise(F.col("email")))


SHOUTED_SQL = (
    "with shouted as (select request_id, name, case when request_id % 2 = 0 then upper(email) else email end as email from checkout_head where "
    "coalesce(email, '') <> ''), created as (select (select max(customer_id) from buyer) + row_number() over (order by request_id) as customer_id, "
    "coalesce(nullif(name, ''), split_part(email, '@', 1)) as first_name, '' as last_name, email from (select * from shouted where lower(email) not "
    "in (select email from buyer) qualify row_number() over (partition by lower(email) order by request_id) = 1)) "
)


@query("resolve_customers_collated", f"select * from ({SHOUTED_SQL} select * from buyer union all select * from created)")
def _(s: Store):
    return checkout.resolve_customers(s.customers(), shouting(s.checkout_heads()), collation="UNICODE_CI")[0]


@query(
    "customer_of_request_collated",
    f"select * from ({SHOUTED_SQL} select e.request_id, coalesce(k.customer_id, c.customer_id) as customer_id from shouted e left join buyer k on "
    "k.email = lower(e.email) left join created c on lower(c.email) = lower(e.email))",
)
def _(s: Store):
    return checkout.resolve_customers(s.customers(), shouting(s.checkout_heads()), collation="UNICODE_CI")[1]


NEW_ORDERS_SQL = (
    "select v.request_id, (select max(order_id) from orders_v) + row_number() over (order by v.created_at, v.request_id) "
    f"as order_id, v.user_id, cast(t.total as double) as total, case when v.method = {oracle.quoted(constants.CASH_ON_DELIVERY)} "
    f"then {oracle.quoted(constants.STATUS_OF_NEW_CASH_ORDER)} else {oracle.quoted(constants.STATUS_OF_NEW_PAID_ORDER)} end as status, v.method as payment_method, cast(null as varchar) as "
    "payment_ref, v.name as ship_name, v.address as ship_address, v.department as ship_department, v.city as ship_city, "
    "nullif(v.complement, '') as ship_reference, v.phone as ship_phone, v.email as ship_email, v.created_at, "
    "{customer} as customer_id from checkout_verdict v join cart_total t on t.request_id = v.request_id and t.known "
    "{join} where v.reason is null"
)


def new_orders(s: Store) -> tuple[DataFrame, DataFrame]:
    """Orders of all valid, priced requests, as if there were stock for all."""
    good, _ = checkout.validate_checkout(s.checkout_heads(), s.checkout_lines())
    totals, _ = checkout.price_carts(s.checkout_lines(), s.goods())
    _, buyer_of, _ = checkout.resolve_customers(s.customers(), s.checkout_heads())
    made = checkout.build_orders(good, totals, buyer_of, s.orders())
    return made, checkout.build_order_lines(made, checkout.price_items(s.checkout_lines(), s.goods()))


@query(
    "build_orders",
    NEW_ORDERS_SQL.format(
        customer="coalesce(k.customer_id, c.customer_id)",
        join="left join buyer k on k.email = v.email left join buyer_created c on c.email = v.email",
    ),
)
def _(s: Store):
    return new_orders(s)[0]


@query(
    "build_order_lines",
    "select n.order_id, l.product_id, l.quantity, cast(p.unit_price as double) as unit_price from checkout_line l join "
    f"({NEW_ORDERS_SQL.format(customer='cast(0 as bigint)', join='')}) n using (request_id) join product p "
    "using (product_id)",
)
def _(s: Store):
    return new_orders(s)[1]


@query(
    "completed_captures",
    "select h.request_id, c.provider_order_id as payment_ref, 'PayPal' as method from capture c join checkout_head h "
    "using (request_id) where c.status = 'COMPLETED'",
)
def _(s: Store):
    return checkout.completed_captures(s.captures(), s.checkout_heads())[0].select(
        "request_id", "payment_ref", "method"
    )


def placed_need_sql(which: str) -> str:
    return need_sql(
        "(select v.created_at, l.* from checkout_line l join checkout_verdict v using (request_id) join cart_total t "
        f"using (request_id) where v.reason is null and t.known and {which})",
        "created_at",
        "request_id",
    )


@query(
    "capture_paypal_batch",
    f"select a.request_id, cast(t.total as double) as total, {oracle.quoted(constants.PAYPAL)} as payment_method, "
    f"{oracle.quoted(constants.STATUS_OF_NEW_PAID_ORDER)} as status, "
    "c.provider_order_id as payment_ref from ("
    + served_sql(
        placed_need_sql("request_id in (select request_id from capture where status = 'COMPLETED')"),
        "select request_id from need join served on k = -2 - n where v = 1",
    )
    + ") a join cart_total t using (request_id) join capture c using (request_id)",
)
def _(s: Store):
    placed = checkout.capture_paypal_batch(
        s.captures(), s.checkout_heads(), s.checkout_lines(), s.goods(), s.customers(), s.orders()
    )
    return placed.orders.select("request_id", "total", "payment_method", "status", "payment_ref")


PLACED_SQL = (
    "select v.request_id, coalesce(v.reason, case when not t.known then 'unknown_product' when a.v = 1 then 'accepted' else "
    "'out_of_stock' end) as outcome from checkout_verdict v left join cart_total t using (request_id) left join ("
    + served_sql(
        placed_need_sql("true"),
        "select request_id, v from need join served on k = -2 - n",
    )
    + ") a using (request_id)"
)
PLACED_REJECTS_SQL = f"select request_id, outcome as reason from ({PLACED_SQL}) where outcome <> 'accepted'"


@query("place_orders", PLACED_SQL)
def _(s: Store):
    placed = checkout.place_orders(
        s.checkout_heads(), s.checkout_lines(), s.goods(), s.customers(), s.orders()
    )
    return placed.orders.select("request_id", F.lit("accepted").alias("outcome")).unionByName(
        placed.rejects.select("request_id", F.col("reason").alias("outcome"))
    )


def placed_sql(which: str, result: str) -> str:
    """``result`` over the accepted requests ``a``, the buyers ``created`` for them and the orders ``made`` of them."""
    accepted = served_sql(placed_need_sql(which), "select request_id from need join served on k = -2 - n where v = 1")
    return (
        f"select * from (with a as materialized (select * from ({accepted})), first as (select v.* from checkout_verdict v "
        "join a using (request_id) where v.email not in (select email from buyer) qualify row_number() over (partition by "
        "v.email order by v.created_at, v.request_id) = 1), created as materialized (select (select max(customer_id) from "
        "buyer) + row_number() over (order by created_at, request_id) as customer_id, coalesce(nullif(name, ''), "
        "split_part(email, '@', 1)) as first_name, '' as last_name, email from first), made as (select "
        "v.request_id, (select max(order_id) from orders_v) + row_number() over (order by v.created_at, v.request_id) as "
        "order_id, v.user_id, cast(t.total as double) as total, v.email, coalesce(k.customer_id, c.customer_id) as "
        "customer_id from a join checkout_verdict v using (request_id) join cart_total t using (request_id) left join "
        f"buyer k on k.email = v.email left join created c on c.email = v.email) {result})"
    )


PLACED_ORDERS = "select request_id, order_id, user_id, total, email as ship_email, customer_id from made"
PLACED_LINES = (
    "select m.order_id, l.product_id, l.quantity, cast(p.unit_price as double) as unit_price from made m join checkout_line l "
    "using (request_id) join product p using (product_id)"
)
PLACED_STOCK = (
    "select p.product_id, cast(greatest(0, p.stock - coalesce(t.taken, 0)) as int) as stock from product p left join (select "
    "product_id, sum(quantity) as taken from checkout_line join a using (request_id) group by 1) t using (product_id)"
)
PLACED_BUYERS = "select * from buyer union all select * from created"
CAPTURED = "request_id in (select request_id from capture where status = 'COMPLETED')"


def placed(s: Store) -> checkout.Checkout:
    return checkout.place_orders(s.checkout_heads(), s.checkout_lines(), s.goods(), s.customers(), s.orders())


def captured(s: Store) -> checkout.Checkout:
    return checkout.capture_paypal_batch(
        s.captures(), s.checkout_heads(), s.checkout_lines(), s.goods(), s.customers(), s.orders()
    )


PLACED_COLUMNS = ["request_id", "order_id", "user_id", "total", "ship_email", "customer_id"]


@query("place_orders_orders", placed_sql("true", PLACED_ORDERS))
def _(s: Store):
    return placed(s).orders.select(*PLACED_COLUMNS)


@query("place_orders_lines", placed_sql("true", PLACED_LINES))
def _(s: Store):
    return placed(s).lines


@query("place_orders_stock", placed_sql("true", PLACED_STOCK))
def _(s: Store):
    return placed(s).products.select("product_id", "stock")


@query("place_orders_buyers", placed_sql("true", PLACED_BUYERS))
def _(s: Store):
    return placed(s).customers


@query("capture_paypal_orders", placed_sql(CAPTURED, PLACED_ORDERS))
def _(s: Store):
    return captured(s).orders.select(*PLACED_COLUMNS)


@query("capture_paypal_stock", placed_sql(CAPTURED, PLACED_STOCK))
def _(s: Store):
    return captured(s).products.select("product_id", "stock")


@query("total_in_cents", "select order_id, cast(round(total * 100) as bigint) as amount_in_cents from orders_v")
def _(s: Store):
    return s.orders().select("order_id", sem.total_in_cents("total").alias("amount_in_cents"))


@query(
    "amount_2dp",
    "select l_orderkey as order_id, l_partkey as product_id, "
    "cast(cast(round(cast(l_extendedprice * 1.005 as decimal(24,6)), 2) as decimal(18,2)) as double) as amount from lineitem",
)
def _(s: Store):
    return s.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        sem.amount_2dp(F.col("l_extendedprice") * F.lit(1.005)).alias("amount"),
    )


RATE_SQL = "coalesce((select max_by(rate, as_of) from rate where currency = 'USD'), 4000)"


@query(
    "convert_currency",
    f"select order_id, cast(total as double) as total, cast({RATE_SQL} as double) as rate, "
    f"cast(round(total / {RATE_SQL}, 2) as double) as total_usd from orders_v",
)
def _(s: Store):
    return checkout.convert_currency(s.orders().select("order_id", "total"), s.rates())


# --- carts --------------------------------------------------------------------------------------


@query(
    "cart_totals",
    "select user_id, cast(sum(p * q) as double) as subtotal, cast(sum(q) as bigint) as item_count, "
    "cast(sum(p * q) as double) as total from (select user_id, "
    f"cast(coalesce({oracle.js_float('price')}, 0) as decimal(18,2)) as p, coalesce({oracle.js_int('quantity')}, 0) as q "
    "from cart_item) group by 1",
)
def _(s: Store):
    return cart.cart_totals(s.cart_items())


# The log of each user and product, coded as whole numbers and folded strictly in order:
# 0 empties, 1000 + q adds, 2000 + q sets.
CART_STATE_SQL = (
    "select user_id, product_id, cast(q as int) as quantity from (select m.user_id, m.product_id, list_reduce([0] || "
    "m.codes, lambda acc, c: case when c = 0 then 0 when c < 2000 then least(acc + c - 1000, p.stock) when acc > 0 "
    "then least(c - 2000, p.stock) else 0 end) as q from (select user_id, product_id, list(code order by ts, event_id) "
    "as codes from (select user_id, product_id, ts, event_id, case kind when 'add' then 1000 + quantity when 'set' then "
    "2000 + quantity else 0 end as code from cart_event where kind <> 'clear' union all select c.user_id, "
    "u.product_id, c.ts, c.event_id, 0 from cart_event c join (select distinct user_id, product_id from cart_event "
    "where kind <> 'clear') u using (user_id) where c.kind = 'clear') group by 1, 2) m join product p "
    "using (product_id)) where q > 0"
)


@query("cart_state", CART_STATE_SQL)
def _(s: Store):
    return cart.cart_state(s.cart_events(), s.goods())


@query(
    "clean_cart",
    "select cart_id, cast(case cast(cart_id % 6 as int) when 0 then 1 when 4 then 2 else 0 end as int) as item_count, "
    "case cast(cart_id % 6 as int) when 0 then k || 'x' || (cart_id % 9) when 4 then k || 'x' || (cart_id % 9) || ';' "
    "|| k || 'x' || (cart_id % 9) else '' end as items from (select event_id as cart_id, k from ev)",
)
def _(s: Store):
    return cart.clean_cart(s.stored_carts()).select(
        "cart_id",
        F.size("cart").alias("item_count"),
        F.array_join(F.transform("cart", lambda i: F.concat(i["productId"], F.lit("x"), i["quantity"])), ";").alias("items"),
    )


@query(
    "enrich_cart",
    "select l.request_id, l.product_id, l.quantity, coalesce(p.stock, 0) as stock from checkout_line l left join "
    "product p using (product_id)",
)
def _(s: Store):
    return cart.enrich_cart(s.checkout_lines(), s.goods())


# --- payments and other streams, batch twins --------------------------------------------------

PAYMENT_OUTCOME_SQL = (
    "with alive as (select e.*, a.order_id, a.total, case when e.checksum <> 'tampered' and e.event_ts >= a.attempted_at "
    "and e.event_ts < a.attempted_at + interval '30' minute then true else false end as ok from payment_event e left join "
    "payment_attempt a using (reference)), ended as (select reference, min({'t': event_ts, 's': sent_at}) as fin from "
    "alive where ok and status in ('APPROVED', 'DECLINED', 'VOIDED', 'ERROR') group by 1), judged as (select x.*, case "
    "when checksum = 'tampered' then 'bad_signature' when not ok or (fin is not null and {'t': event_ts, 's': sent_at} > "
    "fin) then 'not_found' when status = 'APPROVED' then 'approved' when status in ('DECLINED', 'VOIDED', 'ERROR') then "
    "'closed' else 'waiting' end as outcome from alive x left join ended using (reference)) "
)
MATCH_SQL = PAYMENT_OUTCOME_SQL + (
    "select reference, status, sent_at, event_ts, outcome, case when outcome = 'approved' then order_id end as order_id, "
    "cast(case when outcome = 'approved' then total end as double) as total from judged"
)


@query("match_payments", f"select * from ({MATCH_SQL})")
def _(s: Store):
    return payments.match_payments(s.payment_attempts(), s.payment_events(), TEST_SECRET)


def waiting_sql(approval_ends: bool) -> str:
    """Views ``acts``, ``under_way`` and ``noticed``: each reference's log handled one by one, and each signed event with the attempt it finds.

    ``under_way`` steps through all references at once: its row n holds what waits after a reference's n-th action.
    """
    ends = oracle.listed([*([constants.APPROVED] if approval_ends else []), *constants.CLOSING_STATUSES])
    return (
        "acts as materialized (select *, row_number() over (partition by reference order by moment, kind, t0, t1) as n from ("
        "select reference, attempted_at + interval '30' minute as moment, 0 as kind, attempt_id as t0, 0 as t1, cast(null as varchar) as "
        "status from stored_put union all select reference, attempted_at, 1, attempt_id, 0, null from stored_put union all "
        "select reference, event_ts, 2, sent_at, event_id, status from payment_notice where ok)), "
        "under_way as (select reference, cast(0 as bigint) as n, cast(null as bigint) as held, cast(null as bigint) as found "
        "from (select distinct reference from acts) union all select a.reference, a.n, case a.kind when 0 then null when 1 then a.t0 "
        f"else case when a.status in ({ends}) then null else u.held end end, u.held from under_way u join acts a on a.reference = u.reference and "
        "a.n = u.n + 1), noticed as materialized (select e.*, u.found from under_way u join acts a using (reference, n) join payment_notice e "
        "on e.event_id = a.t1 where a.kind = 2)"
    )


@query(
    "match_payments_log",
    f"select * from (with recursive {waiting_sql(True)} select event_id, reference, case when found is null then 'not_found' when status = "
    f"'APPROVED' then 'approved' when status in ({oracle.listed(constants.CLOSING_STATUSES)}) then 'closed' else 'waiting' end as outcome, "
    "found as attempt_id from noticed)",
)
def _(s: Store):
    """Attempts stored anew, events delivered twice or at one instant: which attempt each signed event finds."""
    good, _ = payments.signed_events(s.payment_notices(), TEST_SECRET)
    found = payments.attempts_in_force(
        payments.valid_attempts(s.payment_puts())[0], good, constants.PAYMENT_LIFETIME_MINUTES, True,
        kept=["event_id", "reference", "status"], held=["attempt_id"],
    )
    return found.select(
        "event.event_id", "event.reference",
        F.when(F.col("attempt").isNull(), F.lit("not_found"))
        .when(F.col("event.status") == constants.APPROVED, F.lit("approved"))
        .when(F.col("event.status").isin(constants.CLOSING_STATUSES), F.lit("closed"))
        .otherwise(F.lit("waiting")).alias("outcome"),
        "attempt.attempt_id",
    )


def settled_sql(result: str) -> str:
    """``result`` over all approvals served one by one, in ``tried``: v tells whether one became an order.

    The table under way holds what is left of each product, -1 the last approval served, -2 - 2n the answer to the n-th, and
    -3 - 2a a row once attempt a became an order.
    """
    return (
        f"select * from (with recursive {waiting_sql(False)}, turns as materialized (select cast(row_number() over (order by event_ts, sent_at, event_id) as "
        "bigint) as n, event_id, found, needs from noticed join (select attempt_id as found, list({'product_id': product_id, 'need': need, 'take': "
        "take}) as needs from (select attempt_id, i.product_id as product_id, max(i.quantity) as need, sum(i.quantity) as take from (select attempt_id, "
        "unnest(items) as i from stored_put) group by all) group by 1) using (found) where status = 'APPROVED' and coalesce(customer_email, '') <> ''), "
        "served(k, v) using key (k) as (select product_id, cast(stock as bigint) from product union all select -1, cast(0 as bigint) union "
        "select k, v from (with turn as (select n, found, unnest(needs, recursive := true) from turns where n = (select v + 1 from "
        "recurring.served where k = -1)), now as (select t.*, coalesce(s.v, 0) as remaining, s.k is not null as known from turn t left join "
        "recurring.served s on s.k = t.product_id), verdict as (select bool_and(known and remaining >= need) and max(found) not in (select "
        "(-3 - k) // 2 from recurring.served where k <= -3 and k % 2 <> 0) as ok, min(n) as n, max(found) as a from now having count(*) > 0) "
        "select -1 as k, n as v from verdict union all select -2 - 2 * n, cast(ok as bigint) from verdict union all select -3 - 2 * a, 1 from verdict "
        "where ok union all select product_id, cast(greatest(0, remaining - take) as bigint) from now where (select ok from verdict))), "
        "tried as materialized (select t.*, s.v from turns t join served s on s.k = -2 - 2 * t.n), "
        "won as materialized (select e.*, t.n, p.items, p.total, p.user_id, coalesce(nullif(e.full_name, ''), nullif(p.full_name, ''), "
        f"{oracle.quoted(constants.NAMELESS_PAYER)}) as name, coalesce(nullif(e.phone_number, ''), p.phone) as payer_phone from tried t join noticed e using (event_id) join "
        "stored_put p on p.attempt_id = t.found where t.v = 1), created as materialized (select (select max(customer_id) from buyer) + "
        "row_number() over (order by n) as customer_id, coalesce(nullif(name, ''), split_part(customer_email, '@', 1)) as first_name, '' as last_name, "
        "customer_email as email from (select * from won where customer_email not in (select email from buyer) qualify row_number() over "
        "(partition by customer_email order by n) = 1)), made as materialized (select (select max(order_id) from orders_v) + row_number() over "
        "(order by n) as order_id, w.*, coalesce(k.customer_id, c.customer_id) as customer_id from won w left join buyer k on k.email = "
        f"w.customer_email left join created c on c.email = w.customer_email) {result})"
    )


SETTLED_ORDERS = (
    f"select order_id, user_id, cast(total as double) as total, {oracle.quoted(constants.STATUS_OF_NEW_PAID_ORDER)} as status, "
    f"{oracle.quoted(constants.WOMPI)} as payment_method, reference as payment_ref, name as ship_name, trim(coalesce(address_line_1, '') || ' ' || "
    "coalesce(address_line_2, '')) as ship_address, region as ship_department, city as ship_city, cast(null as varchar) as ship_reference, "
    "payer_phone as ship_phone, customer_email as ship_email, event_ts as created_at, customer_id from made"
)
SETTLED_OUTCOMES = (
    "select e.event_id, e.reference, case when n.event_id is null then 'bad_signature' when n.found is null or w.n is not null and "
    "(n.event_ts, n.sent_at, n.event_id) > (w.event_ts, w.sent_at, w.event_id) then 'not_found' when n.event_id = w.event_id then 'approved' when "
    f"n.status = 'APPROVED' then 'failed' when n.status in ({oracle.listed(constants.CLOSING_STATUSES)}) then 'closed' else 'waiting' end as outcome, "
    "case when n.event_id = w.event_id then m.order_id end as order_id from payment_notice e left join noticed n using (event_id) left join won w on "
    "w.found = n.found left join made m on m.event_id = n.event_id"
)


def settled(s: Store) -> payments.Settlement:
    stored, _ = payments.valid_attempts(s.payment_puts())
    return payments.settle_payments(stored, s.payment_notices(), TEST_SECRET, s.goods(), s.customers(), s.orders())


@query("settle_payments_orders", settled_sql(SETTLED_ORDERS))
def _(s: Store):
    return settled(s).orders


@query(
    "settle_payments_lines",
    settled_sql(
        "select order_id, i.product_id as product_id, i.quantity as quantity, cast(i.price as double) as unit_price from (select order_id, "
        "unnest(items) as i from made)"
    ),
)
def _(s: Store):
    return settled(s).lines


@query(
    "settle_payments_stock",
    settled_sql("select k as product_id, cast(v as int) as stock from served where k >= 0"),
)
def _(s: Store):
    return settled(s).products.select("product_id", "stock")


@query("settle_payments_buyers", settled_sql("select * from buyer union all select * from created"))
def _(s: Store):
    return settled(s).customers


@query("settle_payments_outcomes", settled_sql(SETTLED_OUTCOMES))
def _(s: Store):
    return settled(s).outcomes


@query(
    "verify_signature",
    "select reference, sent_at, case when checksum = sha256(reference || amount_in_cents || currency || status || sent_at "
    f"|| '{TEST_SECRET}') then 'ok' else 'bad_signature' end as verdict from payment_event",
)
def _(s: Store):
    return payments.verify_signature(s.payment_events(), TEST_SECRET).select("reference", "sent_at", "verdict")


@query(
    "payment_attempts",
    "select reference, case when total is null or len(items) = 0 then 'missing_field' when len(list_filter(items, lambda "
    "i: i.product_id is null or i.quantity <= 0)) > 0 then 'bad_item' end as reason from raw_attempt",
)
def _(s: Store):
    good, bad = payments.valid_attempts(s.raw_attempts())
    return good.select("reference", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("reference", "reason")
    )


@query(
    "read_payment_events",
    "select reference, status, amount_in_cents, currency, sent_at, checksum, reference || '@example.com' as "
    "customer_email from payment_event",
)
def _(s: Store):
    parsed = tables.parse_requests(s.webhook_messages(), "message", schemas.PAYMENT_WEBHOOK)
    return tables.payment_events(parsed).select(
        "reference", "status", "amount_in_cents", "currency", "sent_at", "checksum", "customer_email"
    )


VIEWS_SQL = (
    "select view_id, cast(product_id as bigint) as product_id, viewed_at from view_request "
    "where try_cast(product_id as bigint) in (select product_id from product)"
)
REVIEWS_SQL = "select * from review_request where name <> '' and comment <> '' and rating between 1 and 5"
CONTACTS_SQL = (
    "select request_id, name, email, nullif(subject, '') as subject, message, created_at from contact_request "
    "where name <> '' and email <> '' and message <> ''"
)


@query("ingest_views", VIEWS_SQL)
def _(s: Store):
    return ingest.valid_views(s.view_requests(), s.goods())


@query("ingest_reviews", REVIEWS_SQL)
def _(s: Store):
    return maintenance.valid_reviews(s.review_requests())[0]


@query("ingest_contacts", CONTACTS_SQL)
def _(s: Store):
    return maintenance.valid_contacts(s.contact_requests())[0]


@query(
    "pending_monitor",
    "select * from (with looks as (select cast(floor(epoch(changed_at) / 30) + 1 as bigint) * 30 as sec, sum(delta) as d from "
    "pending_change group by 1), run as (select sec, d, sum(d) over (order by sec) as c from looks) select cast(to_timestamp(sec) at time zone "
    "'UTC' as timestamp) as poll_at, cast(c as bigint) as pending_count, cast(c - d as bigint) as previous_count, "
    "c > 0 and c > c - d as alert from run)",
)
def _(s: Store):
    return monitor.pending_monitor(s.pending_changes())


# --- table maintenance ---------------------------------------------------------------------------

REVIEW_COLUMNS = "review_id, product_id, user_id, reviewer_name, rating, comment, created_at"


@query(
    "add_reviews",
    f"select {REVIEW_COLUMNS} from review union all select (select max(review_id) from review) + row_number() over "
    "(order by request_id), product_id, user_id, name, rating, comment, created_at from review_request "
    "where name <> '' and comment <> '' and rating between 1 and 5",
)
def _(s: Store):
    return maintenance.add_reviews(s.reviews(), s.review_requests())[0]


@query(
    "add_reviews_rejects",
    "select request_id, case when name = '' or comment is null or rating = 0 then 'missing_field' else "
    "'rating_out_of_range' end as reason from review_request where name = '' or comment is null or rating not between "
    "1 and 5",
)
def _(s: Store):
    return maintenance.add_reviews(s.reviews(), s.review_requests())[1].select("request_id", "reason")


@query(
    "add_contacts",
    "select * from contact_message union all select (select max(message_id) from contact_message) + row_number() over "
    "(order by request_id), name, email, nullif(subject, ''), message, created_at, 'unread', false from contact_request "
    "where name <> '' and email <> '' and message <> ''",
)
def _(s: Store):
    return maintenance.add_contacts(s.messages(), s.contact_requests())[0]


PRODUCT_REQUEST_SQL = (
    "with judged as (select *, case when name = '' then 'missing_field' when unit_price = 'abc' or unit_price = '-5' or "
    "category_id = 'x' then 'bad_number' end as reason from product_request), firsts as (select * from judged where "
    "reason is null and (barcode = '' or barcode not in (select barcode from product)) qualify barcode = '' or "
    "row_number() over (partition by barcode order by position) = 1) "
)
P_LIST = (
    "product_id, name, description, unit_price, brand, barcode, category_id, stock, image_url, image_url_2, image_url_3, "
    "image_url_4, image_url_5"
)


@query(
    "create_products",
    f"{TABLE_P} union all select * from ({PRODUCT_REQUEST_SQL} select (select max(product_id) from product) + "
    "row_number() over (order by position), name, null, cast(unit_price as double), brand, nullif(barcode, ''), "
    f"cast({oracle.js_int('category_id')} as int), cast({oracle.js_int('stock')} as int), null, null, null, null, null "
    "from firsts)",
)
def _(s: Store):
    return maintenance.create_products(s.products(), s.product_requests())[0]


@query(
    "create_products_rejects",
    f"select * from ({PRODUCT_REQUEST_SQL} select position, coalesce(reason, 'duplicate_barcode') as reason from judged "
    "where position not in (select position from firsts))",
)
def _(s: Store):
    return maintenance.create_products(s.products(), s.product_requests())[1]


@query(
    "update_products",
    "select p.product_id, coalesce(e.name, p.name) as name, case when e.position is not null then null else "
    "p.description end as description, cast(case when e.position is not null then cast(e.unit_price as decimal(18,2)) "
    "else p.unit_price end as double) as unit_price, coalesce(e.brand, p.brand) as brand, coalesce(e.barcode, p.barcode) "
    "as barcode, case when e.position is null then p.category_id end as category_id, case when e.position is not null "
    "then cast(e.stock as int) else p.stock end as stock, "
    + ", ".join(
        f"case when e.position is null then p.{c} end as {c}"
        for c in ("image_url", "image_url_2", "image_url_3", "image_url_4", "image_url_5")
    )
    + " from product p left join newest_edit e using (product_id)",
)
def _(s: Store):
    return maintenance.update_products(s.products(), s.product_edits())[0]


@query(
    "update_products_rejects",
    "select position, product_id, case when name = '' then 'missing_field' when product_id not in (select product_id from "
    "product) then 'not_found' else 'duplicate_barcode' end as reason from product_edit where position not in "
    "(select position from edit_standing)",
)
def _(s: Store):
    return maintenance.update_products(s.products(), s.product_edits())[1]


# A draft of every product, never sold; ids to delete are those of products, of drafts, and of neither.
DRAFT = 1_000_000_000
PRODUCTS_AND_DRAFTS = f"(select * from product union all select * replace (product_id + {DRAFT} as product_id) from product)"
DELETE_IDS = f"(select p_partkey * 2 as product_id from part union all select p_partkey * 2 + {DRAFT} from part)"


def products_and_drafts(s: Store) -> DataFrame:
    drafts = s.products().withColumn("product_id", F.col("product_id") + DRAFT)
    return s.products().unionByName(drafts)


def doomed_products(s: Store) -> DataFrame:
    return s.raw("part").selectExpr(f"explode(array(p_partkey * 2, p_partkey * 2 + {DRAFT})) as product_id")


@query(
    "delete_products",
    f"select {P_COLUMNS} from {PRODUCTS_AND_DRAFTS} p where product_id not in {DELETE_IDS} or product_id in "
    "(select product_id from order_line)",
)
def _(s: Store):
    return maintenance.delete_products(products_and_drafts(s), doomed_products(s), s.order_lines())[0]


@query(
    "delete_products_rejects",
    f"select product_id, case when product_id in (select product_id from {PRODUCTS_AND_DRAFTS}) then 'referenced' else "
    f"'not_found' end as reason from {DELETE_IDS} where product_id not in (select product_id from {PRODUCTS_AND_DRAFTS}) "
    "or product_id in (select product_id from order_line)",
)
def _(s: Store):
    return maintenance.delete_products(products_and_drafts(s), doomed_products(s), s.order_lines())[1]


@query(
    "register_users",
    "select * from users union all select (select max(user_id) from users) + row_number() over (order by position), "
    "username, email, password_hash, 'cliente' from registered",
)
def _(s: Store):
    return maintenance.register_users(s.users(), s.customers(), s.registrations())[0]


@query(
    "register_users_customers",
    "select * from buyer union all select (select max(customer_id) from buyer) + row_number() over (order by position), "
    "username, '', email from registered where email not in (select email from buyer)",
)
def _(s: Store):
    return maintenance.register_users(s.users(), s.customers(), s.registrations())[1]


@query(
    "register_users_rejects",
    "select position, email, case when username = '' or password_length < 6 then 'invalid_registration' else 'email_taken' "
    "end as reason from registration where position not in (select position from registered)",
)
def _(s: Store):
    return maintenance.register_users(s.users(), s.customers(), s.registrations())[2]


def update_sql(table: str, changes: str, key: str, columns: list[str], where: str = "true") -> str:
    """Last valid change per key wins."""
    replaced = ", ".join(f"case when c.{key} is not null then c.{x} else t.{x} end as {x}" for x in columns)
    return (
        f"select t.* replace ({replaced}) from {table} t left join (select * from {changes} where {where} "
        f"qualify row_number() over (partition by {key} order by position desc) = 1) c using ({key})"
    )


@query("set_user_role", update_sql("users", "role_change", "user_id", ["role"], "role in ('admin', 'cliente')"))
def _(s: Store):
    return maintenance.set_user_role(s.users(), s.role_changes())[0]


@query(
    "set_user_role_rejects",
    "select position, user_id, role, case when role = 'root' then 'bad_role' else 'not_found' end as reason from role_change "
    "where role = 'root' or user_id not in (select user_id from users)",
)
def _(s: Store):
    return maintenance.set_user_role(s.users(), s.role_changes())[1]


DOOMED_USERS = "(select c_custkey * 2 as user_id from customer)"


def doomed_users(s: Store) -> DataFrame:
    return s.raw("customer").selectExpr("c_custkey * 2 as user_id")


@query(
    "delete_users",
    f"select * from users where user_id not in {DOOMED_USERS} or user_id in (select user_id from orders_v where user_id "
    "is not null)",
)
def _(s: Store):
    return maintenance.delete_users(s.users(), doomed_users(s), s.orders())[0]


@query(
    "delete_users_rejects",
    f"select user_id, case when user_id in (select user_id from users) then 'referenced' else 'not_found' end as reason from "
    f"{DOOMED_USERS} where user_id not in (select user_id from users) or user_id in (select user_id from orders_v where "
    "user_id is not null)",
)
def _(s: Store):
    return maintenance.delete_users(s.users(), doomed_users(s), s.orders())[1]


@query(
    "set_order_status",
    "select order_id, status, created_at from ("
    + update_sql("orders_v", "status_change", "order_id", ["status"], "status <> 'Perdido'")
    + ")",
)
def _(s: Store):
    return maintenance.set_order_status(s.orders(), s.status_changes())[0].select("order_id", "status", "created_at")


@query(
    "set_order_status_rejects",
    "select position, order_id, status, case when status = 'Perdido' then 'bad_status' else 'not_found' end as reason from "
    "status_change where status = 'Perdido' or order_id not in (select order_id from orders_v)",
)
def _(s: Store):
    return maintenance.set_order_status(s.orders(), s.status_changes())[1]


@query(
    "set_message_status",
    update_sql("contact_message", "message_change", "message_id", ["status"], "status <> 'spam'"),
)
def _(s: Store):
    changes = s.message_changes().drop("is_starred")
    return maintenance.set_message_status(s.messages(), changes)[0]


@query("star_messages", update_sql("contact_message", "message_change", "message_id", ["is_starred"]))
def _(s: Store):
    return maintenance.star_messages(s.messages(), s.message_changes().drop("status"))[0]


@query(
    "delete_messages",
    "select * from contact_message where message_id not in (select conv_id * 2000 from conversations)",
)
def _(s: Store):
    ids = s.raw("conversations").selectExpr("conv_id * 2000 as message_id")
    return maintenance.delete_messages(s.messages(), ids)[0]


CLEAN_SETTING = "coalesce(regexp_replace(setting_value, '^\\s+|\\s+$', '', 'g'), '')"
STRICT_RULE = (
    f"not (setting_key like 'color%' and setting_value is not null and not regexp_matches(setting_value, "
    f"'{maintenance.COLOUR_PATTERN}')) and not (setting_key like 'social%' and coalesce(setting_value, '') <> '' and setting_value "
    "not like 'http%')"
)


def settings_sql(rule: str) -> str:
    return (
        f"select setting_key, coalesce(n.value, s.setting_value) as setting_value from setting s full join (select "
        f"setting_key, max_by({CLEAN_SETTING}, position) as value from setting_change where setting_key <> 'unknownKey' "
        f"and {rule} group by 1) n using (setting_key)"
    )


@query("upsert_settings", settings_sql("true"))
def _(s: Store):
    return maintenance.upsert_settings(s.settings(), s.setting_changes())[0]


@query("upsert_settings_strict", settings_sql(STRICT_RULE))
def _(s: Store):
    return maintenance.upsert_settings(s.settings(), s.setting_changes(), strict=True)[0]


@query(
    "upsert_settings_strict_rejects",
    "select position, setting_key, setting_value, case when setting_key = 'unknownKey' then 'unknown_key' when setting_key "
    f"like 'color%' then 'bad_colour' else 'bad_link' end as reason from setting_change where not (setting_key <> "
    f"'unknownKey' and {STRICT_RULE})",
)
def _(s: Store):
    return maintenance.upsert_settings(s.settings(), s.setting_changes(), strict=True)[1]


@query(
    "create_policies",
    "select * from policy union all select (select max(policy_id) from policy) + row_number() over (order by page_id), url, "
    "html, null from pages",
)
def _(s: Store):
    new = s.raw("pages").selectExpr("page_id as position", "url as title", "html as body")
    return maintenance.create_content(s.policies(), new, "policy_id")


@query(
    "create_faqs",
    "select * from faq union all select (select max(faq_id) from faq) + row_number() over (order by doc_id), source, text, "
    "null from documents",
)
def _(s: Store):
    new = s.raw("documents").selectExpr("doc_id as position", "source as question", "text as answer")
    return maintenance.create_content(s.faqs(), new, "faq_id")


@query("update_policies", update_sql("policy", "policy_edit", "policy_id", ["title", "body"]))
def _(s: Store):
    edits = maintenance.edits_from_lists(s.policy_edit_lists(), "policies", "request_id")
    return maintenance.update_content(s.policies(), edits, "policy_id")


@query("update_faqs", update_sql("faq", "faq_edit", "faq_id", ["question", "answer"]))
def _(s: Store):
    return maintenance.update_content(s.faqs(), s.faq_edits(), "faq_id")


@query("delete_policies", "select * from policy where policy_id not in (select page_id * 2 from pages)")
def _(s: Store):
    ids = s.raw("pages").selectExpr("page_id * 2 as policy_id")
    return maintenance.delete_content(s.policies(), ids, "policy_id")


@query("delete_faqs", "select * from faq where faq_id not in (select conv_id * 2000 from conversations)")
def _(s: Store):
    ids = s.raw("conversations").selectExpr("conv_id * 2000 as faq_id")
    return maintenance.delete_content(s.faqs(), ids, "faq_id")


# --- sources and sinks -----------------------------------------------------------------------------


@query(
    "result_as_json",
    "select '{\"order_id\":' || order_id || ',\"user_id\":' || coalesce(cast(user_id as varchar), 'null') || "
    "',\"total\":' || total || ',\"status\":\"' || status || '\"}' as json from orders_v",
)
def _(s: Store):
    return tables.to_json_rows(s.orders().select("order_id", "user_id", "total", "status"))


@query("read_requests", "select event_id, k from ev")
def _(s: Store):
    return tables.parse_requests(s.raw("events").select("event_id", "props"), "props", "k BIGINT")
