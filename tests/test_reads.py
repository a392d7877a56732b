from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from retail_spark import constants, schemas
from retail_spark.operators import analytics, catalog, content, monitor, orders, text
from retail_spark.operators.checkout import resolve_customers
from retail_spark.operators.maintenance import register_users


def products(spark, n=6):
    return spark.createDataFrame(
        [(i, f"p{i}", "d" * 80 if i == 1 else None, D(i), "b", None, 1, i - 1, "u1" if i == 1 else "", None, "u3" if i < 3 else None, None, None)
         for i in range(1, n + 1)],
        schemas.TABLES["product"],
    )


def reviews(spark, ratings):
    return spark.createDataFrame(
        [(i, p, None, "n", r, "c", datetime(2024, 1, i)) for i, (p, r) in enumerate(ratings, 1)], schemas.TABLES["review"]
    )


def views(spark, ids):
    return spark.createDataFrame([(i, p, datetime(2024, 1, 1)) for i, p in enumerate(ids)], schemas.TABLES["product_view"])


def test_unrated_products_read_zero_in_the_catalogue_and_null_when_featured(spark, rows):
    p, r = products(spark), reviews(spark, [(1, 4), (1, 5)])
    assert rows(catalog.catalog_with_ratings(p, r, 2), "product_id", "average_rating", "review_count") == [(1, 4.5, 2), (2, 0.0, 0)]
    top = catalog.featured_products(p, r, views(spark, [3, 1, 3, 99]))
    assert rows(top, "product_id", "view_count", "average_rating", "review_count") == [(1, 1, 4.5, 2), (3, 2, None, 0)]
    fallback = catalog.featured_products(p, r, views(spark, []))
    assert rows(fallback, "product_id", "average_rating", "review_count") == [(1, 4.5, 2), (2, 0.0, 0), (3, 0.0, 0), (4, 0.0, 0)]


def test_ties_go_to_the_smaller_id(spark, rows):
    top = analytics.top_products_viewed(views(spark, [5, 4, 3, 2]), products(spark), 2)
    assert rows(top, "product_id") == [(2,), (3,)]


@pytest.mark.parametrize("limit", [None, 0, -3])
def test_no_limit(spark, limit):
    assert catalog.catalog_with_ratings(products(spark), reviews(spark, []), limit).count() == 6


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(ValueError):
        catalog.product_by_id(products(spark), "abc")
    assert catalog.product_by_id(products(spark), "").count() == 0
    assert catalog.product_by_id(products(spark), "3").count() == 1
    assert catalog.product_by_id(products(spark), " 3.0e0 ").count() == 1
    assert catalog.product_by_id(products(spark), "1.5").count() == 0
    with pytest.raises(ValueError):
        catalog.product_by_id(products(spark), "1_0")


def test_shown_parts(spark, rows):
    p = products(spark, 3)
    assert rows(catalog.carousel(p, 2), "product_id", "blurb") == [(1, "d" * 70 + "..."), (2, constants.CAROUSEL_BLURB)]
    assert rows(catalog.with_stock_status(p), "product_id", "out_of_stock") == [(1, True), (2, False), (3, False)]
    got = {r.product_id: (r.images, r.main_image) for r in catalog.with_gallery(p).collect()}
    assert got == {1: (["u1", "u3"], "u1"), 2: (["u3"], "u3"), 3: ([], constants.GALLERY_PLACEHOLDER)}


def order_rows(spark):
    data = [
        (1, 1, 100, "Pagado", datetime(2024, 4, 30)), (2, 1, 50, "Enviado", datetime(2024, 3, 31)), (3, None, 25, "Entregado", datetime(2024, 4, 1)),
        (4, 2, 9, "Cancelado", datetime(2024, 4, 30)), (5, 2, 7, "Pagado", datetime(2024, 6, 1)),
    ]
    return spark.createDataFrame(
        [(i, u, D(t), s, "", None, f"guest{i}", *[None] * 5, f"g{i}@x", at, None) for i, u, t, s, at in data], schemas.TABLES["orders"]
    )


def user_rows(spark):
    return spark.createDataFrame([(1, "ana", "a@x", "h", ""), (2, "bea", "b@x", "h", "admin")], schemas.TABLES["users"])


def test_sales_window_starts_at_midnight_and_has_no_end(spark, rows):
    o = order_rows(spark)
    assert rows(analytics.sales_kpis(o, user_rows(spark), date(2024, 5, 1))) == [(D("132.00"), 5, 2)]
    assert rows(analytics.daily_sales(o, date(2024, 5, 1)), "sale_day") == [("2024-04-01",), ("2024-04-30",), ("2024-06-01",)]
    nothing = analytics.sales_kpis(o.filter("false"), user_rows(spark), date(2024, 5, 1))
    assert rows(nothing) == [(D("0.00"), 0, 2)]


def test_guest_orders_show_the_delivery_name(spark, rows):
    named = orders.admin_orders(order_rows(spark), user_rows(spark))
    assert rows(named, "order_id", "customer_name", "customer_email")[2] == (3, "guest3", "g3@x")
    assert [r.order_id for r in named.collect()] == [5, 4, 1, 3, 2]


def test_one_users_lines_are_cut_before_products_are_joined(spark):
    lines = spark.createDataFrame([(1, 1, 2, D(5))], schemas.TABLES["order_line"])
    plan = orders.user_order_history(order_rows(spark), lines, products(spark), user_id=1)
    text_plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text_plan and text_plan.index("LeftSemi") > text_plan.index("Inner")  # deeper in the tree


def test_history_keeps_orders_whose_products_are_gone(spark, rows):
    lines = spark.createDataFrame([(1, 1, 2, D(5)), (2, 77, 1, D(5))], schemas.TABLES["order_line"])
    flat = orders.user_order_history(order_rows(spark), lines, products(spark), user_id=1)
    assert rows(flat, "order_id", "product_id", "quantity") == [(1, 1, 2), (2, None, None)]
    nested = orders.user_order_documents(order_rows(spark), lines, products(spark), user_id=1)
    assert [(r.order_id, len(r["items"])) for r in nested.collect()] == [(1, 1), (2, 0)]


def test_an_account_with_most_orders_spans_partitions(spark):
    """All users' histories: one user has two thirds of 3000 orders, and partitions follow each other in order."""
    heads = spark.range(3000).selectExpr(
        "id as order_id", "case when id % 3 < 2 then 7 else id % 50 end as user_id", "cast(1 as decimal(18,2)) as total", "'Pagado' as status",
        "'x' as payment_method", "cast(null as string) as payment_ref",
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7919 % 1000 as int)) as created_at",
    )
    lines = spark.range(3000).selectExpr("id as order_id", "cast(1 as bigint) as product_id", "1 as quantity", "cast(1 as decimal(18,2)) as unit_price")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for history in (orders.user_order_history, orders.user_order_documents):
            got = history(heads, lines, products(spark)).select("user_id", "created_at", "order_id", F.spark_partition_id().alias("p")).collect()
            assert len({r.p for r in got if r.user_id == 7}) > 1
            expected = sorted(got, key=lambda r: (r.user_id, -r.created_at.timestamp(), -r.order_id))
            assert [r.order_id for r in sorted(got, key=lambda r: r.p)] == [r.order_id for r in expected]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_addresses_and_names_under_a_collation(spark, rows):
    users = spark.createDataFrame([(1, "a", "Ana@X.co", "h", ""), (2, "b", "ána@x.co", "h", "admin")], schemas.TABLES["users"])
    assert rows(orders.user_by_email(users, "ana@x.co"), "user_id") == []
    assert rows(orders.user_by_email(users, "ana@x.co", "UNICODE_CI"), "user_id") == [(1,)]
    assert rows(orders.user_by_email(users.filter("user_id = 2"), "ANA@x.co", "UNICODE_CI_AI"), "user_id") == [(2,)]
    names = spark.createDataFrame([(1, "zinc"), (2, "Éter"), (3, "eje"), (4, "Faro")], schemas.TABLES["category"])
    assert [r.name for r in catalog.category_list(names).collect()] == ["Faro", "eje", "zinc", "Éter"]
    assert [r.name for r in catalog.category_list(names, "UNICODE_CI").collect()] == ["eje", "Éter", "Faro", "zinc"]
    customers = spark.createDataFrame([(9, "n", "", "ANA@x.co")], schemas.TABLES["customer"])
    requests = spark.createDataFrame([(1, "x", "ana@X.co"), (2, "y", "new@x"), (3, "z", "NEW@x")], "request_id bigint, name string, email string")
    everyone, found, _ = resolve_customers(customers, requests, collation="UNICODE_CI")
    assert rows(found) == [(1, 9), (2, 10), (3, 10)] and rows(everyone, "customer_id", "email") == [(10, "new@x"), (9, "ANA@x.co")]
    assert rows(resolve_customers(customers, requests)[1], "customer_id") == [(10,), (11,), (12,)]
    new = spark.createDataFrame([(1, "a", "ANA@x.co", 8, "h"), (2, "b", "B@x", 8, "h"), (3, "c", "b@X", 8, "h")],
                                "position bigint, username string, email string, password_length int, password_hash string")
    _, _, rejects = register_users(users, customers, new, collation="UNICODE_CI")
    assert rows(rejects, "position", "reason") == [(1, "email_taken"), (3, "email_taken")]


def test_badges_and_lookup(spark, rows):
    o = order_rows(spark)
    assert rows(orders.with_display_bucket(o), "order_id", "bucket", "method_label")[:2] == [(1, "green", "N/A"), (2, "yellow", "N/A")]
    assert rows(orders.pending_order_count(o)) == [(0, False)]
    assert rows(orders.pending_order_count(o, ["Cancelado"], 1)) == [(1, False)]
    assert rows(orders.user_by_email(user_rows(spark), "a@x"), "user_id", "role") == [(1, "cliente")]
    assert "password_hash" not in orders.admin_users(user_rows(spark)).columns


def test_content_without_place_comes_first(spark):
    df = spark.createDataFrame([(1, "a", "x", 2), (2, "b", "x", None), (3, "c", "x", 1), (4, "d", "x", 1)], schemas.TABLES["policy"])
    assert [r.policy_id for r in content.content_list(df, "policy_id").collect()] == [2, 3, 4, 1]


def test_context_lines_join_to_the_instruction(spark):
    policies = spark.createDataFrame([(1, "T", None)], "policy_id bigint, title string, body string")
    faqs = spark.createDataFrame([], "faq_id bigint, question string, answer string")
    got = text.assistant_context(policies, faqs, products(spark, 2), n=1).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(1, len(got) + 1))
    assert "\n".join(r.line for r in got) == text.ASSISTANT_INSTRUCTION.format(
        store=constants.STORE_NAME, policies="- T: null", faqs="", products="- ID:1, Nombre:p1, Precio:1.00, Stock:0"
    )


def test_confirmation_parts_join_to_the_message(spark, monkeypatch):
    lines = spark.createDataFrame([(2, p, 1, D(p)) for p in range(1, 7)], schemas.TABLES["order_line"])
    monkeypatch.setattr(text, "nest_items", lambda *a: orders.nest_items(*a, page_size=4))
    got = text.order_confirmation_text(order_rows(spark).filter("order_id <= 2"), lines, products(spark), "S").collect()
    parts = sorted((r.part, r.body) for r in got if r.order_id == 2)
    assert [p for p, _ in parts] == [0, 1, 2, 3]
    items = "\n".join(f"- 1x p{p} (${p})" for p in range(1, 7))
    assert "".join(b for _, b in parts) == text.CONFIRMATION.format(name="guest2", order=2, store="S", items=items, total=50)
    assert [(r.part, r.body) for r in got if r.order_id == 1 and r.part == 1] == [(1, "")]


def test_replies_need_all_parts(spark, rows):
    df = spark.createDataFrame([(1, "a@x", "Hola", "b"), (2, "", "s", "b"), (3, "a@x", None, "b")], "i int, recipient string, subject string, body string")
    mails, rejects = text.reply_message_body(df)
    assert rows(mails, "i", "mail_subject") == [(1, "Re: Hola")]
    assert rows(rejects, "i", "reason") == [(2, "missing_field"), (3, "missing_field")]


def test_alarm_only_when_more_than_before(spark):
    changes = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 0, 1), 2), (datetime(2024, 1, 1, 0, 0, 29), -1), (datetime(2024, 1, 1, 0, 1, 5), -1), (datetime(2024, 1, 2), 1)],
        "changed_at timestamp_ntz, delta bigint",
    )
    got = monitor.pending_monitor(changes).orderBy("poll_at").collect()
    assert [(r.pending_count, r.previous_count, r.alert) for r in got] == [(1, 0, True), (0, 1, False), (1, 0, True)]
