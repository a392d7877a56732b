import random

import pytest
from pyspark.sql import functions as F

from retail_spark import schemas
from retail_spark.operators import maintenance as m
from retail_spark.operators.barcodes import standing_edits

PRODUCT_REQUEST = (
    "position bigint, product_id bigint, name string, description string, unit_price string, brand string, barcode string, "
    "category_id string, stock string, image_url string, image_url_2 string, image_url_3 string, image_url_4 string, "
    "image_url_5 string"
)


def product_table(spark, barcodes):
    return spark.createDataFrame(
        [(i, f"p{i}", None, None, "b", code, 1, 5, *[None] * 5) for i, code in enumerate(barcodes, 1)],
        schemas.TABLES["product"],
    )


def request(position, name="n", price="1.5", stock="3", brand="b", barcode=None, category=None, product_id=None):
    return (position, product_id, name, "", price, brand, barcode, category, stock, *[None] * 5)


def test_merge_modes(spark, rows):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (9, "e", 3)], "id int, v string, position int")
    updated, unknown = m.merge(table, changes, ["id"], "update")
    assert rows(updated) == [(1, "a", "x"), (2, "d", "y")]
    assert rows(unknown, "id", "reason") == [(9, "not_found")]
    upserted, _ = m.merge(table, changes, ["id"], "upsert")
    assert rows(upserted) == [(1, "a", "x"), (2, "d", "y"), (9, "e", None)]
    inserted, refused = m.merge(table, changes, ["id"], "insert")
    assert rows(inserted) == [(1, "a", "x"), (2, "b", "y"), (9, "e", None)]
    assert rows(refused, "id", "v") == [(2, "c"), (2, "d")]
    left, _ = m.merge(table, changes, ["id"], "delete")
    assert rows(left) == [(1, "a", "x")]


def test_a_change_may_set_a_value_to_null(spark, rows):
    table = spark.createDataFrame([(1, "a")], "id int, v string")
    changes = spark.createDataFrame([(1, None, 1)], "id int, v string, position int")
    assert rows(m.merge(table, changes, ["id"], "update")[0]) == [(1, None)]


def test_merging_twice_changes_nothing_more(spark, rows):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "id int, v string, position int")
    once, _ = m.merge(table, changes, ["id"], "upsert")
    assert rows(m.merge(once, changes, ["id"], "upsert")[0]) == rows(once)


def test_reviews(spark, rows):
    table = spark.createDataFrame([], schemas.TABLES["review"])
    new = spark.createDataFrame(
        [(1, 7, 1, "Ana", 5, "ok"), (2, 7, 1, "", 5, "ok"), (3, 7, 1, "Ana", 0, "ok"), (4, 7, 1, "Ana", 6, "ok"),
         (5, 999, None, "Eva", 1, "mal")],
        schemas.REVIEW_REQUEST,
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    table, rejects = m.add_reviews(table, new)
    assert rows(table, "review_id", "product_id", "reviewer_name", "rating") == [(1, 7, "Ana", 5), (2, 999, "Eva", 1)]
    assert rows(rejects, "request_id", "reason") == [(2, "missing_field"), (3, "missing_field"), (4, "rating_out_of_range")]


def test_create_products(spark, rows):
    new = spark.createDataFrame(
        [
            request(1, barcode="A"), request(2, barcode="N"), request(3, barcode="N"), request(4, barcode=""),
            request(5, barcode=""), request(6, name=""), request(7, price="x"), request(8, price="-1"), request(9, stock=None),
            request(10, category="x"), request(11, category="4", stock="7 und"), request(12, name="", barcode="M"),
            request(13, barcode="M"),
        ],
        PRODUCT_REQUEST,
    ).drop("product_id")
    table, rejects = m.create_products(product_table(spark, ["A", None]), new)
    assert rows(rejects, "position", "reason") == sorted(
        [(1, "duplicate_barcode"), (3, "duplicate_barcode"), (6, "missing_field"), (7, "bad_number"), (8, "bad_number"),
         (9, "missing_field"), (10, "bad_number"), (12, "missing_field")], key=repr)
    added = table.filter("product_id > 2")
    assert rows(added, "product_id", "barcode", "category_id", "stock") == [
        (3, "N", None, 3), (4, None, None, 3), (5, None, None, 3), (6, None, 4, 7), (7, "M", None, 3),
    ]


def test_update_products(spark, rows):
    changes = spark.createDataFrame(
        [request(1, product_id=1, name="x"), request(2, product_id=1, name="y", barcode="A"), request(3, product_id=2, barcode="A"),
         request(4, product_id=8), request(5, product_id=3, name="")],
        PRODUCT_REQUEST,
    )
    table, rejects = m.update_products(product_table(spark, ["A", "B", "C"]), changes)
    assert rows(table, "product_id", "name", "barcode") == [(1, "y", "A"), (2, "p2", "B"), (3, "p3", "C")]
    assert rows(rejects, "position", "reason") == [(3, "duplicate_barcode"), (4, "not_found"), (5, "missing_field")]


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_an_edit_before_a_refused_one_stands(spark, rows, seed):
    """Edits replayed one by one: a barcode belongs to the product that bears it, and is free once that bears another."""
    rnd = random.Random(seed)
    codes = ["A", "B", "C", None]
    edits = [(n, rnd.randint(1, 5), rnd.choice(["A", "B", "C", "X", "Y", "Z", ""])) for n in range(1, 40)]
    bears = dict(enumerate(codes, 1))
    names, refused = {}, set()
    for n, product, code in edits:
        if product > 4 or (code and any(c == code for p, c in bears.items() if p != product)):
            refused.add(n)
        else:
            bears[product] = code or None
            names[product] = (f"e{n}", code or None)
    changes = spark.createDataFrame([request(n, product_id=p, name=f"e{n}", barcode=c) for n, p, c in edits], PRODUCT_REQUEST)
    table, rejects = m.update_products(product_table(spark, codes), changes)
    expected = [(i, *names.get(i, (f"p{i}", c))) for i, c in enumerate(codes, 1)]
    assert rows(table, "product_id", "name", "barcode") == sorted(expected, key=repr)
    assert {r.position for r in rejects.collect()} == refused


def test_a_barcode_left_can_be_taken(spark, rows):
    edits = [(1, 1, "X"), (2, 2, "A"), (3, 1, "A"), (4, 3, "B"), (5, 1, ""), (6, 3, "X")]
    changes = spark.createDataFrame([request(n, product_id=p, name=f"e{n}", barcode=c) for n, p, c in edits], PRODUCT_REQUEST)
    table, rejects = m.update_products(product_table(spark, ["A", "B", "C"]), changes)
    assert rows(table, "product_id", "barcode") == [(1, None), (2, "A"), (3, "X")]
    assert rows(rejects, "position", "reason") == [(3, "duplicate_barcode")]


@pytest.mark.parametrize("seed,per_block", [(1, 250_000), (2, 7), (3, 1)])
def test_standing_edits_of_hot_products_and_barcodes(spark, seed, per_block):
    """A third of the edits are one product's, a third want one barcode; the log is cut into blocks of any size."""
    rnd = random.Random(seed)
    bears = {p: f"c{p}" if p % 3 else None for p in range(30)}
    products = spark.createDataFrame(list(bears.items()), "product_id bigint, barcode string")
    edits = [
        (n, 1 if rnd.random() < 0.3 else rnd.randrange(30), "c2" if rnd.random() < 0.3 else rnd.choice([*(f"c{i}" for i in range(40)), None]))
        for n in range(90)
    ]
    stands = set()
    for n, product, code in edits:
        if code is None or all(c != code for p, c in bears.items() if p != product):
            bears[product] = code
            stands.add(n)
    df = spark.createDataFrame(edits, "position bigint, product_id bigint, barcode string")
    assert {r.position for r in standing_edits(products, df, per_block=per_block).collect()} == stands


def test_inserts_need_a_position(spark):
    table = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError):
        m.merge(table, table, ["id"], "insert")


def test_referenced_rows_stay(spark, rows):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    orders = spark.createDataFrame([(2,), (None,)], "user_id bigint")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "user_id bigint")
    table, rejects = m.delete_users(users, ids, orders)
    assert rows(table) == [(2,), (3,)]
    assert rows(rejects) == [(2, "referenced"), (9, "not_found")]


def test_register_users(spark, rows):
    users = spark.createDataFrame([(5, "u", "u@x", "h", "admin")], schemas.TABLES["users"])
    customers = spark.createDataFrame([(9, "u", "", "u@x"), (10, "n", "", "old@x")], schemas.TABLES["customer"])
    new = spark.createDataFrame(
        [(1, "a", "a@x", 6, "h1"), (2, "b", "a@x", 8, "h2"), (3, "c", "u@x", 8, "h3"), (4, "d", "d@x", 5, "h4"), (5, "", "e@x", 9, "h5"),
         (6, "o", "old@x", 9, "h6")],
        "position bigint, username string, email string, password_length int, password_hash string",
    )
    table, buyers, rejects = m.register_users(users, customers, new)
    assert rows(table, "user_id", "email", "password_hash", "role") == [
        (5, "u@x", "h", "admin"), (6, "a@x", "h1", "cliente"), (7, "old@x", "h6", "cliente"),
    ]
    assert rows(buyers, "customer_id", "first_name", "email") == sorted(
        [(9, "u", "u@x"), (10, "n", "old@x"), (11, "a", "a@x")], key=repr)
    assert rows(rejects, "position", "reason") == [
        (2, "email_taken"), (3, "email_taken"), (4, "invalid_registration"), (5, "invalid_registration"),
    ]


def test_status_and_role_changes(spark, rows):
    orders = spark.createDataFrame([(1, "Pagado"), (2, "Cancelado")], "order_id bigint, status string")
    changes = spark.createDataFrame(
        [(1, "Entregado", 1), (2, "Perdido", 2), (3, "Pagado", 3), (1, None, 4)], "order_id bigint, status string, position int"
    )
    table, rejects = m.set_order_status(orders, changes)
    assert rows(table) == [(1, "Entregado"), (2, "Cancelado")]
    assert rows(rejects, "position", "reason") == [(2, "bad_status"), (3, "not_found"), (4, "bad_status")]


def test_unknown_messages_are_ignored(spark, rows):
    messages = spark.createDataFrame([(1, "unread", False)], "message_id bigint, status string, is_starred boolean")
    changes = spark.createDataFrame([(1, "read", 1), (7, "read", 2), (1, "spam", 3)], "message_id bigint, status string, position int")
    table, rejects = m.set_message_status(messages, changes)
    assert rows(table) == [(1, "read", False)] and rows(rejects, "position") == [(3,)]
    stars = spark.createDataFrame([(1, True, 1), (7, True, 2)], "message_id bigint, is_starred boolean, position int")
    assert rows(m.star_messages(messages, stars)[0]) == [(1, "unread", True)]
    assert rows(m.delete_messages(messages, changes)[0]) == []


def test_settings(spark, rows):
    settings = spark.createDataFrame([("colorPrimary", "#000"), ("welcomeTitle", "Hola")], schemas.TABLES["site_setting"])
    changes = spark.createDataFrame(
        [("colorPrimary", "red", 1), ("welcomeTitle", " Hi \n", 2), ("other", "x", 3), ("socialTwitter", "ftp:x", 4),
         ("socialFacebook", "", 5), ("contactPhone", None, 6)],
        "setting_key string, setting_value string, position int",
    )
    table, rejects = m.upsert_settings(settings, changes)
    assert dict(rows(table)) == {
        "colorPrimary": "red", "welcomeTitle": "Hi", "socialTwitter": "ftp:x", "socialFacebook": "", "contactPhone": "",
    }
    assert rows(rejects, "position", "reason") == [(3, "unknown_key")]
    table, rejects = m.upsert_settings(settings, changes, strict=True)
    assert dict(rows(table)) == {"colorPrimary": "#000", "welcomeTitle": "Hi", "socialFacebook": "", "contactPhone": ""}
    assert rows(rejects, "position", "reason") == [(1, "bad_colour"), (3, "unknown_key"), (4, "bad_link")]


def test_content(spark, rows):
    content = spark.createDataFrame([(1, "a", "x", 2), (4, "b", "y", 1)], schemas.TABLES["policy"])
    new = spark.createDataFrame([(1, "c", None), (2, "d", "z")], "position int, title string, body string")
    assert rows(m.create_content(content, new, "policy_id")) == [
        (1, "a", "x", 2), (4, "b", "y", 1), (5, "c", None, None), (6, "d", "z", None),
    ]
    lists = spark.createDataFrame(
        [(1, [(1, "n1", "q"), (1, "n2", "r"), (8, "n", "n")]), (2, [(4, "m", None)])],
        "request_id int, policies array<struct<policy_id: bigint, title: string, body: string>>",
    )
    edits = m.edits_from_lists(lists, "policies", "request_id")
    assert rows(m.update_content(content, edits, "policy_id")) == [(1, "n2", "r", 2), (4, "m", None, 1)]
    assert rows(m.delete_content(content, spark.createDataFrame([(4,), (9,)], "policy_id bigint"), "policy_id"), "policy_id") == [(1,)]
