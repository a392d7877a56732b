from datetime import datetime, timedelta
from decimal import Decimal as D

from retail_spark import schemas
from retail_spark.operators import checkout

NOW = datetime(2024, 5, 1)


def customer(name="Ana", email="a@x", phone="300", user_id=None, complement=""):
    return (user_id, name, phone, "Calle 1", "Atl", "Baq", complement, email)


def requests(spark):
    rows = [
        (1, 5, [(1, 2, D(9)), (1, 1, D(9))], customer(user_id=3)),
        (2, 1, [], customer()),
        (3, 2, [(1, 1, D(9))], customer(phone="")),
        (4, 3, [(99, 1, D(9))], customer(email="n@x")),
        (5, 4, [(1, 1, D(9)), (2, 1, D(9))], customer(name="Eva", email="e@x")),
        (6, 6, [(2, 1, D(9))], customer(name="Late", email="l@x")),
        (7, 7, [(1, 0, D(9))], customer()),
        (8, 8, None, customer()),
    ]
    return spark.createDataFrame(
        [(i, NOW + timedelta(minutes=at), "ContraEntrega" if i != 5 else "PayPal", cart, c) for i, at, cart, c in rows],
        schemas.CHECKOUT_REQUEST,
    )


def tables(spark):
    products = spark.createDataFrame(
        [(1, "bolt", None, D("2.50"), "b", None, 1, 4, *[None] * 5), (2, "nut", None, D("1.00"), "b", None, 1, 1, *[None] * 5)],
        schemas.TABLES["product"],
    )
    customers = spark.createDataFrame([(10, "Old", "", "a@x"), (11, "Dup", "", "a@x")], schemas.TABLES["customer"])
    orders = spark.createDataFrame([], schemas.TABLES["orders"])
    return products, customers, orders


def test_whole_batch(spark, rows):
    heads, items = checkout.split_requests(requests(spark))
    done = checkout.place_orders(heads, items, *tables(spark))
    assert rows(done.rejects, "request_id", "reason") == [
        (2, "empty_cart"), (3, "missing_field"), (4, "unknown_product"), (6, "out_of_stock"), (7, "bad_quantity"), (8, "empty_cart"),
    ]
    # Request 5 came before request 1, so it gets the first number.
    assert rows(done.orders, "order_id", "request_id", "total", "status", "payment_method", "customer_id", "user_id") == [
        (1, 5, D("3.50"), "Pagado", "PayPal", 12, None), (2, 1, D("7.50"), "Pendiente de Confirmacion", "ContraEntrega", 10, 3),
    ]
    assert rows(done.lines) == sorted(
        [(1, 1, 1, D("2.50")), (1, 2, 1, D("1.00")), (2, 1, 1, D("2.50")), (2, 1, 2, D("2.50"))], key=repr)
    assert rows(done.products, "product_id", "stock") == [(1, 0), (2, 0)]
    assert rows(done.customers, "customer_id", "first_name", "email") == [
        (10, "Old", "a@x"), (11, "Dup", "a@x"), (12, "Eva", "e@x"),
    ]


def test_only_completed_captures_become_orders(spark, rows):
    heads, items = checkout.split_requests(requests(spark))
    captures = spark.createDataFrame(
        [("P1", "COMPLETED", 1), ("P5", "DECLINED", 5), ("P6", None, 6)], "provider_order_id string, status string, request_id bigint"
    )
    done = checkout.capture_paypal_batch(captures, heads, items, *tables(spark))
    assert rows(done.orders, "request_id", "payment_method", "payment_ref", "status") == [(1, "PayPal", "P1", "Pagado")]
    assert rows(done.rejects) == [(5, "capture_DECLINED"), (6, "capture_unknown")]


def test_buyers(spark, rows):
    _, customers, _ = tables(spark)
    asked = spark.createDataFrame(
        [(3, "Ana", "z@x"), (4, "Bea", "z@x"), (5, "", "local@x"), (6, "Who", ""), (7, "Any", "a@x")],
        "request_id bigint, name string, email string",
    )
    everyone, resolved, rejects = checkout.resolve_customers(customers, asked)
    assert rows(resolved) == [(3, 12), (4, 12), (5, 13), (7, 10)]
    assert rows(everyone.filter("customer_id > 11"), "customer_id", "first_name", "last_name") == [(12, "Ana", ""), (13, "local", "")]
    assert rows(rejects, "request_id", "reason") == [(6, "missing_email")]


def test_rates(spark, rows):
    amounts = spark.createDataFrame([(1, D("8000.00"))], "id int, total decimal(18,2)")
    feed = spark.createDataFrame(
        [("USD", D("3000"), NOW.date()), ("USD", D("2000"), NOW.date() + timedelta(days=1)), ("EUR", D("1"), NOW.date() + timedelta(days=9))],
        schemas.FX_RATE,
    )
    assert rows(checkout.convert_currency(amounts, feed), "total_usd") == [(D("4.00"),)]
    empty = spark.createDataFrame([], schemas.FX_RATE)
    assert rows(checkout.convert_currency(amounts, empty), "rate", "total_usd") == [(D("4000.000000"), D("2.00"))]
