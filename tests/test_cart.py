import random
from datetime import datetime, timedelta

import pytest

from retail_spark.operators.cart import cart_state, cart_totals, clean_cart
from retail_spark.streaming.carts import cart_batches, current_carts, next_quantity, open_carts, with_guests

START = datetime(2024, 1, 1)
EVENTS = "event_id bigint, user_id bigint, product_id bigint, kind string, quantity int, ts timestamp_ntz"


def replay(log, stock):
    carts = {}
    for _, user, product, kind, quantity, _ in sorted(log, key=lambda e: (e[5], e[0])):
        cart = carts.setdefault(user, {})
        for p in list(cart) if kind == "clear" else [product]:
            if p is not None and p in stock:
                cart[p] = next_quantity(kind, cart.get(p, 0), quantity, stock[p])
    return sorted((u, p, q) for u, cart in carts.items() for p, q in cart.items() if q)


@pytest.mark.parametrize("seed,rows_per_split", [(1, 250_000), (2, 50), (3, 50)])
def test_equals_replaying_the_log(spark, rows, seed, rows_per_split):
    rnd = random.Random(seed)
    stock = {p: rnd.choice([0, 3, 10, 500]) for p in range(5)}
    log = []
    for event_id in range(900):
        # One user and product hold a third of the log.
        user, product = (1, 1) if rnd.random() < 0.4 else (rnd.randrange(6), rnd.randrange(6))
        kind = rnd.choices(["add", "set", "remove", "clear"], [60, 25, 5, 1])[0]
        quantity = rnd.choice([None, -1, 0, 1, 2, 3, 7])
        log.append((event_id, user, product, kind, quantity, START + timedelta(seconds=rnd.randrange(400))))
    got = cart_state(
        spark.createDataFrame(log, EVENTS),
        spark.createDataFrame(list(stock.items()), "product_id bigint, stock int"),
        rows_per_split,
    )
    assert rows(got, "user_id", "product_id", "quantity") == sorted(replay(log, stock), key=repr)


@pytest.mark.parametrize(
    "kind,current,quantity,stock,after",
    [
        ("add", 0, 3, 2, 2), ("add", 1, 3, 10, 4), ("add", 0, 1, 0, 0), ("add", 2, 5, 4, 4),
        ("set", 0, 3, 9, 0), ("set", 2, 99, 9, 9), ("set", 2, 0, 9, 0), ("set", 2, -1, 9, 2),
        ("set", 2, None, 9, 2), ("remove", 2, None, 9, 0), ("clear", 2, None, 9, 0),
    ],
)
def test_single_events(kind, current, quantity, stock, after):
    assert next_quantity(kind, current, quantity, stock) == after


def test_stream_of_a_user_with_most_events_equals_replaying_the_log(spark, rows, tmp_path):
    """Micro-batches in order of time, each replayed; one user holds most events, and clears reach lines of earlier batches."""
    rnd = random.Random(5)
    stock = {p: rnd.choice([3, 10, 500]) for p in range(9)}
    log = []
    for n in range(600):
        kind = rnd.choices(["add", "set", "remove", "clear"], [70, 20, 6, 2])[0]
        user = 1 if rnd.random() < 0.7 else rnd.randrange(4)
        log.append((n, user, None if kind == "clear" else rnd.randrange(10), kind, rnd.choice([None, 0, 1, 2, 7]), START + timedelta(seconds=n)))
    products = spark.createDataFrame(list(stock.items()), "product_id bigint, stock int")
    carts = open_carts(spark, str(tmp_path / "carts"), buckets=4)
    fold = cart_batches(carts, lambda: products)
    for batch, start in enumerate(range(0, 600, 200)):
        part = spark.createDataFrame(log[start : start + 200], EVENTS)
        fold(part, batch)
        version = carts.version()
        fold(part, batch)
        assert carts.version() == version
        assert rows(current_carts(carts), "user_id", "product_id", "quantity") == sorted(replay(log[: start + 200], stock), key=repr)


def test_a_clear_writes_one_row(spark, rows, tmp_path):
    products = spark.createDataFrame([(p, 9) for p in range(50)], "product_id bigint, stock int")
    carts = open_carts(spark, str(tmp_path / "carts"), buckets=8)
    fold = cart_batches(carts, lambda: products)
    fold(spark.createDataFrame([(p, 1, p, "add", 2, START) for p in range(50)], EVENTS), 0)
    before = carts.manifest().keyed["cart"]
    fold(spark.createDataFrame([(99, 1, None, "clear", None, START)], EVENTS), 1)
    assert carts.manifest().keyed["cart"] == before and current_carts(carts).isEmpty()
    assert rows(carts.read("owner")) == [(1, 1)]
    fold(spark.createDataFrame([(100, 1, 3, "add", 1, START), (101, 1, 4, "set", 5, START)], EVENTS), 2)
    assert rows(current_carts(carts)) == [(1, 3, 1)]


def test_guests_have_carts_of_their_own(spark):
    df = spark.createDataFrame([(None, "b1"), (None, "b2"), (None, "b1"), (7, "b1")], "user_id bigint, browser_id string")
    users = [r.user_id for r in with_guests(df).collect()]
    assert users[0] == users[2] < 0 and users[1] < 0 and users[1] != users[0] and users[3] == 7


def test_unreadable_items_count_nothing(spark, rows):
    items = spark.createDataFrame(
        [(1, "10.50", "2"), (1, "gratis", "3"), (1, "5 COP", "x"), (2, None, None)], "user_id bigint, price string, quantity string"
    )
    assert [(u, str(s), n) for u, s, n in rows(cart_totals(items), "user_id", "subtotal", "item_count")] == [
        (1, "21.00", 5), (2, "0.00", 0),
    ]


def test_broken_carts_are_empty(spark):
    texts = ['[{"productId":1,"quantity":2},{"productId":null},null,{}]', '{"productId":1}', "[{", None, "7", "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, cart_text string")
    got = {r.i: [(c.productId, c.quantity) for c in r.cart] for r in clean_cart(df).collect()}
    assert got == {0: [("1", "2")], 1: [], 2: [], 3: [], 4: [], 5: []}
