import random

import pytest
from pyspark.sql import functions as F

from retail_spark.operators.admission import _next_round, admit_orders
from retail_spark.operators.checkout import apply_stock
from retail_spark.streaming.payments import settle_candidates


def one_by_one(lines, stock):
    """The rule itself: serve orders in turn."""
    left, accepted = dict(stock), set()
    for seq in sorted({line[0] for line in lines}):
        mine = [line for line in lines if line[0] == seq]
        if all(left.get(p, 0) >= q for _, p, q in mine):
            accepted.add(seq)
            for _, p, q in mine:
                left[p] = max(0, left.get(p, 0) - q)
    return accepted


def frames(spark, lines, stock):
    return (
        spark.createDataFrame(lines, "seq bigint, product_id bigint, quantity int"),
        spark.createDataFrame(list(stock.items()), "product_id bigint, stock int"),
    )


@pytest.mark.parametrize("seed,rows_per_split", [(1, 250_000), (2, 250_000), (3, 20), (4, 40)])
def test_equals_serving_one_by_one(spark, seed, rows_per_split):
    rnd = random.Random(seed)
    stock = {p: rnd.randint(0, 60) for p in range(12)}
    # Product 0 is in most orders, so it holds a third of the lines and is cut into blocks when splits are small.
    lines = [
        (seq, p, rnd.randint(1, 4))
        for seq in range(150)
        for p in ({0} if rnd.random() < 0.8 else set()) | {rnd.randrange(13) for _ in range(2)}
    ]
    stock[0] = 200
    items, supply = frames(spark, lines, stock)
    got = admit_orders(items, supply, rows_per_split=rows_per_split).collect()
    assert len(got) == len({line[0] for line in lines})
    assert {r.seq for r in got if r.accepted} == one_by_one(lines, stock)


def test_a_product_named_twice_is_checked_by_line_and_taken_as_sum(spark):
    lines = [(1, 1, 6), (1, 1, 6), (2, 1, 1)]
    items, supply = frames(spark, lines, {1: 10})
    assert {r.seq: r.accepted for r in admit_orders(items, supply).collect()} == {1: True, 2: False}
    products = spark.createDataFrame([(1, 10), (2, 4)], "product_id bigint, stock int")
    left = apply_stock(products, items.filter("seq = 1"))
    assert {r.product_id: r.stock for r in left.collect()} == {1: 0, 2: 4}


def test_a_round_that_accepts_far_more_than_stays_open(spark):
    lines = [(seq, 1, 1) for seq in range(3000)] + [(seq, 2, 1) for seq in range(2990, 3020)]
    stock = {1: 2995, 2: 6}
    items, supply = frames(spark, lines, stock)
    got = admit_orders(items, supply, rows_per_split=500).collect()
    assert {r.seq for r in got if r.accepted} == one_by_one(lines, stock)


def test_enough_for_all_needs_no_round(spark):
    items, supply = frames(spark, [(1, 1, 2), (2, 1, 3)], {1: 5})
    assert all(r.accepted for r in admit_orders(items, supply).collect())


def test_unknown_product_has_no_stock(spark):
    items, supply = frames(spark, [(1, 9, 1), (2, 1, 1)], {1: 5})
    assert {r.seq: r.accepted for r in admit_orders(items, supply).collect()} == {1: False, 2: True}


def test_one_approval_per_reference_settles(spark):
    """The second approval of a reference counts only when the first fails on stock."""
    rnd = random.Random(5)
    stock = {p: rnd.randint(1, 8) for p in range(4)}
    items = {f"r{i}": [(rnd.randrange(4), rnd.randint(1, 3))] for i in range(12)}
    candidates = [(f"r{i % 12}", n, n) for n, i in enumerate(rnd.choices(range(12), k=40), 1)]
    left, expected, done = dict(stock), set(), {"r3"}
    for reference, n, _ in candidates:
        if reference not in done and all(left[p] >= q for p, q in items[reference]):
            expected.add(n)
            done.add(reference)
            for p, q in items[reference]:
                left[p] -= q
    got = settle_candidates(
        spark.createDataFrame(candidates, "reference string, sent_at bigint, s bigint").withColumn(
            "event_ts", F.timestamp_seconds("s")
        ),
        spark.createDataFrame(
            [(r, p, q) for r, lines in items.items() for p, q in lines], "reference string, product_id bigint, quantity int"
        ),
        spark.createDataFrame(list(stock.items()), "product_id bigint, stock int"),
        spark.createDataFrame([("r3",)], "reference string"),
    )
    assert {r.sent_at for r in got.collect()} == expected


def test_a_refused_order_passes_through_the_rounds_as_one_line(spark):
    state = spark.createDataFrame(
        [(1, p, 5, 5, 1, "open") for p in range(4)] + [(2, 0, 1, 1, 1, "open"), (2, 9, 1, 1, 1, "open")],
        "seq bigint, product_id bigint, need bigint, take bigint, remaining bigint, state string",
    )
    got = _next_round(state, None, 100).groupBy("seq", "state").count().collect()
    assert ((1, "refused", 1) in {tuple(r) for r in got}) and sum(r["count"] for r in got if r.seq == 1) == 1
