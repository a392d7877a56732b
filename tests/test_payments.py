import hashlib
import random
from datetime import datetime, timedelta

import pytest

from retail_spark.operators.payments import attempts_in_force, match_payments, paid_order_heads, valid_attempts, verify_signature
from retail_spark.streaming.payments import match_payments_stream, write_matches

SECRET = "s3cret"
NOON = datetime(2024, 5, 1, 12, 0)
ATTEMPT = "reference string, order_id bigint, user_id bigint, total decimal(18,2), attempted_at timestamp"
EVENT = (
    "reference string, amount_in_cents bigint, currency string, status string, sent_at bigint, event_ts timestamp, "
    "checksum string"
)


def attempt(reference, minute=0, order_id=1):
    return (reference, order_id, 5, None, NOON + timedelta(minutes=minute))


def event(reference, status, minute, sent_at, checksum=None):
    signed = f"{reference}100COP{status}{sent_at}{SECRET}"
    return (
        reference, 100, "COP", status, sent_at, NOON + timedelta(minutes=minute),
        checksum or hashlib.sha256(signed.encode()).hexdigest(),
    )


def one_by_one(attempts, events):
    """An attempt replaces the one before; after 30 minutes its timer deletes what waits then; an approval or refusal ends it."""
    waiting, out = {}, {}
    life = timedelta(minutes=30)
    moves = [(a[4], 1, a[1], a) for a in attempts] + [(a[4] + life, 0, 0, a) for a in attempts]
    moves += [(e[5], 2, e[4], e) for e in events]
    for _, kind, sent_at, row in sorted(moves, key=lambda m: m[:3]):
        if kind == 0:
            waiting.pop(row[0], None)
            continue
        if kind == 1:
            waiting[row[0]] = row
            continue
        known = waiting.get(row[0])
        if known is None:
            out[sent_at] = "not_found"
        elif row[3] == "APPROVED":
            out[sent_at] = "approved"
            del waiting[row[0]]
        elif row[3] in ("DECLINED", "VOIDED", "ERROR"):
            out[sent_at] = "closed"
            del waiting[row[0]]
        else:
            out[sent_at] = "waiting"
    return out


def random_case(seed):
    rnd = random.Random(seed)
    attempts = [attempt(f"r{i % 15}", rnd.randrange(60), i) for i in range(40)]  # many stored anew
    events = [
        event(
            "r1" if rnd.random() < 0.4 else f"r{rnd.randrange(18)}",
            rnd.choice(["APPROVED", "PENDING", "DECLINED", "PENDING", "VOIDED", "ERROR", "PENDING"]),
            rnd.randrange(100),
            n,
        )
        for n in range(1, 120)
    ]
    return attempts, events


@pytest.mark.parametrize("seed,rows_per_split", [(1, 250_000), (2, 10)])
def test_batch_equals_one_by_one(spark, seed, rows_per_split):
    attempts, events = random_case(seed)
    got = match_payments(
        spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(events, EVENT), SECRET, rows_per_split=rows_per_split
    )
    assert {r.sent_at: r.outcome for r in got.collect()} == one_by_one(attempts, events)


def test_edges(spark):
    attempts = [attempt(r) for r in ("at_29", "at_30", "twice", "retry", "forged")]
    events = [
        event("at_29", "APPROVED", 29, 1), event("at_30", "APPROVED", 30, 2),
        event("twice", "APPROVED", 1, 3), event("twice", "APPROVED", 2, 4),
        event("retry", "PENDING", 1, 5), event("retry", "DECLINED", 2, 6), event("retry", "APPROVED", 3, 7),
        event("forged", "APPROVED", 1, 8, "x"), event(None, "APPROVED", 1, 9, "x"), event("never", "APPROVED", 1, 10),
    ]
    got = match_payments(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(events, EVENT), SECRET)
    assert {r.sent_at: r.outcome for r in got.collect()} == {
        1: "approved", 2: "not_found", 3: "approved", 4: "not_found", 5: "waiting", 6: "closed", 7: "not_found",
        8: "bad_signature", 9: "incomplete", 10: "not_found",
    }


def test_a_zero_amount_is_complete_but_a_zero_time_is_not(spark):
    frame = spark.createDataFrame([event("a", "APPROVED", 0, 1), event("b", "APPROVED", 0, 0)], EVENT)
    assert {r.reference: r.verdict for r in verify_signature(frame, SECRET).collect()} == {"a": "ok", "b": "incomplete"}


def test_attempts_are_checked(spark):
    schema = "reference string, total decimal(18,2), items array<struct<product_id: bigint, quantity: int, price: decimal(18,2)>>"
    from decimal import Decimal as D

    good = [(1, 2, D("1.00"))]
    rows = [
        ("ok", D(1), good), ("zero_total", D(0), good), ("", D(1), good), (None, D(1), good), ("no_total", None, good),
        ("no_items", D(1), []), ("null_items", D(1), None), ("qty0", D(1), [(1, 0, D(1))]), ("no_price", D(1), [(1, 1, None)]),
        ("id0", D(1), [(0, 1, D(1))]),
    ]
    good_rows, bad = valid_attempts(spark.createDataFrame(rows, schema))
    assert {r.reference for r in good_rows.collect()} == {"ok", "zero_total"}
    assert {r.reference: r.reason for r in bad.collect()} == {
        "": "missing_field", None: "missing_field", "no_total": "missing_field", "no_items": "missing_field",
        "null_items": "missing_field", "qty0": "bad_item", "no_price": "bad_item", "id0": "bad_item",
    }


def test_payer_data_win_over_those_of_the_attempt(spark):
    schema = (
        "reference string, full_name string, attempt_name string, phone_number string, attempt_phone string, address_line_1 "
        "string, address_line_2 string, region string, city string, customer_email string"
    )
    rows = [("a", "Ana", "Eva", None, "9", "Calle 1", None, "R", "C", "e"), ("b", "", "Eva", "5", "9", None, None, "R", "C", "e"),
            ("c", None, None, "5", "9", "x", "y", "R", "C", "e")]
    got = {r.reference: (r.name, r.phone, r.address) for r in paid_order_heads(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("Ana", "9", "Calle 1"), "b": ("Eva", "5", ""), "c": ("Cliente Wompi", "5", "x y")}


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    """Attempts and events arrive in several batches, the query is stopped and started again between them."""
    attempts, events = random_case(7)
    sources = {"attempts": (attempts, ATTEMPT, 4), "events": (events, EVENT, 5)}
    for name in sources:
        (tmp_path / name).mkdir()

    def run():
        streams = {
            name: spark.readStream.schema(schema).parquet(str(tmp_path / name)) for name, (_, schema, _) in sources.items()
        }
        matches = match_payments_stream(streams["attempts"], streams["events"], SECRET, delay="1 hour")
        write_matches(matches, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()

    for low, high in ((0, 40), (40, 100)):
        for name, (data, schema, at) in sources.items():
            part = [r for r in data if low <= (r[at] - NOON).total_seconds() / 60 < high]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(events)
    assert {r.sent_at: r.outcome for r in got} == one_by_one(attempts, events)


def test_late_event_finds_no_state(spark, tmp_path):
    (tmp_path / "attempts").mkdir(), (tmp_path / "events").mkdir()
    for minute, name, row, schema in (
        (0, "attempts", attempt("a"), ATTEMPT), (61, "events", event("a", "APPROVED", 61, 1), EVENT),
    ):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        matches = match_payments_stream(
            spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "attempts")),
            spark.readStream.schema(EVENT).parquet(str(tmp_path / "events")),
            SECRET,
        )
        write_matches(matches, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r.sent_at, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "not_found")]


def test_a_new_attempt_replaces_the_old_one_whose_timer_still_runs(spark):
    attempts = [attempt("a", 0, 1), attempt("a", 10, 2), attempt("b", 0, 3), attempt("b", 20, 4), attempt("c", 0, 5), attempt("c", 30, 6)]
    events = [
        event("a", "APPROVED", 12, 1), event("b", "PENDING", 29, 2), event("b", "APPROVED", 35, 3), event("c", "APPROVED", 31, 4),
    ]
    got = match_payments(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(events, EVENT), SECRET).collect()
    assert {r.sent_at: (r.outcome, r.order_id) for r in got} == {
        1: ("approved", 2), 2: ("waiting", None), 3: ("not_found", None), 4: ("approved", 6),
    }


def test_events_of_one_instant_and_events_delivered_twice(spark):
    """One attempt: exactly one of two equal approvals finds it, and what comes after finds nothing."""
    twice = event("a", "APPROVED", 1, 7)
    events = [twice, twice, event("a", "DECLINED", 1, 8), event("b", "APPROVED", 1, 9), event("b", "DECLINED", 1, 9)]
    got = match_payments(
        spark.createDataFrame([attempt("a"), attempt("b")], ATTEMPT), spark.createDataFrame(events, EVENT), SECRET, rows_per_split=2
    )
    outcomes = sorted((r.reference, r.sent_at, r.status, r.outcome) for r in got.collect())
    assert outcomes == [
        ("a", 7, "APPROVED", "approved"), ("a", 7, "APPROVED", "not_found"), ("a", 8, "DECLINED", "not_found"),
        ("b", 9, "APPROVED", "approved"), ("b", 9, "DECLINED", "not_found"),
    ]


@pytest.mark.parametrize("rows_per_block", [250_000, 10])
def test_the_log_carries_only_what_is_kept_and_finds_the_same(spark, rows_per_block):
    attempts, events = random_case(3)
    events += [event("r1", "PENDING", 7, 500 + n, "x") for n in range(15)] + [(None, *event("r1", "PENDING", 8, 700)[1:])] * 12
    frames = spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(events, EVENT)
    whole = attempts_in_force(*frames, 30, True).select("event.sent_at", "attempt.order_id")
    thin = attempts_in_force(*frames, 30, True, rows_per_block, kept=["sent_at"], held=["order_id"])
    assert thin.schema["event"].dataType.names == ["sent_at"] and thin.schema["attempt"].dataType.names == ["order_id"]
    got = thin.select("event.sent_at", "attempt.order_id").collect()
    assert sorted(got, key=repr) == sorted(whole.collect(), key=repr) and len(got) == len(events)
