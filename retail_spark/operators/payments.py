"""Payment attempts and the provider's events, matched in batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from retail_spark import constants
from retail_spark.functions import semantics as sem
from retail_spark.functions.scale import ROWS_PER_SPLIT, hot_among_many, number_rows
from retail_spark.operators.admission import admit_orders
from retail_spark.operators.checkout import apply_stock, build_order_lines, build_orders, resolve_customers
from retail_spark.operators.maintenance import split_by_rules
from retail_spark.session import materialise

NOTICE_FIELDS = ["event_id", "reference", "status", "sent_at", "event_ts"]
PAYER_FIELDS = [
    "customer_email", "full_name", "address_line_1", "address_line_2", "region", "city", "phone_number",
]
#: What an order is numbered by and made of.
HEAD_FIELDS = [
    "event_id", "sent_at", "event_ts", "attempt_id", "total", "user_id", "items", "created_at", "name", "phone", "address", "department",
    "city", "complement", "email", "method", "payment_ref",
]
SIGNED_FIELDS = ["reference", "amount_in_cents", "currency", "status", "sent_at"]
MICROS_PER_MINUTE = 60_000_000
TERMINAL_STATUSES = [constants.APPROVED, *constants.CLOSING_STATUSES]


def valid_attempts(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts with a reference, a total and items that all have product, quantity and price."""
    bad_item = F.exists(
        "items",
        lambda i: i.isNull()
        | (F.coalesce(i["product_id"], F.lit(0)) == 0)
        | (F.coalesce(i["quantity"], F.lit(0)) <= 0)
        | i["price"].isNull(),
    )
    incomplete = ~sem.has_text("reference") | (F.coalesce(F.size("items"), F.lit(0)) <= 0) | F.col("total").isNull()
    return split_by_rules(
        attempts, [("missing_field", incomplete), ("bad_item", F.coalesce(bad_item, F.lit(False)))]
    )


def expected_checksum(secret: str) -> Column:
    return F.sha2(F.concat(*[F.col(c).cast("string") for c in SIGNED_FIELDS], F.lit(secret)), 256)


def signature_verdict(secret: str) -> Column:
    """incomplete, bad_signature or ok. Zero amounts count as given, a zero time does not."""
    complete = (
        sem.has_text("checksum")
        & sem.has_text("reference")
        & sem.has_text("currency")
        & sem.has_text("status")
        & F.col("amount_in_cents").isNotNull()
        & (F.coalesce("sent_at", F.lit(0)) != 0)
    )
    return (
        F.when(~complete, F.lit("incomplete"))
        .when(F.col("checksum") != expected_checksum(secret), F.lit("bad_signature"))
        .otherwise(F.lit("ok"))
    )


def verify_signature(events: DataFrame, secret: str) -> DataFrame:
    return events.withColumn("verdict", signature_verdict(secret))


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def event_order(events: DataFrame) -> list[Column]:
    """What tells events of one instant apart: sending time, event id where there is one, then all else they say."""
    named = [F.col("event_id")] if "event_id" in events.columns else []
    return [F.col("sent_at"), *named, F.col("status"), F.xxhash64(*[F.col(c) for c in events.columns])]


def attempts_in_force(
    attempts: DataFrame,
    events: DataFrame,
    minutes: int,
    approval_ends: bool,
    rows_per_block: int = ROWS_PER_SPLIT,
    timers: DataFrame | None = None,
    kept: Sequence[str] | None = None,
    held: Sequence[str] | None = None,
) -> DataFrame:
    """(event, attempt): every event, as a struct of all or the ``kept`` columns, with the attempt that waits under its reference when it comes, or null.

    Storing an attempt replaces the one before; ``minutes`` later its timer deletes whatever then waits there, a newer
    attempt too. Declined, voided and failed payments delete it, and so do approvals where ``approval_ends``. At one
    instant timers go first, then attempts, then events in the order of ``event_order``; rows that are equal in all
    columns are each taken once, in any order. Events without reference find nothing. ``timers`` has (reference,
    attempted_at) of attempts that are gone, but whose timers still run.

    All of these are one log by reference and time: what is in force before a row is the last action before it. Rows of a reference
    that has more than ``rows_per_block`` are numbered in that order and cut into blocks of so many numbers, so it is spread: what is
    in force there is the last action before it in its block, or else what the blocks before leave.
    """
    at = _micros
    ties = [f"_t{i}" for i in range(4)]
    number = F.col("attempt_id") if "attempt_id" in attempts.columns else F.col("order_id")
    whole = F.xxhash64(*[F.col(c) for c in attempts.columns])
    attempts = materialise(
        attempts.select(
            "reference", "attempted_at", number.cast("bigint").alias(ties[0]), whole.alias(ties[3]),
            F.struct(*[F.col(c) for c in held or attempts.columns]).alias("attempt"),
        ),
        "attempts",
    )
    running = attempts.select("reference", "attempted_at")
    if timers is not None:
        running = running.unionByName(timers.select("reference", "attempted_at"))
    order = event_order(events)
    told = F.struct(*[F.col(c) for c in kept or events.columns])
    no_event = F.lit(None).cast(events.select(told.alias("r")).schema["r"].dataType)
    no_attempt = F.lit(None).cast(attempts.schema["attempt"].dataType)
    nothing = [F.lit(None).cast(kind).alias(t) for t, kind in zip(ties, ("bigint", "bigint", "string", "bigint"), strict=True)]
    ends = F.col("status").isin(TERMINAL_STATUSES if approval_ends else constants.CLOSING_STATUSES)
    cleared, put = F.struct(no_attempt.alias("attempt")), F.struct("attempt")
    by_attempt = [F.col(ties[0]), *nothing[1:3], F.col(ties[3])]
    if "event_id" not in events.columns:
        order.insert(1, F.lit(None))
    log = (
        attempts.select("reference", at("attempted_at").alias("_at"), F.lit(1).alias("_rank"), *by_attempt,
                        no_event.alias("event"), put.alias("_act"))
        .unionByName(running.select("reference", (at("attempted_at") + minutes * MICROS_PER_MINUTE).alias("_at"), F.lit(0).alias("_rank"),
                                     *nothing, no_event.alias("event"), cleared.alias("_act")))
        .unionByName(events.select("reference", at("event_ts").alias("_at"), F.lit(2).alias("_rank"),
                                   *[c.cast(n.split()[1]).alias(n.split()[0]) for c, n in zip(order, ("_t0 bigint", "_t1 bigint", "_t2 string", "_t3 bigint"), strict=True)],
                                   told.alias("event"), F.when(ends, cleared).alias("_act")))
    )
    order_of_log = ["_at", "_rank", *ties]
    keys = attempts.select("reference").unionByName(running.select("reference")).unionByName(events.select("reference"))
    hot = materialise(hot_among_many(keys, "reference", rows_per_block).select(F.col("reference").alias("_hot")), "hot_references")
    if hot.isEmpty():
        return _last_before(log, order_of_log)
    is_hot = F.col("reference").eqNullSafe(F.col("_hot"))
    return _last_before(log.join(F.broadcast(hot), is_hot, "left_anti"), order_of_log).unionByName(
        _last_before_in_blocks(log.join(F.broadcast(hot), is_hot, "left_semi"), order_of_log, rows_per_block)
    )


def _before(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _last_before(log: DataFrame, order: list[str]) -> DataFrame:
    """(event, attempt) of a log whose references have few rows each."""
    here = F.last("_act", ignorenulls=True).over(_before("reference").orderBy(*order))
    return (
        log.withColumn("_here", here)
        .filter(F.col("event").isNotNull())
        .select("event", F.col("_here")["attempt"].alias("attempt"))
    )


def _last_before_in_blocks(log: DataFrame, order: list[str], rows_per_block: int) -> DataFrame:
    """(event, attempt) of a log whose references may have any number of rows."""
    numbered = number_rows(log, ["reference", *order], "_seq", "payment_log").select(
        "reference", "_seq", F.floor(F.col("_seq") / rows_per_block).alias("_block"), "event", "_act"
    )
    left = numbered.groupBy("reference", "_block").agg(
        F.max_by("_act", F.when(F.col("_act").isNotNull(), F.col("_seq"))).alias("_act")
    )
    carried = left.select(
        "reference", "_block", F.last("_act", ignorenulls=True).over(_before("reference").orderBy("_block")).alias("_carried")
    ).filter(F.col("_carried").isNotNull())
    here = F.last("_act", ignorenulls=True).over(_before("reference", "_block").orderBy("_seq"))
    return (
        numbered.withColumn("_here", here)
        .filter(F.col("event").isNotNull())
        .join(carried, ["reference", "_block"], "left")
        .select("event", F.coalesce("_here", "_carried")["attempt"].alias("attempt"))
    )


def waiting_attempts(
    attempts: DataFrame,
    events: DataFrame,
    timers: DataFrame,
    minutes: int,
    until: Column,
    consumed: DataFrame | None = None,
    ends: Sequence[str] = tuple(constants.CLOSING_STATUSES),
) -> DataFrame:
    """What a batch leaves for the next: the attempts whose timers still run, with ``waits`` for those still in force.

    An attempt waits if it is the last action under its reference but for timers after ``until`` (microseconds), and is not among those
    ``consumed``. Events of a status in ``ends`` are actions. The others are kept for their timers. ``attempts`` are those
    in force before the batch and those of the batch; all have a unique attempt_id.
    """
    first, last = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    lifetime = minutes * MICROS_PER_MINUTE
    running = attempts.select("reference", "attempted_at").unionByName(timers.select("reference", "attempted_at"))
    closing = events.filter(F.col("status").isin(list(ends)))
    acts = (
        attempts.select("reference", F.struct(_micros("attempted_at").alias("at"), F.lit(1).alias("rank"), F.col("attempt_id").alias("id")).alias("act"))
        .unionByName(running.select("reference", F.struct((_micros("attempted_at") + lifetime).alias("at"), F.lit(0).alias("rank"), last.alias("id")).alias("act"))
                     .filter(F.col("act.at") <= until))
        .unionByName(closing.select("reference", F.struct(_micros("event_ts").alias("at"), F.lit(2).alias("rank"), first.alias("id")).alias("act")))
    )
    newest = acts.groupBy("reference").agg(F.max("act").alias("_act")).filter(F.col("_act.rank") == 1)
    in_force = newest.select(F.col("_act.id").alias("attempt_id"))
    if consumed is not None:
        in_force = in_force.join(consumed, "attempt_id", "left_anti")
    still = F.lit(True).alias("_waits")
    every = attempts.withColumn("waits", F.lit(True)).unionByName(timers.withColumn("waits", F.lit(False)))
    return (
        every.filter(_micros("attempted_at") + lifetime > until)
        .join(in_force.select("attempt_id", still), "attempt_id", "left")
        .withColumn("waits", F.col("waits") & F.coalesce("_waits", F.lit(False)))
        .drop("_waits")
    )


def signed_events(events: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """Events that may count, and the others with ``outcome`` incomplete or bad_signature."""
    checked = verify_signature(events, secret)
    good = checked.filter(F.col("verdict") == "ok").drop("verdict")
    return good, checked.filter(F.col("verdict") != "ok").withColumnRenamed("verdict", "outcome")


def match_payments(
    attempts: DataFrame,
    events: DataFrame,
    secret: str,
    minutes: int = constants.PAYMENT_LIFETIME_MINUTES,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """What each payment event does, with the order it settles: one row per event.

    outcome is incomplete, bad_signature, not_found (no attempt waits under the reference), approved, closed
    (declined, voided, failed) or waiting. Which attempt waits when is told by ``attempts_in_force``; an approval ends it.
    """
    good, bad = signed_events(events, secret)
    names = ["reference", "status", "sent_at", "event_ts"]
    found = attempts_in_force(attempts, good, minutes, True, rows_per_split, kept=names, held=["order_id", "total"])
    outcome = (
        F.when(F.col("attempt").isNull(), F.lit("not_found"))
        .when(F.col("event.status") == constants.APPROVED, F.lit("approved"))
        .when(F.col("event.status").isin(constants.CLOSING_STATUSES), F.lit("closed"))
        .otherwise(F.lit("waiting"))
    )
    settled = [F.when(F.col("outcome") == "approved", F.col(f"attempt.{c}")).alias(c) for c in ("order_id", "total")]
    matched = found.withColumn("outcome", outcome).select(*[f"event.{c}" for c in names], "outcome", *settled)
    return matched.unionByName(bad.select(*names, "outcome"), allowMissingColumns=True)


@dataclass
class Settlement:
    """What a batch of payment events changes: new orders and what goes with them, and the answer to every event."""

    orders: DataFrame
    lines: DataFrame
    products: DataFrame
    customers: DataFrame
    outcomes: DataFrame
    consumed: DataFrame


def settle_payments(
    attempts: DataFrame,
    events: DataFrame,
    secret: str,
    products: DataFrame,
    customers: DataFrame,
    orders: DataFrame | None,
    minutes: int = constants.PAYMENT_LIFETIME_MINUTES,
    largest_order: Column | None = None,
    largest_customer: Column | None = None,
    timers: DataFrame | None = None,
) -> Settlement:
    """Paid orders of a batch of events, as if each was handled alone in order of event time, sending time and event id.

    ``attempts`` has attempt_id (unique), reference, items, total, user_id, customer and attempted_at; ``events`` has a
    unique event_id, what is signed, event_ts, and the payer's data. An approval makes an order of the waiting attempt
    at the attempt's prices if the payer gave an address and every item is in stock; then the attempt is gone. One that
    fails (outcome failed) leaves it waiting. Stock only falls within a batch, so of an attempt's approvals with an address the
    first one alone can succeed; no other is tried.

    Results: ``outcomes`` has one row per event (event_id, reference, outcome, order_id); ``consumed`` the attempt_id of each
    order; ``products`` and ``customers`` are the whole new tables. Ids follow the largest there is, or the numbers given.
    """
    good, bad = signed_events(events, secret)
    # What an order is made of is kept only where one may be made: of approvals with the payer's address that find an attempt.
    pays = (F.col("status") == constants.APPROVED) & sem.has_text("customer_email")
    found = attempts_in_force(
        attempts, good.withColumn("payer", F.when(pays, F.struct(*PAYER_FIELDS))), minutes, False, timers=timers,
        kept=[*NOTICE_FIELDS, "payer"], held=["attempt_id", "items", "total", "user_id", "customer"],
    )
    may_pay = F.col("attempt").isNotNull() & F.col("event.payer").isNotNull()
    found = materialise(
        found.select(
            F.struct(*[f"event.{c}" for c in NOTICE_FIELDS]).alias("event"),
            F.col("attempt").isNotNull().alias("waited"),
            "attempt.attempt_id",
            F.when(may_pay, F.struct("event", "attempt")).alias("payable"),
        ),
        "in_force",
    )
    tried = (
        found.filter(F.col("payable").isNotNull())
        .groupBy("attempt_id")
        .agg(F.min_by("payable", F.struct("event.event_ts", "event.sent_at", "event.event_id")).alias("_first"))
        .select("_first.*")
    )
    heads = number_rows(
        paid_order_heads(
            tried.select(
                *[f"event.{c}" for c in NOTICE_FIELDS], "event.payer.*", F.col("attempt.attempt_id").alias("attempt_id"), F.col("attempt.total").alias("total"),
                F.nullif(F.col("attempt.user_id"), F.lit(0)).alias("user_id"),
                F.col("attempt.customer.fullName").alias("attempt_name"), F.col("attempt.customer.phone").alias("attempt_phone"),
                F.col("attempt.items").alias("items"), F.col("event.event_ts").alias("created_at"),
            )
        ).select(*HEAD_FIELDS),
        ["event_ts", "sent_at", "event_id"], "request_id", "approvals",
    )
    wanted = heads.select("request_id", F.explode("items").alias("_i")).select(
        "request_id", "_i.product_id", "_i.quantity", F.col("_i.price").alias("unit_price")
    )
    decided = admit_orders(wanted, products.select("product_id", "stock"), seq="request_id")
    won = materialise(
        heads.join(decided.filter("accepted").select("request_id"), "request_id", "left_semi"), "settled"
    )
    buyers, buyer_of, _ = resolve_customers(customers, won.select("request_id", "name", "email"), largest=largest_customer)
    made = build_orders(won.drop("total"), won.select("request_id", "total"), buyer_of, orders, largest=largest_order)
    if orders is None and largest_order is None:
        made = materialise(made, "paid_orders")  # else numbering has written them
    sold = wanted.join(won.select("request_id"), "request_id", "left_semi")
    winners = won.join(made.select("request_id", "order_id"), "request_id").select(
        "attempt_id", F.struct("event_ts", "sent_at", "event_id").alias("_won"), F.col("order_id").alias("_order")
    )
    moment = F.struct("event.event_ts", "event.sent_at", "event.event_id")
    is_winner = F.coalesce(F.col("_moment") == F.col("_won"), F.lit(False))
    outcome = (
        F.when(F.col("_moment") > F.col("_won"), F.lit("not_found"))
        .when(is_winner, F.lit("approved"))
        .when(F.col("status") == constants.APPROVED, F.lit("failed"))
        .when(F.col("status").isin(constants.CLOSING_STATUSES), F.lit("closed"))
        .otherwise(F.lit("waiting"))
    )
    lost = found.filter("not waited").select("event.event_id", "event.reference", F.lit("not_found").alias("outcome"))
    outcomes = (
        found.filter("waited")
        .select("event.event_id", "event.reference", "event.status", "attempt_id", moment.alias("_moment"))
        .join(winners, "attempt_id", "left")
        .withColumn("outcome", outcome)
        .select("event_id", "reference", "outcome", F.when(is_winner, F.col("_order")).alias("order_id"))
        .unionByName(lost.unionByName(bad.select("event_id", "reference", "outcome")), allowMissingColumns=True)
    )
    return Settlement(
        orders=made.drop("request_id"),
        lines=build_order_lines(made, sold),
        products=apply_stock(products, sold),
        customers=buyers,
        outcomes=outcomes,
        consumed=winners.select("attempt_id"),
    )


def paid_order_heads(approved: DataFrame) -> DataFrame:
    """Order headers of approved payments. The payer's own data win over those of the attempt."""
    address = F.concat_ws(
        " ", F.coalesce("address_line_1", F.lit("")), F.coalesce("address_line_2", F.lit(""))
    )
    return approved.withColumns(
        {
            "name": sem.or_default("full_name", sem.or_default("attempt_name", constants.NAMELESS_PAYER)),
            "phone": sem.or_default("phone_number", F.col("attempt_phone")),
            "address": sem.js_trim(address),
            "department": F.col("region"),
            "complement": F.lit(None).cast("string"),
            "email": F.col("customer_email"),
            "method": F.lit(constants.WOMPI),
            "payment_ref": F.col("reference"),
        }
    )
