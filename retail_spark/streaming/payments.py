"""Payment events matched to waiting attempts on a stream, and approved ones settled against the stock."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retail_spark.constants import APPROVED, CLOSING_STATUSES, PAYMENT_LIFETIME_MINUTES
from retail_spark.functions.scale import number_rows
from retail_spark.operators.admission import admit_orders
from retail_spark.operators.payments import TERMINAL_STATUSES, attempts_in_force, verify_signature, waiting_attempts
from retail_spark.session import discard, materialise
from retail_spark.sources.tables import SnapshotTable, read_if_any
from retail_spark.sources.tableset import TableSet, TableSpec

ATTEMPT = "order_id BIGINT, user_id BIGINT, total DECIMAL(18,2), attempted_at TIMESTAMP, attempt_id BIGINT"
MICROS_PER_MINUTE = 60_000_000


@dataclass
class PaymentRows:
    """Attempts and signed events as one stream, and the rules they are matched by."""

    rows: DataFrame
    minutes: int
    delay: str
    approval_ends: bool


def match_payments_stream(
    attempts: DataFrame,
    events: DataFrame,
    secret: str,
    minutes: int = PAYMENT_LIFETIME_MINUTES,
    delay: str = "10 minutes",
    approval_ends: bool = True,
) -> PaymentRows:
    """A stream for ``write_matches``, which finds the outcome of every signed event as ``match_payments`` does in batch.

    Unsigned events are dropped here. With ``approval_ends`` off, an approved attempt stays, for callers whose approval may
    still fail. Attempts are forgotten once the newest row is ``delay`` past the end of their time.
    """
    attempt = F.struct("order_id", "user_id", "total", F.col("attempted_at").cast("timestamp").alias("attempted_at"))
    event = F.struct("status", "sent_at", F.col("event_ts").cast("timestamp").alias("event_ts"))
    stored = attempts.select("reference", attempt.alias("attempt"))
    signed = verify_signature(events, secret).filter(F.col("verdict") == "ok").select("reference", event.alias("event"))
    return PaymentRows(stored.unionByName(signed, allowMissingColumns=True), minutes, delay, approval_ends)


def match_batches(stream: PaymentRows, waiting: TableSet, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: matches of a micro-batch go to a folder of its own, which a replay overwrites.

    What waits is kept by reference in ``waiting``; only the batch's references are read and written. Rows of a
    micro-batch are handled in order of their times, after all of earlier ones, by the same scan as in batch, so
    that a reference may have any number of them.
    """
    life = stream.minutes * MICROS_PER_MINUTE
    ends = TERMINAL_STATUSES if stream.approval_ends else CLOSING_STATUSES

    def match(rows: DataFrame, batch_id: int) -> None:
        if waiting.has_batch("matches", batch_id):
            return
        rows = materialise(rows, "payment_rows")
        number = F.xxhash64("reference", "attempt", F.monotonically_increasing_id(), F.lit(batch_id)).alias("attempt_id")
        stored = rows.filter(F.col("attempt").isNotNull()).select("reference", "attempt.*", number)
        events = rows.filter(F.col("event").isNotNull()).select("reference", "event.*")
        newest = rows.agg(F.max(F.unix_micros(F.coalesce("attempt.attempted_at", "event.event_ts"))).alias("t")).first()["t"]
        delay = rows.select(F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00' + interval {stream.delay})").alias("d")).first()
        until = max(waiting.counter("until"), newest - delay["d"] if newest is not None else 0)
        references = materialise(rows.select("reference").distinct(), "references")
        held = materialise(waiting.read("attempt", references), "held")
        attempts = held.filter("waits").drop("waits").unionByName(stored)
        timers = held.filter("not waits").drop("waits")
        found = attempts_in_force(attempts, events, stream.minutes, stream.approval_ends, timers=timers)
        outcome = (
            F.when(F.col("attempt").isNull(), F.lit("not_found"))
            .when(F.col("event.status") == APPROVED, F.lit("approved"))
            .when(F.col("event.status").isin(CLOSING_STATUSES), F.lit("closed"))
            .otherwise(F.lit("waiting"))
        )
        settles = [F.when(F.col("outcome") == "approved", F.col(f"attempt.{c}")).alias(c) for c in ("order_id", "total")]
        names = ["event.reference", "event.status", "event.sent_at", "event.event_ts", "outcome"]
        found.withColumn("outcome", outcome).select(*names, *settles).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        left = waiting_attempts(attempts, events, timers, stream.minutes, F.lit(until), ends=ends)
        still = F.unix_micros("attempted_at") + life > until
        waiting.commit({"attempt": (references, left)}, None, {"until": until}, ("matches", batch_id), {"attempt": still})
        for table in (rows, references, held):
            discard(table)

    return match


def write_matches(stream: PaymentRows, path: str, checkpoint: str) -> StreamingQuery:
    """Run the matching until the sources are empty. What waits is kept beside ``path``."""
    path = path.rstrip("/")
    specs = {"attempt": TableSpec(f"reference STRING, {ATTEMPT}, waits BOOLEAN", "reference")}
    waiting = TableSet(stream.rows.sparkSession, f"{path}_waiting", specs)
    return (
        stream.rows.writeStream.foreachBatch(match_batches(stream, waiting, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settle_candidates(candidates: DataFrame, items: DataFrame, stock: DataFrame, settled: DataFrame) -> DataFrame:
    """The candidates that become orders, in event order, at most one per reference.

    ``items`` has (reference, product_id, quantity). References in ``settled`` are done. Two
    approvals of one reference compete: each also asks for one piece of a token of which one exists.
    A failed approval gives its token back to the next, as a retry may succeed.
    """
    fresh = candidates.join(settled.select("reference"), "reference", "left_anti")
    arrivals = number_rows(fresh, ["event_ts", "sent_at", "reference"], "seq", "candidates")
    tokens = number_rows(arrivals.select("reference").distinct(), ["reference"], "_token", "tokens")
    wanted = arrivals.select("seq", "reference").join(items, "reference").select("seq", "product_id", "quantity")
    claims = arrivals.join(tokens, "reference").select("seq", (-F.col("_token")).alias("product_id"), F.lit(1).alias("quantity"))
    supply = stock.select("product_id", "stock").unionByName(
        tokens.select((-F.col("_token")).alias("product_id"), F.lit(1).alias("stock"))
    )
    decided = admit_orders(wanted.unionByName(claims), supply)
    return arrivals.join(decided.filter("accepted").select("seq"), "seq", "left_semi")


def settle_batches(
    stock: SnapshotTable, orders_path: str, items: Callable[[], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that turns approved payments into orders exactly once.

    Orders go to a folder per batch, which a replay overwrites; the new stock is committed last,
    under the batch number, and a batch found committed is passed over.
    """

    def settle(matches: DataFrame, batch_id: int) -> None:
        if stock.has_batch(batch_id):
            return
        spark = matches.sparkSession
        schema = "reference STRING, order_id BIGINT, total DECIMAL(18,2), event_ts TIMESTAMP"
        done = read_if_any(spark, orders_path, f"{schema}, batch BIGINT").filter(F.col("batch") < batch_id)
        approved = matches.filter(F.col("outcome") == "approved")
        products = stock.current()
        new = settle_candidates(approved, items(), products, done).select(
            "reference", "order_id", "total", "event_ts"
        )
        path = f"{orders_path}/batch={batch_id}"
        new.write.mode("overwrite").parquet(path)
        saved = spark.read.schema(schema).parquet(path)
        taken = items().join(saved.select("reference"), "reference", "left_semi").groupBy("product_id").agg(
            F.sum("quantity").alias("_taken")
        )
        left = F.greatest(F.lit(0).cast("bigint"), F.col("stock") - F.coalesce("_taken", F.lit(0)))
        stock.replace(
            products.join(taken, "product_id", "left").select("product_id", left.cast("int").alias("stock")), batch_id
        )

    return settle
