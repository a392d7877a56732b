"""Streaming queries run to the end of the test data, so that they can be compared like the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retail_spark import schemas
from retail_spark.operators.maintenance import valid_contacts, valid_reviews
from retail_spark.plans import registry
from retail_spark.plans.registry import CART_STATE_SQL, CONTACTS_SQL, MATCH_SQL, REVIEWS_SQL, VIEWS_SQL, query
from retail_spark.session import discard, materialise, new_path
from retail_spark.sources.tableset import TableSet, TableSpec
from retail_spark.sources.testdata import TEST_SECRET, Store, StreamStore
from retail_spark.streaming import carts, ingest, payments, service


def drained(rows: DataFrame, label: str, start: Callable[[DataFrame, str, str], StreamingQuery]) -> DataFrame:
    """Run a stream until its sources are empty and read what it wrote."""
    spark = rows.sparkSession
    base = new_path(spark, label)
    started = start(rows, f"{base}/table", f"{base}/checkpoint")
    started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


def feed(rows: DataFrame, moment: str, label: str, start: Callable[[DataFrame], StreamingQuery], spans: int = 2) -> None:
    """Run a stream over ``rows`` in micro-batches of equal spans of days, oldest first.

    ``start`` starts it, until its source is drained, with the same checkpoint each time. A span's rows are written by as many tasks as
    Spark likes, and what has been written since the last time is one micro-batch, however many files it has. A span's files go when it is served.
    """
    spark = rows.sparkSession
    path = new_path(spark, label)
    rows = materialise(rows, f"{label}_rows")
    day = F.unix_date(F.col(moment).cast("date"))
    first, last = rows.agg(F.min(day), F.max(day)).first()
    span = F.floor((day - first) * spans / (last - first + 1))
    for number in range(spans):
        rows.filter(span == number).write.mode("append").option("compression", "zstd").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()
        discard(spark.read.schema(rows.schema).parquet(path))
    discard(rows)


def streamed(s: Store) -> StreamStore:
    return StreamStore(s.spark, s.folder)


@query("ingest_views_stream", VIEWS_SQL)
def _(s: Store):
    rows = ingest.valid_views(streamed(s).view_requests(), s.goods())
    return drained(rows, "views", ingest.append_stream)


@query("ingest_reviews_stream", REVIEWS_SQL)
def _(s: Store):
    return drained(valid_reviews(streamed(s).review_requests())[0], "reviews", ingest.append_stream)


@query("ingest_contacts_stream", CONTACTS_SQL)
def _(s: Store):
    return drained(valid_contacts(streamed(s).contact_requests())[0], "contacts", ingest.append_stream)


@query("match_payments_stream", f"select * from ({MATCH_SQL}) where outcome <> 'bad_signature'")
def _(s: Store):
    stream = streamed(s)
    matches = payments.match_payments_stream(stream.payment_attempts(), stream.payment_events(), TEST_SECRET)
    path = new_path(s.spark, "matches")
    payments.write_matches(matches, path, new_path(s.spark, "checkpoint")).awaitTermination()
    return s.spark.read.parquet(path).drop("batch").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query("cart_stream", CART_STATE_SQL)
def _(s: Store):
    """Two micro-batches by time."""
    kept = carts.open_carts(s.spark, new_path(s.spark, "carts"), buckets=16)
    checkpoint = new_path(s.spark, "checkpoint")
    feed(s.cart_events(), "ts", "cart_events", lambda rows: carts.cart_stream(rows, s.goods, kept, checkpoint))
    return carts.current_carts(kept)


# --- streams over tables with one commit log ---------------------------------------------------


def serving(serve: Callable[[DataFrame, int], None], checkpoint: str) -> Callable[[DataFrame], StreamingQuery]:
    """Starts a stream of micro-batches that runs until its source is drained."""
    return lambda rows: (
        rows.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stocked(s: Store) -> TableSet:
    """A new store with the products and buyers of the test data, and numbers that go on from theirs."""
    store = service.open_store(s.spark, new_path(s.spark, "store"), buckets=16)
    columns = [f.name for f in s.spark.createDataFrame([], schemas.TABLES["product"]).schema]
    goods = s.goods().withColumn("category_id", F.lit(None).cast("int"))
    store.load("product", goods.select(*columns))
    store.load("customer", s.customers())
    last = s.orders().agg(F.max("order_id").alias("o")).crossJoin(s.customers().agg(F.max("customer_id").alias("c"))).first()
    store.commit(counters={"order_id": last["o"], "customer_id": last["c"]})
    return store


def checked_out(s: Store) -> TableSet:
    """The store after a stream of checkout requests, in two micro-batches."""
    store = stocked(s)
    items = s.checkout_lines().groupBy("request_id").agg(
        F.collect_list(F.struct("product_id", "quantity", F.lit(None).cast("decimal(18,2)").alias("price"))).alias("cart")
    )
    customer = F.struct("user_id", "name", "phone", "address", "department", "city", "complement", "email")
    requests = s.checkout_heads().join(items, "request_id", "left").select(
        "request_id", "created_at", "method", "cart", customer.alias("customer")
    )
    feed(requests, "created_at", "requests", serving(service.checkout_service(store), new_path(s.spark, "checkout")))
    return store


@query("checkout_stream_orders", registry.placed_sql("true", registry.PLACED_ORDERS))
def _(s: Store):
    store = checked_out(s)
    answers = store.read("request_answer").filter(F.col("order_id").isNotNull()).select("request_id", "order_id")
    return store.read("orders").join(answers, "order_id").select(*registry.PLACED_COLUMNS)


@query("checkout_stream_lines", registry.placed_sql("true", registry.PLACED_LINES))
def _(s: Store):
    return checked_out(s).read("order_line")


@query("checkout_stream_stock", registry.placed_sql("true", registry.PLACED_STOCK))
def _(s: Store):
    return checked_out(s).read("product").select("product_id", "stock")


@query("checkout_stream_rejects", registry.PLACED_REJECTS_SQL)
def _(s: Store):
    return checked_out(s).read("request_answer").filter(F.col("order_id").isNull()).select("request_id", "reason")


def paid(s: Store) -> TableSet:
    """The store after a stream of payment attempts and events, in two micro-batches."""
    store = stocked(s)
    puts, notices = s.payment_puts(), s.payment_notices()
    attempt = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in s.spark.createDataFrame([], schemas.PAYMENT_ATTEMPT).schema])
    event = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in s.spark.createDataFrame([], schemas.PAYMENT_NOTICE).schema])
    rows = puts.select(F.col("attempted_at").alias("moment"), attempt.alias("attempt")).unionByName(
        notices.select(F.col("event_ts").alias("moment"), event.alias("event")), allowMissingColumns=True
    )
    feed(rows, "moment", "payment_rows", serving(service.payment_service(store, TEST_SECRET), new_path(s.spark, "payments")))
    return store


@query("settle_stream_orders", registry.settled_sql(registry.SETTLED_ORDERS))
def _(s: Store):
    return paid(s).read("orders")


@query("settle_stream_stock", registry.settled_sql("select k as product_id, cast(v as int) as stock from served where k >= 0"))
def _(s: Store):
    return paid(s).read("product").select("product_id", "stock")


@query("settle_stream_outcomes", registry.settled_sql(registry.SETTLED_OUTCOMES))
def _(s: Store):
    return paid(s).read("payment_answer")


@query(
    "pending_monitor_stream",
    "select cast(c as bigint) as pending_count, cast(c - d as bigint) as previous_count, c > 0 and c > c - d as alert, cast(y as bigint) as batch "
    "from (select y, d, sum(d) over (order by y) as c from (select floor((changed_at::date - lo) * 5 / (hi - lo + 1)) as y, sum(delta) as d "
    "from pending_change, (select min(changed_at)::date as lo, max(changed_at)::date as hi from pending_change) group by 1))",
)
def _(s: Store):
    """Every look of a watch that sees the changes of a fifth of all days at a time."""
    store = service.open_store(s.spark, new_path(s.spark, "store"))
    watch = new_path(s.spark, "watch")
    feed(s.pending_changes(), "changed_at", "changes", lambda rows: service.watch_pending(rows, store, watch, every=None), 5)
    return store.read("look")


def sorted_out(rows: DataFrame, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], name: str) -> DataFrame:
    """What a routed stream refuses."""
    spark = rows.sparkSession
    static = spark.createDataFrame([], rows.schema)
    schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    good, bad = split(static)
    store = TableSet(spark, new_path(spark, name), {name: TableSpec(schema(good)), f"{name}_reject": TableSpec(schema(bad))})
    serving(service.routed(split, store, name), new_path(spark, name))(rows).awaitTermination()
    return store.read(f"{name}_reject")


@query(
    "ingest_views_stream_rejects",
    "select *, case when try_cast(product_id as double) is null then 'bad_product_id' else 'unknown_product' end as reason from "
    "view_request where view_id not in (select view_id from view_request where try_cast(product_id as bigint) in (select product_id from product))",
)
def _(s: Store):
    return sorted_out(streamed(s).view_requests(), lambda rows: ingest.split_views(rows, s.goods()), "view")


@query(
    "ingest_reviews_stream_rejects",
    "select *, case when coalesce(name, '') = '' or coalesce(comment, '') = '' or coalesce(rating, 0) = 0 then 'missing_field' else "
    "'rating_out_of_range' end as reason from review_request where not coalesce(name <> '' and comment <> '' and rating between 1 and 5, false)",
)
def _(s: Store):
    return sorted_out(streamed(s).review_requests(), valid_reviews, "review")


@query(
    "ingest_contacts_stream_rejects",
    "select *, 'missing_field' as reason from contact_request where not coalesce(name <> '' and email <> '' and message <> '', false)",
)
def _(s: Store):
    return sorted_out(streamed(s).contact_requests(), valid_contacts, "contact")
