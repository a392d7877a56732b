from retail_spark import schemas
from retail_spark.operators.maintenance import valid_contacts
from retail_spark.sources import tables
from retail_spark.sources.tables import SnapshotTable
from retail_spark.streaming import monitor, payments


def test_snapshots(spark, rows, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "id bigint, v string")
    assert table.version() == 0 and table.current().count() == 0
    assert table.replace(spark.createDataFrame([(1, "a")], table.schema))
    old = table.current()
    assert table.replace(old.unionByName(spark.createDataFrame([(2, "b")], table.schema)), batch_id=7)
    assert not table.replace(old, batch_id=7)
    assert table.version() == 2 and rows(table.current()) == [(1, "a"), (2, "b")]
    assert rows(old) == [(1, "a")]


def test_an_uncommitted_version_is_not_seen(spark, rows, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "id bigint")
    table.replace(spark.createDataFrame([(1,)], "id bigint"))
    spark.createDataFrame([(9,)], "id bigint").write.parquet(f"{table.path}/v=2")
    assert rows(table.current()) == [(1,)]
    table.replace(spark.createDataFrame([(2,)], "id bigint"))
    assert rows(table.current()) == [(2,)]


def test_requests_keep_unreadable_lines(spark, rows, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"request_id":1,"name":"Ana","email":"a","message":"m","subject":""}\nnot json\n{"request_id":2}\n')
    good, bad = tables.split_corrupt(tables.read_requests(spark, str(path), schemas.CONTACT_REQUEST).cache())
    assert rows(bad, "line", "reason") == [("not json", "not_json")]
    valid, rejects = valid_contacts(good)
    assert rows(valid, "request_id", "subject") == [(1, None)] and rows(rejects, "request_id") == [(2,)]


def test_webhook_parts_may_be_missing(spark, rows, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text(
        '{"signature":{"checksum":"c"},"timestamp":5,"data":{"transaction":{"reference":"r","amount_in_cents":0,'
        '"customer_data":{"full_name":"Ana"}}}}\n{"timestamp":6}\n'
    )
    got = tables.read_payment_events(spark, str(path))
    assert rows(got, "sent_at", "reference", "amount_in_cents", "full_name", "city") == [(5, "r", 0, "Ana", None), (6, None, None, None, None)]


def test_json_and_append_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, None)], "id bigint, v string")
    assert tables.to_json_rows(df).first()[0] == '{"id":1,"v":null}'
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"id":1,"v":null}'
    for _ in range(2):
        tables.append(df, str(tmp_path), "t")
    assert tables.load(spark, str(tmp_path), "t", "id bigint, v string").count() == 2


def test_pending_alarm_on_a_stream(spark, rows, tmp_path):
    source, looks = tmp_path / "changes", SnapshotTable(spark, str(tmp_path / "looks"), monitor.LOOK_SCHEMA)
    schema = "delta bigint"
    seen = []
    for deltas in ([1, 1], [-1], [1, 1]):
        spark.createDataFrame([(d,) for d in deltas], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        monitor.pending_monitor_stream(stream, looks, str(tmp_path / "checkpoint"), every=None).awaitTermination()
        seen += rows(looks.current())
    assert seen == [(2, 0, True), (1, 2, False), (3, 1, True)]


def test_settling_a_replayed_batch_changes_nothing(spark, rows, tmp_path):
    stock = SnapshotTable(spark, str(tmp_path / "stock"), "product_id bigint, stock int")
    stock.replace(spark.createDataFrame([(1, 3)], stock.schema))
    items = spark.createDataFrame(
        [("a", 1, 2), ("b", 1, 2), ("c", 1, 1)], "reference string, product_id bigint, quantity int"
    )
    settle = payments.settle_batches(stock, str(tmp_path / "orders"), lambda: items)

    def batch(*references):
        return spark.sql(
            "select reference, 'approved' outcome, 1L order_id, cast(1 as decimal(18,2)) total, 1L sent_at, "
            "timestamp'2024-01-01' event_ts from values " + ", ".join(f"('{r}')" for r in references) + " t(reference)"
        )

    for batch_id, references in ((0, ("a", "b")), (0, ("a", "b")), (1, ("a", "b", "c"))):
        settle(batch(*references), batch_id)
    assert rows(stock.current()) == [(1, 0)]
    assert rows(spark.read.parquet(str(tmp_path / "orders")), "reference", "batch") == [("a", 0), ("c", 1)]
