from datetime import datetime
from decimal import Decimal as D

from retail_spark import schemas
from retail_spark.sources.tables import SnapshotTable
from retail_spark.streaming.checkout import checkout_batches


def request(request_id, cart, email="a@x"):
    customer = (None, "Ana", "300", "Calle 1", "Atl", "Baq", None, email)
    return (request_id, datetime(2024, 5, 1, 0, request_id), "ContraEntrega", [(p, q, D(1)) for p, q in cart], customer)


def test_stock_and_numbers_carry_over_and_replays_change_nothing(spark, rows, tmp_path):
    products = SnapshotTable(spark, str(tmp_path / "product"), schemas.TABLES["product"])
    customers = SnapshotTable(spark, str(tmp_path / "customer"), schemas.TABLES["customer"])
    products.replace(
        spark.createDataFrame([(1, "bolt", None, D("2.00"), "b", None, 1, 3, *[None] * 5)], schemas.TABLES["product"])
    )
    folder = str(tmp_path / "out")
    source = tmp_path / "requests"

    def run(*new):
        frame = spark.createDataFrame(list(new), schemas.CHECKOUT_REQUEST)
        frame.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schemas.CHECKOUT_REQUEST).parquet(str(source))
        stream.writeStream.foreachBatch(checkout_batches(products, customers, folder)).option(
            "checkpointLocation", str(tmp_path / "checkpoint")
        ).trigger(availableNow=True).start().awaitTermination()
        return frame

    first = run(request(1, [(1, 2)]), request(2, [(1, 2)], "b@x"))
    run(request(3, [(1, 1)], "b@x"), request(4, [(1, 1)], "c@x"))
    checkout_batches(products, customers, folder)(first, 0)
    assert rows(products.current(), "product_id", "stock") == [(1, 0)]
    assert rows(spark.read.parquet(f"{folder}/orders"), "order_id", "request_id", "customer_id") == [(1, 1, 1), (2, 3, 2)]
    assert rows(spark.read.parquet(f"{folder}/rejects"), "request_id", "reason") == [(2, "out_of_stock"), (4, "out_of_stock")]
    assert rows(customers.current(), "customer_id", "email") == [(1, "a@x"), (2, "b@x")]
