"""Checkout requests served in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark import schemas
from retail_spark.operators.checkout import place_orders, split_requests
from retail_spark.sources.tables import SnapshotTable, read_if_any

ORDER_SCHEMA = f"request_id BIGINT, {schemas.TABLES['orders']}"


def checkout_batches(
    products: SnapshotTable, customers: SnapshotTable, folder: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that places the orders of a micro-batch exactly once.

    Orders, lines and rejects go to one folder per batch under ``folder``, which a replay overwrites. The
    stock is committed last, under the batch number; a batch found there is passed over. Buyers of a
    batch that broke off are known by address when it is replayed, so they keep their ids.
    """

    def serve(requests: DataFrame, batch_id: int) -> None:
        if products.has_batch(batch_id):
            return
        spark = requests.sparkSession
        earlier = read_if_any(spark, f"{folder}/orders", f"{ORDER_SCHEMA}, batch BIGINT").filter(F.col("batch") < batch_id)
        heads, items = split_requests(requests)
        placed = place_orders(heads, items, products.current(), customers.current(), earlier)
        path = f"batch={batch_id}"
        placed.orders.write.mode("overwrite").parquet(f"{folder}/orders/{path}")
        placed.lines.write.mode("overwrite").parquet(f"{folder}/lines/{path}")
        placed.rejects.write.mode("overwrite").parquet(f"{folder}/rejects/{path}")
        customers.replace(placed.customers, batch_id)
        products.replace(placed.products, batch_id)

    return serve
