"""Test data fed to streams span by span."""

import datetime
import glob

from pyspark.sql import functions as F

from retail_spark.plans.streams import feed, serving
from retail_spark.session import materialise, new_path, scratch, shared_folder


def test_a_span_is_written_by_many_tasks_and_is_one_micro_batch(spark):
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 10 as int))")
    rows = spark.range(1000).select("id", day.alias("ts")).repartition(4)
    seen = {}

    def look(batch, number):
        files = batch.select(F.input_file_name().alias("f")).distinct().count()
        seen[number] = (files, batch.count(), *batch.agg(F.min("ts"), F.max("ts")).first())

    feed(rows, "ts", "rows", serving(look, new_path(spark, "look")), 3)
    assert [n for _, n, *_ in (seen[k] for k in range(3))] == [400, 300, 300]
    assert all(files > 1 for files, *_ in seen.values()) and len(seen) == 3
    first = datetime.datetime(2024, 1, 1)
    assert [((a - first).days, (b - first).days) for _, _, a, b in (seen[k] for k in range(3))] == [(0, 3), (4, 6), (7, 9)]


def test_a_span_without_rows_is_a_micro_batch_too(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 9)), (3, None)], "id int, ts timestamp_ntz")
    seen = {}

    def look(batch, number):
        seen[number] = [r.id for r in batch.collect()]

    feed(rows, "ts", "rows", serving(look, new_path(spark, "look")), 3)
    assert seen == {0: [1], 1: [], 2: [2]}


def test_the_files_of_a_served_span_are_gone(spark):
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 10 as int))")
    held = []
    look = lambda batch, number: held.append(spark.read.parquet(glob.glob(f"{shared_folder(spark)}/retail_spark/served-*")[0]).count())
    feed(spark.range(1000).select("id", day.alias("ts")), "ts", "served", serving(look, new_path(spark, "look")), 3)
    assert held == [400, 300, 300] and not glob.glob(f"{shared_folder(spark)}/retail_spark/served*")


def test_a_batch_leaves_no_tables_of_its_own(spark):
    outer = materialise(spark.range(5), "kept")
    with scratch(spark):
        materialise(spark.range(5), "scratched")
        with scratch(spark):
            materialise(spark.range(5), "scratched")
        assert len(glob.glob(f"{shared_folder(spark)}/retail_spark/scratched-*")) == 1
    assert not glob.glob(f"{shared_folder(spark)}/retail_spark/scratched-*") and outer.count() == 5
