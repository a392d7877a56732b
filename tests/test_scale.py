import pytest
from pyspark.sql import functions as F

from retail_spark.functions.scale import hot_keys, number_rows, salted_join, with_split
from retail_spark.operators.orders import nest_items
from retail_spark.operators.text import chat_history_window
from retail_spark.session import materialise, shared_folder
from retail_spark.sources.testdata import Store


def skewed(spark):
    """A third of the rows share one key, some have none."""
    return spark.range(3000).select(
        F.col("id"), F.expr("case when id % 3 = 0 then 7 when id % 11 = 0 then null else id % 50 end").alias("k")
    )


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("a"))
    got = number_rows(df.repartition(8), ["a", "id"]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 5001))
    assert [(r.a, r.id) for r in got] == sorted((r.a, r.id) for r in got)


def test_hot_keys_are_those_with_many_rows(spark):
    hot = {r.k: r._splits for r in hot_keys(skewed(spark), ["k"], 300).collect()}
    assert 7 in hot and hot[7] >= 4 and len(hot) == 1


def test_a_key_is_hot_by_its_rows_not_by_its_share(spark):
    """400 of a million rows: far under a thousandth."""
    df = spark.range(1_000_000).select(F.when(F.col("id") < 400, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert [(r.k, r._splits) for r in hot_keys(df, ["k"], 100).collect()] == [(-1, 4)]


def test_hot_and_null_keys_are_spread(spark):
    df = skewed(spark)
    marked = with_split(df, ["k"], hot_keys(df, ["k"], 300), ["id"])
    parts = {r.k: r.n for r in marked.groupBy("k").agg(F.count_distinct("_split").alias("n")).collect()}
    assert parts[7] > 1 and parts[None] > 1 and parts[8] == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, rows, how):
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    many = skewed(spark)
    hot = hot_keys(many, ["k"], 300)
    assert rows(salted_join(many, one, ["k"], ["id"], how, hot), "id", "k", "v") == rows(many.join(one, "k", how), "id", "k", "v")


def test_huge_orders_are_paged_and_keep_every_item(spark):
    heads = spark.createDataFrame([(1,), (2,), (3,)], "order_id bigint")
    items = spark.range(1000).select(F.lit(1).cast("bigint").alias("order_id"), F.col("id").alias("product_id")).unionByName(
        spark.createDataFrame([(2, 5)], "order_id bigint, product_id bigint")
    )
    got = nest_items(heads, items.repartition(5), "order_id", ["product_id"], page_size=100).collect()
    pages = sorted((r for r in got if r.order_id == 1), key=lambda r: r.page)
    assert [(r.page, len(r["items"])) for r in pages] == [(p, 100) for p in range(10)]
    assert [i.product_id for r in pages for i in r["items"]] == list(range(1000))
    assert [(r.page, len(r["items"])) for r in got if r.order_id == 2] == [(0, 1)]
    assert [(r.page, r["items"]) for r in got if r.order_id == 3] == [(0, [])]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chat_windows_are_cut_before_the_shuffle(spark):
    turns = Store(spark, "/root/testdata/sf0.001").raw("conversations")
    text = plan(chat_history_window(turns, 2))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    from retail_spark.operators.catalog import product_by_id
    from retail_spark.operators.analytics import top_products_sold

    s = Store(spark, "/root/testdata/sf0.001")
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,42)]" in plan(product_by_id(s.products(), 42))
    text = plan(top_products_sold(s.order_lines(), s.products(), s.orders()))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_shared_folder_is_the_one_configured(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialise(spark.range(5), "t").count() == 5


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from retail_spark.operators.analytics import top_products_sold
    from retail_spark.sources.tables import save_bucketed

    s = Store(spark, "/root/testdata/sf0.001")
    plain = top_products_sold(s.order_lines(), s.goods(), s.orders())
    save_bucketed(s.orders(), "bucketed_orders", "order_id", 4, str(tmp_path / "orders"))
    save_bucketed(s.order_lines(), "bucketed_lines", "order_id", 4, str(tmp_path / "lines"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = top_products_sold(spark.table("bucketed_lines"), s.goods(), spark.table("bucketed_orders"))
        text = best._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(order_id" not in text
        assert best.collect() == plain.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_orders")
        spark.sql("drop table bucketed_lines")
