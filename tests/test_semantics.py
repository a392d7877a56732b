from pyspark.sql import functions as F

from retail_spark.functions import semantics as sem


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make("v").alias("out")).orderBy("i").collect()]


def test_leading_numbers(spark):
    texts = ["12abc", "", None, " 7.5x", "-3", "abc", ".5", "1e2z", "+4"]
    assert column(spark, texts, sem.js_float) == [12.0, None, None, 7.5, -3.0, None, 0.5, 100.0, 4.0]
    assert column(spark, texts, sem.js_int) == [12, None, None, 7, -3, None, None, 1, 4]


def test_number_guard_accepts_empty_text(spark):
    assert column(spark, ["5", "", " 5 ", "5x", None, "1.5"], sem.is_number_text) == [True, True, True, False, False, True]


def test_missing_text(spark):
    assert column(spark, ["a", "", None], sem.has_text) == [True, False, False]
    assert column(spark, ["a", "", None], lambda c: sem.or_default(c, "d")) == ["a", "d", "d"]


def test_pesos_round_half_up_and_use_dots(spark):
    texts = ["2.5", "1234567.49", "abc", None, "", "-1500.5", "999.5"]
    assert column(spark, texts, sem.format_cop) == [
        "$ 3", "$ 1.234.567", "$ 0", "$ 0", "$ 0", "-$ 1.501", "$ 1.000",
    ]


def test_number_text(spark):
    df = spark.sql("select explode(array(1234.50, 1200.00, 0.05, 100.00)) v")
    texts = [r[0] for r in df.select(sem.es_number(F.col("v").cast("decimal(18,2)"))).collect()]
    assert texts == ["1.234,5", "1.200", "0,05", "100"]


def test_phone_keeps_digits_and_always_gets_the_prefix(spark):
    assert column(spark, ["300 123-45", "+57 300"], sem.normalize_phone) == ["whatsapp:+5730012345", "whatsapp:+5757300"]


def test_money(spark):
    assert column(spark, ["10.235", "0.1"], lambda c: sem.total_in_cents(F.col(c).cast("decimal(18,3)"))) == [1024, 10]
    assert [str(v) for v in column(spark, ["10.235", "2"], sem.amount_2dp)] == ["10.24", "2.00"]


def test_trim_takes_all_white_space(spark):
    assert column(spark, ["\t a b \n"], sem.js_trim) == ["a b"]
