"""Edits of products' barcodes, decided as if applied one by one in order of position.

An edit stands when no other product bears its barcode at its turn. Then the product bears that barcode, or none, and
what it bore before is free. Whether an edit stands thus depends on which earlier ones did, through the product that
holds the barcode and through that product's later edits.

Every edit that stands, and every barcode borne before the first, opens a claim that ends with the product's next
standing edit of another barcode. As long as some edits are open, a claim's end has bounds: at the earliest the next
edit of another barcode that is not refused, at the latest the next one that stands. Each round compares an edit with the
claims on its barcode before it:

* a standing claim that surely lasts refuses it, or lets it stand if it is the product's own;
* it stands when all claims, also open ones, are surely over.

The earliest open edit is always decided, so the rounds end with the one-by-one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions.scale import ROWS_PER_SPLIT, number_rows
from retail_spark.session import new_path

OPEN, STANDS, REFUSED = "open", "stands", "refused"
ROUNDS_AT_ONCE = 2  # rounds between two writes
NEVER = 2**62  # the turn after all others


def _reach(rows: DataFrame, key: str, before: dict[str, Column], after: dict[str, Column], per_block: int) -> DataFrame:
    """Adds the largest of a value over all rows of ``key`` before each row, or the smallest over all rows after it.

    Rows are cut into blocks of ``per_block`` turns, so a key with any number of rows is spread: a row meets those of its
    own block, and one value a block stands for those of the others.
    """
    rows = rows.withColumns({"_block": F.floor(F.col("turn") / per_block), **before, **after})
    ahead, behind = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    sides = [(n, F.max, F.greatest, ahead) for n in before] + [(n, F.min, F.least, behind) for n in after]
    blocks = rows.groupBy(key, "_block").agg(*[pick(n).alias(n) for n, pick, _, _ in sides])
    over = Window.partitionBy(key).orderBy("_block")
    others = blocks.select(
        key, "_block", *[pick(n).over(over.rowsBetween(*frame)).alias(f"_other_{n}") for n, pick, _, frame in sides]
    )
    here = Window.partitionBy(key, "_block").orderBy("turn")
    local = rows.select("*", *[pick(n).over(here.rowsBetween(*frame)).alias(f"_here_{n}") for n, pick, _, frame in sides])
    joined = local.join(others, [key, "_block"])
    found = [best(f"_here_{n}", f"_other_{n}").alias(n) for n, _, best, _ in sides]
    return joined.select(*[c for c in rows.columns if c not in ("_block", *before, *after)], *found)


def _round(state: DataFrame, per_block: int) -> DataFrame:
    """Decides what can be decided. ``state`` has turn, product_id, barcode and state, without refused edits."""
    stands = F.col("state") == STANDS
    own = F.struct("turn", "barcode")
    last = _reach(state, "product_id", {"_last": own, "_last_standing": F.when(stands, own)}, {}, per_block)
    differs = lambda name: F.coalesce(F.col(f"{name}.barcode") != F.col("barcode"), F.lit(True))
    next_ = _reach(
        last,
        "product_id",
        {},
        {
            "_leaves": F.when(differs("_last"), F.col("turn")),
            "_left": F.when(stands & differs("_last_standing"), F.col("turn")),
            "_next": F.when(stands, own),
        },
        per_block,
    )
    # An open edit that stood would end with the next standing one of another barcode; if that has the same, no bound is known.
    latest = F.when(stands, F.col("_left")).when(F.col("_next.barcode") != F.col("barcode"), F.col("_next.turn"))
    earliest = F.coalesce("_leaves", F.lit(NEVER))
    held = _reach(
        next_.withColumn("_latest", F.coalesce(latest, F.lit(NEVER))),
        "barcode",
        {"_held": F.when(stands, F.struct(earliest.alias("till"), "product_id")), "_claimed": F.col("_latest")},
        {},
        per_block,
    )
    surely = F.coalesce(F.col("_held.till") >= F.col("turn"), F.lit(False))
    verdict = (
        F.when(F.col("state") != OPEN, F.col("state"))
        .when(surely & (F.col("_held.product_id") == F.col("product_id")), F.lit(STANDS))
        .when(surely, F.lit(REFUSED))
        .when(F.coalesce(F.col("_claimed") < F.col("turn"), F.lit(True)), F.lit(STANDS))
        .otherwise(F.lit(OPEN))
    )
    return held.select("turn", "product_id", "barcode", verdict.alias("state"))


def standing_edits(products: DataFrame, edits: DataFrame, position: str = "position", per_block: int = ROWS_PER_SPLIT) -> DataFrame:
    """``position`` of the edits that stand.

    ``products`` has product_id and barcode (null for none; no two products bear the same), ``edits`` product_id of
    known products, barcode and a unique position. Edits without barcode always stand. Only products that want or bear a
    barcode which two products want or bear take part in the rounds.
    """
    numbered = number_rows(edits.select("product_id", "barcode", F.col(position).alias("_position")), ["_position"], "turn", "edits")
    wanted = numbered.filter(F.col("barcode").isNotNull()).select("barcode", "product_id")
    held = products.select("barcode", "product_id").join(wanted.select("barcode").distinct(), "barcode", "left_semi")
    contested = (
        wanted.unionByName(held).groupBy("barcode").agg(F.min("product_id").alias("_a"), F.max("product_id").alias("_b")).filter("_a <> _b")
    ).select("barcode")
    marked = numbered.join(contested.withColumn("_contested", F.lit(True)), "barcode", "left")
    involved = (
        marked.filter("_contested").select("product_id").unionByName(held.join(contested, "barcode", "left_semi").select("product_id"))
    ).distinct()
    bare = F.coalesce("barcode", F.lit("")).alias("barcode")
    first = held.join(contested, "barcode", "left_semi").select(
        F.lit(0).cast("bigint").alias("turn"), "product_id", "barcode", F.lit(STANDS).alias("state")
    )
    opened = marked.join(involved, "product_id", "left_semi").select(
        "turn", "product_id", bare, F.when(F.col("_contested"), F.lit(OPEN)).otherwise(F.lit(STANDS)).alias("state")
    )
    spark = edits.sparkSession
    table = new_path(spark, "barcodes")
    schema = "turn BIGINT, product_id BIGINT, barcode STRING, state STRING"

    def save(number: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{table}/round={number}")
        return spark.read.schema(schema).parquet(f"{table}/round={number}")

    number = 0
    state = save(number, opened.unionByName(first))
    while not state.filter(F.col("state") == OPEN).isEmpty():
        number += 1
        now = state.filter(F.col("state") != REFUSED)
        for _ in range(ROUNDS_AT_ONCE):
            now = _round(now.filter(F.col("state") != REFUSED), per_block).unionByName(now.filter(F.col("state") == REFUSED))
        state = save(number, now)
    refused = (
        spark.read.schema(f"{schema}, round INT").parquet(table).filter(F.col("state") == REFUSED).select("turn").distinct()
    )
    return numbered.join(refused, "turn", "left_anti").select(F.col("_position").alias(position))
