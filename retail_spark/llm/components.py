"""Connected components of an edge table, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, group) for every node of ``edges`` (u, v): group is the smallest node that can be reached.

    Each round links every node and all its neighbours to the smallest among
    them: a grouped minimum and one join, so no neighbourhood is ever gathered. Paths shrink
    to a third of their length or less, until each group is a star. Edges are written each round, so
    that a lost executor costs no more than the round, and the one before is discarded.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    now, before = materialise(pairs.distinct(), "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("m"))
        linked = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        linked = linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        last, now = now, materialise(linked.distinct(), "stars")
        discard(last)
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(
        roots.select("node", F.col("node").alias("group"))
    )
