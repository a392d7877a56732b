"""Packing of repeated rows."""

from collections import Counter

from retail_spark.llm.packing import pack
from retail_spark.session import materialise


def test_repeated_rows_are_dealt_over_the_groups(spark):
    rows = [(None, 0, 1, 7, 1)] * 4000 + [(i, 0, 5, i, 5) for i in range(1000)]
    parts = spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    packed = pack(materialise(parts, "pieces"), window=16, group=100).collect()
    groups = Counter(r.sequence_id >> 32 for r in packed)
    assert len(packed) == 5000 and len(groups) == 50 and max(groups.values()) < 200
