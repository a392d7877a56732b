"""Packing: best-fit decreasing into token windows, with a segment tree over the remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.common import Sink
from retail_spark.llm.tokenizing import encode_words, special_cut, tokenizer, word_ids
from retail_spark.session import materialise

WINDOW = 2048
END_ID = 1
#: Pieces that one task packs together. More of them fill the windows better; each takes some 100 bytes there.
GROUP = 50_000

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every document's ids, closed by END_ID, cut into full windows and a rest: one row per piece.

    A null or empty text is one piece of one id. Rows with the same id are
    documents of their own. ``with_ids`` adds the ids as an array.
    """
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sink = word_ids(path), Sink(schema, rows=1024 if with_ids else 8192)
        special, end = special_cut(tokenizer(path)), END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = encode_words(value or "", ids, special) + end
                total = len(whole) // 4
                for start in range(0, total, window):
                    part = whole[4 * start : 4 * (start + window)]
                    row = (doc, start, len(part) // 4, zlib.crc32(part), total)
                    sink.add(*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else sink.add(*row)
                    if sink.full():
                        yield sink.take()
        yield sink.take()

    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(
        cut_up, out + (", ids array<int>" if with_ids else "")
    )


class Capacities:
    """A segment tree whose leaves are remaining capacities, holding how many open windows have each."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node //= 2

    def put(self, room: int, at: int) -> None:
        if room:
            self.open[room].append(at)
            self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the open window with the least room for ``length``, taken out; None if there is none."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right sibling holds some
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; ``lengths`` come longest first."""
    tree, n, places, offsets = Capacities(window), 0, [], []
    for length in lengths:
        found = tree.tightest(length) if length < window else None
        if found is None:
            found, n = (window, n), n + 1
        room, at = found
        places.append(at)
        offsets.append(window - room)
        tree.put(room - length, at)
    return places, offsets


def pack(parts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset: pieces in windows of ``window`` ids, gapless from 0.

    ``parts`` is a written table of pieces. It is dealt by hash of row and number into groups of about ``group`` pieces, repeated rows too,
    and each group is packed by best-fit decreasing. Ids of windows are the
    group's number above 32 bits of the window's; ties go by the pieces' other columns.
    """
    n = parts.count()
    groups = max(1, -(-n // group))
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset", "_group")]
    number = F.monotonically_increasing_id()  # the same on every reading of a written table; tells repeated rows apart
    key = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", number), F.lit(groups)).cast("int")
    schema = T.StructType(
        [*parts.select(*columns).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def packed(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.sort_by(order)
        places, offsets = best_fit(rows["length"].to_pylist(), window)
        base = rows["_group"][0].as_py() << 32
        rows = rows.select(columns)
        rows = rows.append_column("sequence_id", pa.array(np.array(places, np.int64) + base, pa.int64()))
        return rows.append_column("offset", pa.array(offsets, pa.int64()))

    return parts.select(*columns, key.alias("_group")).groupBy("_group").applyInArrow(packed, schema)


def packing_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece with the contract's columns."""
    return pack(materialise(pieces(docs, path or default_tokenizer()), "pieces"))
