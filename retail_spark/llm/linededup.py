"""Line dedup: range-partitioned line hashes in order of document and place, streamed into keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.common import NO_ID, Sink, box, text_key, unbox
from retail_spark.session import materialise

# Fixed values of the contract.
STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3

#: What a streamed row says: the line goes; it waits for the other partitions; it only bears witness to a document.
GOES, WAITS, WITNESS = 0, 1, 2

LINES = "h1 bigint, h2 bigint, doc bigint, copy string, place int, n_lines int"
LINE_SCHEMA = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("copy", pa.string()), ("place", pa.int32()), ("n_lines", pa.int32())]
)
FATE_SCHEMA = LINE_SCHEMA.append(pa.field("fate", pa.int32()))


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: 128-bit hash of the key, document, hash of the text, place, lines in all."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(LINE_SCHEMA)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not value:
                    continue
                raw, copy = value.encode(), None
                lines = raw.split(b"\n")
                for place, line in enumerate(lines):
                    key = line.strip(STRIP).lower()  # of bytes: A-Z only
                    if _long_enough(key, min_chars):
                        copy = copy or hashlib.md5(raw).hexdigest()
                        digest = hashlib.blake2b(key, digest_size=16).digest()
                        h1, h2 = (int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8))
                        sink.add(h1, h2, NO_ID if doc is None else doc, copy, place, len(lines))
                if sink.full():
                    yield sink.take()
        yield sink.take()

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(split, LINES)


def _stream(min_documents: int):
    """Fates of the lines of one range partition, from one pass in order.

    The rows of a key come with the largest document first, so that document's
    lines stay and a later one's go once ``min_documents`` are seen. The first key of a
    partition may have begun in the one before: its lines wait. The last key may
    go on: its documents so far are left as witnesses, its undecided lines wait.
    """

    def fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(FATE_SCHEMA)
        key, first_run, seen, held, best = None, True, [], [], None

        def close(last: bool) -> None:
            if last and not first_run:
                for row in held:
                    sink.add(*row, WAITS)
                for doc in seen[:min_documents]:
                    sink.add(*key, doc, "", -1, 0, WITNESS)

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in LINE_SCHEMA.names]
            for row in zip(*columns, strict=True):
                if row[:2] != key:
                    if key is not None:
                        close(last=False)
                        first_run = False
                    key, seen, held, best = row[:2], [], [], row[2]
                doc = row[2]
                if first_run:
                    sink.add(*row, WAITS)
                elif len(seen) < min_documents:
                    if not seen or seen[-1] != doc:
                        seen.append(doc)
                    held.append(row)
                    if len(seen) == min_documents:
                        for r in held:
                            if r[2] != best:
                                sink.add(*r, GOES)
                        held = []
                elif doc != best:
                    sink.add(*row, GOES)
                if sink.full():
                    yield sink.take()
        if key is not None:
            close(last=True)
        yield sink.take()

    return fates


def keep_bitmaps(
    docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """One row per text that loses lines: doc, copy, n_lines, n_dropped, bitmap.

    ``doc`` is the id (NO_ID for null, taken as one document before all
    others), ``copy`` the hash of the text, since rows may share an id. The bitmap has one bit
    per line, 1 for kept, packed and deflated. Texts without a row keep all lines.

    The lines are dealt out by ranges of (hash, document, place), so that a line
    which a third of all documents share is spread over many partitions. Only a
    partition's first and last keys need the others: their number is at most two
    per partition, which is what the broadcast holds.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("copy"), F.col("place")]
    fates = materialise(
        line_hashes(docs, text, min_chars)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream(min_documents), LINES + ", fate int"),
        "line_fates",
    )
    waiting = fates.filter(F.col("fate") != GOES)
    edges = (
        waiting.select("h1", "h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.max("doc").alias("_best"), F.count(F.lit(1)).alias("_documents"))
        .filter(F.col("_documents") >= min_documents)
    )
    late = (
        fates.filter(F.col("fate") == WAITS)
        .join(F.broadcast(edges), ["h1", "h2"])
        .filter(F.col("doc") != F.col("_best"))
    )
    names = ["doc", "copy", "place", "n_lines"]

    @F.pandas_udf("binary")
    def bitmap(n_lines: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for n, gone in zip(n_lines, places, strict=True):
            keep = np.ones(n, np.uint8)
            keep[gone] = 0
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        return pd.Series(out, dtype=object)

    return (
        fates.filter(F.col("fate") == GOES)
        .select(*names)
        .unionByName(late.select(*names))
        .groupBy("doc", "copy")
        .agg(F.collect_set("place").alias("_places"), F.max("n_lines").alias("n_lines"))
        .select(
            "doc", "copy", "n_lines", F.size("_places").alias("n_dropped"), bitmap("n_lines", "_places").alias("bitmap")
        )
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, n_lines, n_dropped): ``text`` cut to its kept lines, beside a struct of all other columns.

    A null text stays null, and counts as one line like an empty one.
    """
    keyed = box(docs, text)
    row_type = keyed.schema["row"]
    keyed = keyed.withColumns(
        {"doc": F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(NO_ID)), "copy": text_key("text")}
    )
    joined = keyed.join(bitmaps.select("doc", "copy", "n_dropped", "bitmap"), ["doc", "copy"], "left")
    names = ["row", "text", "n_lines", "n_dropped"]
    numbers = [T.StructField(n, T.LongType()) for n in names[2:]]
    schema = T.StructType([row_type, T.StructField("text", T.StringType()), *numbers])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, dropped, packed = batch.columns
            texts, counts = values.to_pylist(), []
            for i, (value, bits) in enumerate(zip(texts, packed.to_pylist(), strict=True)):
                n_lines = (value or "").count("\n") + 1
                counts.append(n_lines)
                if bits is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines).tolist()
                    texts[i] = "\n".join(part for part, k in zip(value.split("\n"), keep, strict=True) if k)
            gone = pa.array([d or 0 for d in dropped.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(texts, values.type), pa.array(counts, pa.int64()), gone], names=names
            )

    return joined.select("row", "text", "n_dropped", "bitmap").mapInArrow(cut, schema)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document with the contract's columns."""
    docs = docs.select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that a larger document repeats, ``n_chars`` to match."""
    return unbox(apply_bitmaps(docs, keep_bitmaps(docs)), docs, F.col("n_dropped") > 0)


REPORT_SQL = r"""
with lines as (
  select doc_id, text, n_row, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as place
  from (select doc_id, coalesce(text, '') as text, row_number() over () as n_row from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), common as (
  select k, max(doc_id) as best from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3
), judged as (
  select keyed.*, best is not null and doc_id <> best as goes from keyed left join common using (k)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (goes)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not goes), '')) as kept_sha256
from judged group by n_row, doc_id
"""
