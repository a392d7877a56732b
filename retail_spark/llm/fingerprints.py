"""Document fingerprints: the smallest phrase names of a locally consistent parsing, alike where texts share long stretches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.llm import parsing
from retail_spark.llm.hashing import mixed
from retail_spark.session import materialise

#: Code points a phrase covers to count. Shorter ones are common to all texts, longer ones fall to a single edit.
LEAST_SPAN, MOST_SPAN = 6, 40
#: Phrase names a fingerprint holds; the likeness of two larger texts is off by about 0.04.
SKETCH = 128

#: Rows that are worked on together.
ROWS = 512

RESULT = (
    "part int, kind int, doc_id bigint, text string, n_chars bigint, sha binary, print binary, edited binary, "
    "near_edited double, near_next double"
)
RESULT_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()),
        ("sha", pa.binary()), ("print", pa.binary()), ("edited", pa.binary()), ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
#: What a row of the stream says: a result; a partition's first text, for the one before it; its last text, which waits for the next.
DONE, FIRST, LAST = 0, 1, 2


def fingerprints(texts: list[str], size: int = SKETCH) -> list[bytes]:
    """The fingerprint of each text: 8 bytes of its root's name, then up to ``size`` phrase names of 4 bytes, ascending.

    Names are taken by their hash, so the sketch is a fair sample of all phrases of LEAST_SPAN to MOST_SPAN code points
    and the root. Empty texts have an empty fingerprint.
    """
    out = [b""] * len(texts)
    for start, part in parsing.parts(texts):
        full = [start + i for i, t in enumerate(part) if t]
        if not full:
            continue
        names, owners = [], []
        for level in parsing.levels(part):
            spans = level.spans()
            fits = np.flatnonzero((spans >= LEAST_SPAN) & (spans <= MOST_SPAN))
            names.append(level.names[fits])
            owners.append(level.owners()[fits])
        roots = level.names  # the last level has one name a text
        names.append(roots)
        owners.append(np.arange(len(full)))
        keys = np.concatenate(owners).astype(np.uint64) << np.uint64(32)
        keys |= mixed(np.concatenate(names)) >> np.uint64(32)
        keys.sort()  # by text, then by value
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        keys = keys[new]
        bounds = np.searchsorted(keys, np.arange(len(full) + 1, dtype=np.uint64) << np.uint64(32))
        sketch = keys.astype(np.uint32).astype(">u4")
        for k, i in enumerate(full):
            chosen = sketch[bounds[k] : min(bounds[k + 1], bounds[k] + size)]
            out[i] = int(roots[k]).to_bytes(8, "big") + chosen.tobytes()
    return out


def likeness(a: bytes, b: bytes, size: int = SKETCH) -> float:
    """How alike two texts are by their fingerprints, 0 to 1: the share of phrases both have among all of either.

    Of the ``size`` smallest names of both together, it counts those that both have. Equal texts give 1.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = np.sort(np.concatenate([np.frombuffer(a[8:], ">u4"), np.frombuffer(b[8:], ">u4")]).astype(np.uint32))
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    place = np.cumsum(new)  # a name of both stands twice, its second time not new
    return float(np.count_nonzero(~new & (place <= size)) / min(size, int(place[-1])))


def _edited(text: str, after: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of the beginning of ``after``."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _results(texts: list[str], after: list[str], prints: list[bytes], prints_after: list[bytes]) -> list[list]:
    """Columns n_chars to near_next of RESULT."""
    edited = [_edited(t, a) for t, a in zip(texts, after, strict=True)]
    edited_prints = fingerprints(edited)
    return [
        [len(t) for t in texts],
        [hashlib.sha256(e.encode()).digest() for e in edited],
        prints,
        edited_prints,
        [likeness(p, e) for p, e in zip(prints, edited_prints, strict=True)],
        [likeness(p, n) for p, n in zip(prints, prints_after, strict=True)],
    ]


def _batch(part: int, kind: int, ids: list, texts: list, numbers: list[list]) -> pa.RecordBatch:
    n = len(ids)
    columns = [[part] * n, [kind] * n, ids, texts, *(numbers or [[None] * n] * 6)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, RESULT_SCHEMA, strict=True)], schema=RESULT_SCHEMA
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a sorted partition with the one after it. One batch and one text before it are held."""
    unpack = zstandard.ZstdDecompressor()
    part, held = None, None  # the last text so far: id, text, fingerprint
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            ids = rows.column(1).to_pylist()
            texts = [unpack.decompress(x).decode() for x in rows.column(2).to_pylist()]
            prints = fingerprints(texts)
            if held is None:
                part = rows.column(0)[0].as_py()
                yield _batch(part, FIRST, ids[:1], texts[:1], [])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = ids[-1], texts[-1], prints[-1]
            yield _batch(part, DONE, ids[:-1], [None] * (len(ids) - 1), _results(texts[:-1], texts[1:], prints[:-1], prints[1:]))
    if held is not None:
        yield _batch(part, LAST, [held[0]], [held[1]], [])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        packed = [pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        tie = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "big", signed=True) for p in packed]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), pa.array(tie, pa.int64()), batch.column(2)],
            names=["doc_id", "packed", "tie", "place"],
        )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document with the contract's columns.

    Documents go by falling doc_id, null ids last, rows of one id by a hash of their text; each is compared with the next, the last one with
    the first. A null text is empty; an empty text has an empty fingerprint, which is like another empty one (1) and like nothing else (0).
    A single row follows itself. Repeated rows stand side by side, so each but one is followed by its copy. Other columns are passed over.

    Texts are deflated and dealt out by ranges of that order once. Only a partition's last text needs another partition's first:
    two texts a partition are written for that, and met by partition number.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("place")]
    packed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("place")
    ).mapInArrow(_pack, "doc_id bigint, packed binary, tie bigint, place bigint")
    followed = materialise(
        packed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "doc_id", "packed")
        .mapInArrow(_follow, RESULT),
        "fingerprints",
    )
    names = ["doc_id", "n_chars", "sha", "print", "edited", "near_edited", "near_next"]
    firsts = followed.filter(F.col("kind") == FIRST).select("part", F.col("text").alias("after"))
    around = firsts.select(  # one row a partition
        "part",
        F.coalesce(
            F.lead("part").over(Window.orderBy("part")),
            F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("next_part"),
    )
    ends = (
        followed.filter(F.col("kind") == LAST)
        .select("part", "doc_id", "text")
        .join(around, "part")
        .join(firsts.withColumnRenamed("part", "next_part"), "next_part")
        .select("doc_id", "text", "after")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, after = (c.to_pylist() for c in batch.columns)
            yield _batch(0, DONE, ids, [None] * len(ids), _results(texts, after, fingerprints(texts), fingerprints(after)))

    done = followed.filter(F.col("kind") == DONE).select(*names)
    both = done.unionByName(ends.mapInArrow(finish, RESULT).select(*names))
    text = lambda name: F.lower(F.hex(name))
    return both.select(
        "doc_id",
        "n_chars",
        text("sha").alias("edited_sha256"),
        text("print").alias("fingerprint"),
        text("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents with a column ``name`` for the fingerprint of their text, as bytes; a null text counts as empty."""

    @F.pandas_udf("binary")
    def sketch(values: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(values.fillna("").tolist()), dtype=object)

    return docs.withColumn(name, sketch(F.col(text)))


def near(a: str | Column, b: str | Column) -> Column:
    """The likeness of two fingerprint columns; null where one is null."""

    @F.pandas_udf("double")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return compared(a, b)
