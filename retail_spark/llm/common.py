"""What several operators share: tables, streams of sorted rows, Python tasks."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark.session import new_path


#: Stands for a null id where one is needed: before every other.
NO_ID = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def box(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): all columns but the text in one struct, so that an operator's own names can't clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))


def unbox(boxed: DataFrame, docs: DataFrame, changed: Column, text: str = "text") -> DataFrame:
    """The columns of ``docs`` again, with the text of ``boxed``; ``n_chars`` is counted anew where the text has ``changed``."""

    def column(name: str) -> Column:
        if name == text:
            return F.col("text").alias(name)
        value = F.col("row").getField(name)
        if name == "n_chars":
            value = F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    return boxed.select(*map(column, docs.columns))


def per_worker(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker: made once, found again by later tasks."""
    kept = sys.modules.setdefault("_llm_worker_objects", types.ModuleType("_llm_worker_objects"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of sorted batches by runs of equal ``keys``: (key, columns as lists). One run is held at a time."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        marks = list(zip(*(columns[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[start]:
                continue
            part = {name: values[start:i] for name, values in columns.items()}
            if held is not None and marks[start] == key:
                for name, values in part.items():
                    held[name] += values
            else:
                if held is not None:
                    yield key, held
                key, held = marks[start], part
            start = i
    if held is not None:
        yield key, held


class Sink:
    """Collects rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 8192):
        self.schema, self.rows = schema, rows
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema
        )
        self.columns = [[] for _ in self.schema]
        return batch


def store_bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``, so that it can later be grouped without a shuffle."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name))
    writer.bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def text_key(name: str = "text"):
    """128 bits that stand for a text, null included; equal texts have equal keys."""
    return F.md5(F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8"))
