"""Session settings and the shared folder intermediate tables go to."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "retail_spark", master: str | None = None, **extra) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    Shuffle partitions are left to adaptive execution: start many, coalesce to
    about 128 MB. On a cluster raise ``spark.sql.shuffle.partitions`` with the data.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall
    back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="retail_spark_")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/retail_spark/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the plans
    that follow columnar pruning and real sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote, once nothing reads them any more."""
    _delete(df.sparkSession, {name.rpartition("/")[0] for name in df.inputFiles()})


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        if "/retail_spark/" in path:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Every table that ``materialise`` writes in this block, in this thread, is deleted at its end, and shuffle files of its jobs are let go.

    Spark deletes those when the driver's garbage is collected.
    """
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        paths, _scratch.paths = set(_scratch.paths), outer
        _delete(spark, paths)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
