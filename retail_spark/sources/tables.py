"""Readers, append and JSON sinks, and tables kept as numbered snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark import schemas


def load(spark: SparkSession, folder: str, table: str, schema: str | None = None) -> DataFrame:
    """Scan one parquet table with its declared schema, so no file is opened to infer it."""
    ddl = schema or schemas.TABLES[table]
    return spark.read.schema(ddl).parquet(f"{folder}/{table}.parquet")


def load_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options
) -> DataFrame:
    """Scan a database table in parallel ranges of its numeric key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=key,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
            **options,
        )
        .load()
    )


def read_requests(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """Read JSON requests. A line that is no JSON keeps its text in ``_corrupt``."""
    reader = (spark.readStream if streaming else spark.read).schema(f"{schema}, _corrupt STRING")
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def split_corrupt(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readable requests, and the unreadable lines with a reason."""
    good = requests.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    bad = requests.filter(F.col("_corrupt").isNotNull()).select(
        F.col("_corrupt").alias("line"), F.lit("not_json").alias("reason")
    )
    return good, bad


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table with its schema, empty as long as nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def parse_requests(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Read JSON held in a text column, for message sources."""
    return lines.withColumn("_request", F.from_json(column, schema)).select(
        *[c for c in lines.columns if c != column], "_request.*"
    )


def payment_events(raw: DataFrame) -> DataFrame:
    """Flatten webhook messages; missing parts become null."""
    transaction = "data.transaction"
    return raw.select(
        F.col("signature.checksum").alias("checksum"),
        F.col("timestamp").alias("sent_at"),
        *[
            F.col(f"{transaction}.{name}").alias(name)
            for name in ("reference", "status", "amount_in_cents", "currency", "customer_email")
        ],
        F.col(f"{transaction}.customer_data.full_name").alias("full_name"),
        *[
            F.col(f"{transaction}.shipping_address.{name}").alias(name)
            for name in ("address_line_1", "address_line_2", "region", "city", "phone_number")
        ],
    )


def read_payment_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return payment_events(reader.schema(schemas.PAYMENT_WEBHOOK).json(path))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, as the store's endpoints answer."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, folder: str, table: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{table}.parquet")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Store a table hashed by ``key``: tables saved with the same bucket count join on it without a shuffle.

    Meant for orders and their lines, which meet in most of the large joins.
    """
    writer = df.write.bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


class SnapshotTable:
    """A table that jobs replace as a whole: plain parquet has no row updates.

    Every version is a folder of its own; a version counts once its line is in the
    commit log. Readers pick the newest committed one, so they never see half of a
    write. A batch number makes a replayed micro-batch a no-op.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version BIGINT, batch_id BIGINT").json(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def version(self) -> int:
        log = self._log()
        return 0 if log is None else log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def has_batch(self, batch_id: int) -> bool:
        log = self._log()
        return log is not None and not log.filter(F.col("batch_id") == batch_id).isEmpty()

    def current(self) -> DataFrame:
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def replace(self, df: DataFrame, batch_id: int | None = None) -> bool:
        """Write the next version; false when this batch was committed before."""
        if batch_id is not None and self.has_batch(batch_id):
            return False
        version = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        line = self.spark.createDataFrame([(version, batch_id)], "version BIGINT, batch_id BIGINT")
        line.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return True
