"""Sinks: batches, manifests, ready/status messages, alerts, metrics.

Writes are overwrite-idempotent per target directory (a rerun of the same
epoch replaces its output), and every path lies under the shared folder or a
caller-given location, never a machine-local temp dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Range-partitioned on the directory column and a second one, so a
    directory's rows lie in one task, or a few for a large directory, and the
    number of files is about tasks plus directories."""
    return df.repartitionByRange(*columns)


def write_batches(batches: DataFrame, path: str, counted: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A5: one JSON document ``{bid, rids}`` per batch, with its object key,
    partitioned by flush window so a window's rewrite is independent.
    ``counted`` may observe what the store gets, after the shuffle."""
    docs = clustered(batches.select("flush_window", "bid", "batch_key", "rids"), "flush_window", "bid")
    ((counted(docs) if counted else docs)
     .write.mode("overwrite").partitionBy("flush_window").json(path))


def write_batch_manifest(batches: DataFrame, path: str) -> None:
    """Id-only pointer ``{bid, rids: []}``; call after ``write_batches``
    has committed, so a manifest never points at a missing batch."""
    (clustered(batches.select("flush_window", "bid", F.array().cast("array<string>").alias("rids")), "flush_window", "bid")
     .write.mode("overwrite").partitionBy("flush_window").json(path))


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


BATCH_DOC_SCHEMA = StructType([
    StructField("bid", StringType()), StructField("batch_key", StringType()),
    StructField("rids", ArrayType(LongType())), StructField("flush_window", LongType())])

MANIFEST_SCHEMA = StructType([
    StructField("bid", StringType()), StructField("rids", ArrayType(StringType())),
    StructField("flush_window", LongType())])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, spread_by: str | None = None) -> None:
    """Overwrite a table; with directories, rows are clustered by them first
    (a large directory is spread over tasks by ``spread_by``)."""
    if partition_by:
        df = clustered(df, *partition_by, *([spread_by] if spread_by else []))
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
