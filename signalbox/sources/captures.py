"""Captured polls as newline-delimited JSON, in batch and as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.schemas import CAPTURE, CAPTURE_ERROR


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_captures(spark: SparkSession, path: str, schema: str = CAPTURE) -> DataFrame:
    """One row per poll; blank lines are skipped and a missing path is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).filter(F.col("fetch_timestamp").isNotNull())


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return read_captures(spark, path, CAPTURE_ERROR)


def stream_captures(spark: SparkSession, path: str, max_files: int = 100, watermark: str = "30 minutes") -> DataFrame:
    """The same rows as they arrive, with ``fetched_at`` as event time."""
    polls = spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", max_files).json(path)
    return polls.filter(F.col("fetch_timestamp").isNotNull()).withColumn(
        "fetched_at", F.to_timestamp("fetch_timestamp")
    ).withWatermark("fetched_at", watermark)


def light(captures: DataFrame) -> DataFrame:
    """Fetch and header times only; the entity bodies are never read from the file's columns."""
    return captures.select(
        F.to_timestamp("fetch_timestamp").alias("fetched_at"),
        F.col("feed.header.timestamp").try_cast("bigint").alias("header"),
    )


def time_slice(captures: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Polls fetched at or after ``start`` and before ``end``."""
    at = F.to_timestamp("fetch_timestamp")
    return captures.filter((at >= F.lit(start)) & (at < F.lit(end)))


def write_slice(captures: DataFrame, path: str) -> None:
    captures.write.mode("overwrite").json(path)
