"""Which outputs have outlived their time. Listings only; nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value.
OUTPUT_TTL = "1 hour"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, time and size of files; the content column is not selected, so no bytes are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def _expired(now: Column, ttl: str) -> Column:
    # the bare column on one side lets the comparison reach the scan
    return F.col("modified") < now - F.expr(f"INTERVAL {ttl}")


def retention_sweep(files: DataFrame, now: Column, ttl: str = OUTPUT_TTL) -> DataFrame:
    """Files (path, modified, …) strictly older than the limit."""
    return files.filter(_expired(now, ttl))


def survivors(files: DataFrame, now: Column, ttl: str = OUTPUT_TTL) -> DataFrame:
    return files.filter(~_expired(now, ttl))
