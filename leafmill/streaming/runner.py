"""Running a streaming DataFrame over the files there are, into a table of the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.session import shared_folder

STATE_PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 64) -> DataFrame:
    """A given table replayed as a stream; the schema comes from the file footers, not from the data."""
    schema: StructType = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(sf_dir)
    )


def _run(stream: DataFrame, sink: DataStreamWriter, folder: str) -> None:
    spark = stream.sparkSession
    previous = spark.conf.get(STATE_PROVIDER_CONF, None)
    spark.conf.set(STATE_PROVIDER_CONF, ROCKSDB)
    try:
        sink.option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        if previous is None:
            spark.conf.unset(STATE_PROVIDER_CONF)
        else:
            spark.conf.set(STATE_PROVIDER_CONF, previous)


def run_available(stream: DataFrame) -> DataFrame:
    """Process everything available, exactly once, and hand back the resulting table."""
    folder = os.path.join(shared_folder(stream.sparkSession), f"stream-{uuid.uuid4().hex}")
    path = os.path.join(folder, "table")
    _run(stream, stream.writeStream.format("parquet").option("path", path).outputMode("append"), folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything available and hand back the last state of every key, also of windows still open.

    Each micro-batch writes the rows it changed into a folder of its own; a repeated batch overwrites its own folder, so
    nothing is counted twice. The latest batch of a key stands.
    """
    spark = stream.sparkSession
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    path = os.path.join(folder, "updates")

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch}"))

    _run(stream, stream.writeStream.foreachBatch(write).outputMode("update"), folder)
    batches = StructType(stream.schema.fields + [StructField("batch", LongType())])
    rest = [c for c in stream.columns if c not in keys]
    latest = spark.read.schema(batches).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
