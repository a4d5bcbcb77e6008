"""Session helpers: a local session for tests, and tables staged in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_TABLES = ("documents", "pages", "conversations")
CHECKPOINT_CONF = "spark.checkpoint.dir"
#: a task may hold so many times its even share of a table's rows
UNEVEN = 2


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # so few shuffle partitions need no merging; merged, heavy text work would run on one core
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables; only a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder")
        folder = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def stage_table(df: DataFrame) -> DataFrame:
    """Write `df` once into the shared folder and go on from the written table.

    For results several later branches read: they are computed once, read back by column, and survive lost executors.
    """
    path = os.path.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return deal_out(df.sparkSession.read.schema(df.schema).parquet(path))


def deal_out(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer splits than the cluster has cores, or whose rows lie in a few of its splits.

    Text work is heavy per row, so a small file must not leave it to one core. A row group is read whole by one task,
    however many splits its file has: with large row groups most splits are empty. Rows per split are counted from the
    file footers; a table that is even enough is never shuffled here.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if splits >= cores and is_even(df, cores) else df.repartition(max(cores, splits))


def is_even(df: DataFrame, cores: int) -> bool:
    """Whether no task of a scan holds more than `UNEVEN` times the rows that each of `cores` would have."""
    held = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most"))
    found = held.first()
    return not found["rows"] or found["most"] * cores <= UNEVEN * found["rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return deal_out(df) if name in TEXT_TABLES else df
