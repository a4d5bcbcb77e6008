"""A stream in several micro-batches agrees with the batch over the same history."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.streaming import limits, store
from leafmill.streaming.runner import run_available, run_updates

EVENTS = "user_id bigint, event_id bigint, ms bigint, op string, payload string"


def history(n=120):
    rng = np.random.default_rng(2)
    ms = np.cumsum(rng.integers(100, 400_000, n)) + 1_700_000_000_000
    ops = rng.choice(["save", "get", "get", "delete"], n)
    return [(int(rng.integers(0, 3)), i, int(t), str(o), f"p{i}") for i, (t, o) in enumerate(zip(ms, ops))]


def split_stream(spark, rows, folder, parts):
    """Rows written as files that arrive in order, one per micro-batch."""
    for k, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        spark.createDataFrame([rows[i] for i in part], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={k:03d}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_rate_limit_stream(spark, tmp_path):
    rows = history()
    batch = limits.rate_limit(spark.createDataFrame(rows, EVENTS), "user_id", 2, 900_000)
    cols = ["user_id", "event_id", "count", "allowed", "retry_after"]
    stream = run_available(limits.rate_limit_stream(split_stream(spark, rows, tmp_path, 3), 2, 900_000))
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert [r[:4] for r in key(stream)] == [r[:4] for r in key(batch)]


def test_expiring_store_stream(spark, tmp_path):
    rows = history()
    keyed = lambda df: df.select(
        F.lpad(F.col("user_id").cast("string"), 24, "a").alias("key"), "event_id", "op", F.timestamp_millis("ms").alias("ts"), "ms", "payload"
    )
    ttl = 2_000_000
    batch = store.store_reads(keyed(spark.createDataFrame(rows, EVENTS)), ttl)
    stream = run_available(store.expiring_store(keyed(split_stream(spark, rows, tmp_path, 3)), ttl))
    key = lambda df: sorted((r["event_id"], r["payload"], r["found"]) for r in df.collect())
    assert key(stream) == key(batch)
    assert {r["found"] for r in batch.collect()} == {True, False}


def test_reads_of_malformed_keys_are_answered(spark, tmp_path):
    rows = [(1, 1, 1000, "save", "p"), (1, 2, 2000, "get", None), (2, 3, 3000, "get", None)]
    keyed = lambda df: df.select("user_id", "event_id", "op", F.timestamp_millis("ms").alias("ts"), "ms", "payload").select(
        F.when(F.col("event_id") != 2, "bad").alias("key"), "event_id", "op", "ts", "ms", "payload"
    )
    stream = run_available(store.expiring_store(keyed(split_stream(spark, rows, tmp_path, 2))))
    assert sorted((r["event_id"], r["key"], r["payload"], r["found"]) for r in stream.collect()) == [(2, None, None, False), (3, "bad", None, False)]


def test_request_metrics_stream_has_its_last_windows(spark, tmp_path):
    rows = history()
    asked = lambda df: df.select(F.timestamp_millis("ms").alias("ts"), F.when(F.col("op") == "get", 200).otherwise(500).alias("status"), F.col("event_id").alias("duration"))
    batch = limits.request_metrics(asked(spark.createDataFrame(rows, EVENTS)))
    stream = run_updates(limits.request_metrics(asked(split_stream(spark, rows, tmp_path, 4))), ["window_start", "severity"])
    key = lambda df: sorted(tuple(r) for r in df.select("window_start", "severity", "requests", "max_duration").collect())
    assert key(stream) == key(batch)
