"""Request limits and request metrics, as a batch over history and as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.functions.blocks import point_segments, prefix_sums

# Fixed values.
RATE_LIMIT = 30
WINDOW_MS = 60_000


def rate_limit(
    events: DataFrame, key: str, limit: int = RATE_LIMIT, window_ms: int = WINDOW_MS, ms: str = "ms", order: str = "event_id"
) -> DataFrame:
    """Events with (count, allowed, retry_after): windows open at a key's first event, not on the clock.

    Window starts come from the distinct times of a key, cut into ten-window blocks; the running count inside a window
    is a prefix sum over seconds. A key that owns a third of all events is spread over both.
    """
    starts = point_segments(events, [key], ms, float(window_ms), F.floor(F.col(ms) / (10 * window_ms)).cast("bigint"))
    starts = starts.select(key, F.col(ms).cast("bigint").alias(ms), F.col("anchor").cast("bigint").alias("window_start"))
    placed = events.join(starts, [key, ms])
    second = F.floor(F.col(ms) / 1000).cast("bigint")
    counted = prefix_sums(placed, [key, "window_start"], [ms, order], {"count": F.lit(1)}, second)
    wait = F.ceil((F.col("window_start") + window_ms - F.col(ms)) / 1000).cast("bigint")
    return (
        counted.withColumn("count", F.col("count") + 1)
        .withColumn("allowed", F.col("count") <= limit)
        .withColumn("retry_after", F.when(~F.col("allowed"), wait))
    )


class _Limiter(StatefulProcessor):
    """Per key: start and count of the open window."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit = limit
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start bigint, count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch is bounded by its trigger; arrival order inside it means nothing
        batch = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        start, count = self.window.get() if self.window.exists() else (None, 0)
        counts, allowed, waits = [], [], []
        for now in batch["ms"].tolist():
            if start is None or now - start > self.window_ms:
                start, count = now, 0
            count += 1
            counts.append(count)
            allowed.append(count <= self.limit)
            waits.append(None if count <= self.limit else math.ceil((start + self.window_ms - now) / 1000))
        self.window.update((start, count))
        yield pd.DataFrame(
            {
                "user_id": batch["user_id"].to_numpy(),
                "event_id": batch["event_id"].to_numpy(),
                "count": counts,
                "allowed": allowed,
                "retry_after": pd.array(waits, dtype="Int64"),
            }
        )

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int = RATE_LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same limiter on a stream of (user_id, event_id, ms), with its window in the state store."""
    return (
        events.select("user_id", "event_id", "ms")
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=_Limiter(limit, window_ms),
            outputStructType="user_id bigint, event_id bigint, count bigint, allowed boolean, retry_after bigint",
            outputMode="Append",
            timeMode="none",
        )
    )


def severity(status):
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Requests (ts, status, duration) with their log severity."""
    return requests.withColumn("severity", severity(F.col("status")))


def request_metrics(requests: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, severity, requests, max_duration) on batch or stream; late requests wait for `delay`."""
    outcomes = request_outcomes(requests)
    if outcomes.isStreaming:
        outcomes = outcomes.withWatermark("ts", delay)
    return (
        outcomes.groupBy(F.window("ts", window).alias("w"), "severity")
        .agg(F.count(F.lit(1)).alias("requests"), F.max("duration").alias("max_duration"))
        .select(F.col("w.start").alias("window_start"), "severity", "requests", "max_duration")
    )
