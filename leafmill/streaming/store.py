"""A keyed store whose entries expire: as a batch over its history, and as a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.functions.blocks import carry_forward

# Fixed values.
TTL_MS = 2 * 60 * 60 * 1000
KEY_PATTERN = r"^[a-f0-9]{24}$"
HOUR_MS = 3_600_000


def store_reads(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(key, event_id, ms, payload, found): what every read returns.

    `events` is (key, event_id, op save/get/delete, ms, payload). A read sees the last save before it unless it was
    deleted or is older than the limit; reading does not extend it. The last write is carried forward over hourly blocks,
    so a hot key is not sorted in one task.
    """
    valid = events.filter(F.rlike("key", F.lit(KEY_PATTERN)) | (F.col("op") == "get"))
    write = F.when(F.col("op") != "get", F.struct("op", "ms", "payload"))
    seen = carry_forward(valid, ["key"], ["ms", "event_id"], write, F.floor(F.col("ms") / HOUR_MS).cast("bigint"), "_last")
    alive = (F.col("_last.op") == "save") & (F.col("ms") <= F.col("_last.ms") + ttl_ms) & F.rlike("key", F.lit(KEY_PATTERN))
    found = F.coalesce(alive, F.lit(False))
    return seen.filter("op = 'get'").select(
        "key", "event_id", "ms", F.when(found, F.col("_last.payload")).alias("payload"), found.alias("found")
    )


def store_snapshot(events: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """(key, payload, created_ms, expires_ms): entries alive at a time; one map-side combined aggregate."""
    writes = events.filter((F.col("op") != "get") & (F.col("ms") <= now_ms))
    last = writes.groupBy("key").agg(F.max_by(F.struct("op", "ms", "payload"), F.struct("ms", "event_id")).alias("w"))
    return last.filter((F.col("w.op") == "save") & (F.lit(now_ms) <= F.col("w.ms") + ttl_ms)).select(
        "key", F.col("w.payload").alias("payload"), F.col("w.ms").alias("created_ms"), (F.col("w.ms") + ttl_ms).alias("expires_ms")
    )


class _Store(StatefulProcessor):
    """Per key: the entry and when it expires; a timer clears it."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "payload string, expires bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        payload, expires = self.entry.get() if self.entry.exists() else (None, None)
        out = []
        for event_id, op, ms, value in batch[["event_id", "op", "ms", "payload"]].itertuples(index=False):
            if op == "save":
                payload, expires = value, ms + self.ttl_ms
            elif op == "delete":
                payload, expires = None, None
            else:
                found = expires is not None and ms <= expires
                out.append((key[0], event_id, ms, payload if found else None, found))
        if expires is None:
            self.entry.clear()
        else:
            self.entry.update((payload, int(expires)))
            self.handle.registerTimer(int(expires) + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "ms", "payload", "found"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a later save has moved the expiry on; its own timer will come
        if self.entry.exists() and expiredTimerInfo.getExpiryTimeInMs() > self.entry.get()[1]:
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def expiring_store(events: DataFrame, ttl_ms: int = TTL_MS, delay: str = "10 minutes") -> DataFrame:
    """The store on a stream of (key, event_id, op, ts, ms, payload): one row per read.

    Reads of malformed keys are answered without state, so that all of them together are no hot key.
    """
    valid = F.coalesce(F.rlike("key", F.lit(KEY_PATTERN)), F.lit(False))
    unanswered = events.filter((F.col("op") == "get") & ~valid).select(
        "key", "event_id", "ms", F.lit(None).cast("string").alias("payload"), F.lit(False).alias("found")
    )
    answered = (
        events.filter(valid)
        .withWatermark("ts", delay)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_Store(ttl_ms),
            outputStructType="key string, event_id bigint, ms bigint, payload string, found boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return answered.unionByName(unanswered)
