"""Registered queries: request limits, request metrics, the expiring store; each as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.plans.inputs import with_ctes
from leafmill.session import table
from leafmill.streaming import limits, store
from leafmill.streaming.runner import run_available, run_updates, stream_table

QUERIES = {}
ORACLES = {}

LIMIT, WINDOW = 3, 6 * 3_600_000


def timed(events: DataFrame) -> DataFrame:
    """Events with `ts` as an instant and in milliseconds, whatever the session's time zone."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return events.withColumn("ms", ms.cast("bigint")).withColumn("ts", F.timestamp_millis(F.col("ms")))


_LIMIT_COLUMNS = ["user_id", "event_id", "count", "allowed", "retry_after"]
QUERIES["rate_limit"] = lambda s, d: limits.rate_limit(
    timed(table(s, d, "events")).select("user_id", "event_id", "ms"), "user_id", LIMIT, WINDOW
).select(*_LIMIT_COLUMNS)
QUERIES["rate_limit_stream"] = lambda s, d: run_available(limits.rate_limit_stream(timed(stream_table(s, d, "events")), LIMIT, WINDOW))
ORACLES["rate_limit"] = ORACLES["rate_limit_stream"] = with_ctes(
    f"""ev AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
walk AS (
  SELECT user_id, event_id, i, ms, ms AS start, 1::BIGINT AS count FROM ev WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, e.ms, CASE WHEN e.ms - w.start > {WINDOW} THEN e.ms ELSE w.start END, CASE WHEN e.ms - w.start > {WINDOW} THEN 1 ELSE w.count + 1 END
  FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.i = w.i + 1)""",
    f"""SELECT user_id, event_id, count, count <= {LIMIT} AS allowed, CASE WHEN count > {LIMIT} THEN ceil((start + {WINDOW} - ms) / 1000)::BIGINT END AS retry_after FROM walk""",
)


def requests(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500 + F.col("event_id") % 4).when(F.col("event_type") == "signup", 404).otherwise(200)
    return timed(events).select("ts", status.alias("status"), F.col("value").alias("duration"))


def _metrics(df):
    return df.select(F.unix_millis("window_start").alias("window_start"), "severity", "requests", "max_duration")


QUERIES["request_metrics"] = lambda s, d: _metrics(limits.request_metrics(requests(table(s, d, "events"))))
ORACLES["request_metrics"] = """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS window_start,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS severity, count(*) AS requests, max(value) AS max_duration
FROM events GROUP BY ALL"""
# update mode, so that the windows the watermark has not passed yet are in the result as well
QUERIES["request_metrics_stream"] = lambda s, d: _metrics(
    run_updates(limits.request_metrics(requests(stream_table(s, d, "events"))), ["window_start", "severity"])
)
ORACLES["request_metrics_stream"] = ORACLES["request_metrics"]


def store_events(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type").isin("signup", "purchase"), "save").when(F.col("event_type") == "error", "delete").otherwise("get")
    key = F.when(F.col("event_id") % 50 == 0, "bad key").otherwise(F.substring(F.md5(F.col("user_id").cast("string")), 1, 24))
    return timed(events).select(key.alias("key"), "event_id", op.alias("op"), "ts", "ms", F.col("props").alias("payload"))


_STORE_SQL = """ev AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN 'bad key' ELSE substring(md5(user_id::VARCHAR), 1, 24) END AS key, event_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'save' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op, epoch_us(ts) // 1000 AS ms, props AS payload FROM events),
seen AS (
  SELECT *, last_value(CASE WHEN op <> 'get' THEN {'op': op, 'ms': ms, 'payload': payload} END IGNORE NULLS)
    OVER (PARTITION BY key ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM ev),
reads AS (
  SELECT key, event_id, ms, coalesce(w.op = 'save' AND ms <= w.ms + TTL AND key <> 'bad key', false) AS found, w FROM seen WHERE op = 'get')"""
TTL = 24 * 3_600_000
_STORE_SQL = _STORE_SQL.replace("TTL", str(TTL))
QUERIES["store_reads"] = lambda s, d: store.store_reads(store_events(table(s, d, "events")), TTL)
ORACLES["store_reads"] = with_ctes(_STORE_SQL, "SELECT key, event_id, ms, CASE WHEN found THEN w.payload END AS payload, found FROM reads")
QUERIES["expiring_store_stream"] = lambda s, d: run_available(store.expiring_store(store_events(stream_table(s, d, "events")), TTL))
ORACLES["expiring_store_stream"] = ORACLES["store_reads"]
_NOW = 1_705_320_000_000
QUERIES["store_snapshot"] = lambda s, d: store.store_snapshot(store_events(table(s, d, "events")), _NOW, TTL)
ORACLES["store_snapshot"] = with_ctes(
    _STORE_SQL,
    f"""SELECT key, payload, ms AS created_ms, ms + {TTL} AS expires_ms FROM (
  SELECT * FROM ev WHERE op <> 'get' AND ms <= {_NOW} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, event_id DESC) = 1)
WHERE op = 'save' AND {_NOW} <= ms + {TTL}""",
)
