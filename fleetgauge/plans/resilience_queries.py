"""Registered queries: resilience rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators import resilience
from fleetgauge.plans.registry import query
from fleetgauge.plans.traffic_queries import BY_TIME, failed, rounded
from fleetgauge.plans.views import Views

_BREAKER = """
WITH RECURSIVE n AS (SELECT provider, ts, call_id, status_code >= 500 AS failed, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS rn FROM calls),
b AS (
  SELECT provider, rn, ts, call_id, failed, 'CLOSED' AS state_before, false AS rejected,
    'CLOSED' AS state_after, CASE WHEN failed THEN 1 ELSE 0 END AS c, 0 AS h, CASE WHEN failed THEN us END AS lf
  FROM n WHERE rn = 1
  UNION ALL
  SELECT provider, rn, ts, call_id, failed, s AS state_before, s = 'OPEN' AS rejected,
    CASE WHEN s = 'OPEN' THEN 'OPEN'
      WHEN s = 'HALF_OPEN' THEN CASE WHEN failed THEN 'OPEN' WHEN h + 1 >= 2 THEN 'CLOSED' ELSE 'HALF_OPEN' END
      WHEN failed AND c + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END,
    CASE WHEN s = 'OPEN' THEN c WHEN s = 'HALF_OPEN' THEN CASE WHEN NOT failed AND h + 1 >= 2 THEN 0 ELSE c END
      WHEN failed THEN c + 1 ELSE 0 END,
    CASE WHEN s = 'HALF_OPEN' AND NOT failed THEN h + 1 ELSE 0 END,
    CASE WHEN s <> 'OPEN' AND failed THEN us ELSE lf END
  FROM (SELECT n.provider, n.rn, n.ts, n.call_id, n.failed, n.us, b.c, b.lf,
      CASE WHEN b.state_after = 'OPEN' AND n.us - b.lf >= 3600 * 1000000::BIGINT THEN 'HALF_OPEN' ELSE b.state_after END AS s,
      CASE WHEN b.state_after = 'HALF_OPEN' THEN b.h ELSE 0 END AS h
    FROM b JOIN n ON n.provider = b.provider AND n.rn = b.rn + 1))"""


def _breaker(v: Views) -> DataFrame:
    return resilience.circuit_breaker(
        v.calls, ["provider"], BY_TIME, failed(), failure_threshold=2, recovery_timeout=3600, half_open_max_calls=2
    )


@query("circuit_breaker", "calls", f"""{_BREAKER}
SELECT provider, ts, call_id, failed, state_before, rejected, state_after, CAST(c AS BIGINT) AS failure_count FROM b""")
def _(v: Views) -> DataFrame:
    return _breaker(v)


@query("breaker_status", "calls", f"""{_BREAKER}
SELECT provider, arg_max(state_after, rn) AS state, CAST(arg_max(c, rn) AS BIGINT) AS failure_count,
  max(ts) FILTER (failed AND NOT rejected) AS last_failure_ts, CAST(2 AS BIGINT) AS failure_threshold,
  3600.0::DOUBLE AS recovery_timeout FROM b GROUP BY provider""")
def _(v: Views) -> DataFrame:
    return resilience.breaker_status(_breaker(v), ["provider"], BY_TIME, 2, 3600)


@query("rate_limit_flags", "calls", """
SELECT provider, ts, call_id,
  count(*) OVER (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS calls_in_period,
  count(*) OVER (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) > 4 AS exceeded
FROM calls""")
def _(v: Views) -> DataFrame:
    return resilience.rate_limit_flags(v.calls, ["provider"], BY_TIME, calls=4, period=1800)


@query("rate_limit_admission", "calls", """
WITH RECURSIVE n AS (SELECT provider, ts, call_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS rn FROM calls),
a AS (SELECT provider, ts, call_id, rn, us, us AS admitted FROM n WHERE rn <= 3
  UNION ALL
  SELECT n.provider, n.ts, n.call_id, n.rn, n.us, greatest(n.us, a.admitted + 1800000000) FROM a JOIN n
    ON n.provider = a.provider AND n.rn = a.rn + 3)
SELECT provider, ts, call_id, (admitted - us) / 1e6 AS wait_seconds, ts + to_microseconds(admitted - us) AS admitted_ts FROM a""")
def _(v: Views) -> DataFrame:
    return resilience.rate_limit_admission(v.calls, ["provider"], BY_TIME, calls=3, period=1800)


@query("debounce", "calls", """
SELECT provider, call_id, ts, ts + INTERVAL 10 MINUTE AS emitted_ts FROM (
  SELECT *, lead(ts) OVER (PARTITION BY provider ORDER BY ts, call_id) AS nxt FROM calls)
WHERE nxt IS NULL OR nxt - ts >= INTERVAL 10 MINUTE""")
def _(v: Views) -> DataFrame:
    return resilience.debounce(v.calls.select("provider", "ts", "call_id"), ["provider"], BY_TIME, 600)


@query("ttl_cache_hits", "calls", """
WITH RECURSIVE n AS (SELECT endpoint, ts, call_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY endpoint ORDER BY ts, call_id) AS rn FROM calls),
c AS (SELECT endpoint, ts, call_id, rn, us AS stored, false AS hit FROM n WHERE rn = 1
  UNION ALL
  SELECT n.endpoint, n.ts, n.call_id, n.rn, CASE WHEN n.us - c.stored < 3600000000 THEN c.stored ELSE n.us END,
    n.us - c.stored < 3600000000 FROM c JOIN n ON n.endpoint = c.endpoint AND n.rn = c.rn + 1)
SELECT endpoint, ts, call_id, hit FROM c""")
def _(v: Views) -> DataFrame:
    return resilience.ttl_cache_hits(v.calls, ["endpoint"], BY_TIME, 3600)


@query("failure_stats", "calls", """
SELECT endpoint AS error_type, count(*) AS failures, max(ts) AS last_failure_ts FROM calls WHERE status_code >= 500 GROUP BY endpoint""")
def _(v: Views) -> DataFrame:
    typed = v.calls.select("ts", F.when(failed(), F.col("endpoint")).alias("error_type"))
    return resilience.failure_stats(typed, "error_type", "ts")


@query("retry_schedule", "calls", """
WITH s AS (SELECT call_id, user_id, ts, a AS attempt, 30.0 * (2.0 ** a - 1) AS delay_seconds FROM calls, range(4) r(a) WHERE status_code >= 500),
e AS (SELECT *, ts + to_microseconds(CAST(delay_seconds * 1000000 AS BIGINT)) AS expected_ts FROM s),
f AS (SELECT provider, ts AS matched_ts, call_id AS matched_id FROM calls)
SELECT e.call_id, e.attempt, round(e.delay_seconds, 4) AS delay_seconds, e.expected_ts,
  min(c.ts) AS matched_ts, arg_min(c.call_id, (c.ts, c.call_id)) AS matched_id
FROM e LEFT JOIN calls c ON c.user_id = e.user_id AND c.ts >= e.expected_ts AND c.ts <= e.expected_ts + INTERVAL 2 HOUR
GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    operations = v.calls.where(failed()).select("call_id", "user_id", "ts")
    planned = resilience.retry_schedule(
        operations.withColumn("op", F.struct("call_id", "user_id")), "op", "ts", base_delay=30.0
    ).select(F.col("op.user_id").alias("user_id"), F.col("op.call_id").alias("op_id"), "attempt", "delay_seconds", "expected_ts")
    out = resilience.match_attempts(
        planned, v.calls, "user_id", ["op_id", "attempt", "delay_seconds"], "ts", "call_id", 7200
    )
    return rounded(out.withColumnRenamed("op_id", "call_id").drop("user_id"), "delay_seconds")


def _length(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(words=batch["text"].str.split().str.len().fillna(0).astype("int64")).drop(columns="text")


@query("map_partitions", "", """
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents""")
def _(v: Views) -> DataFrame:
    return resilience.map_partitions(v.documents.select("doc_id", "text"), _length, "doc_id bigint, words bigint")
