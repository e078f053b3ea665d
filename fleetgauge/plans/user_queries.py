"""Registered queries: user code as an aggregate and as a table function."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.user import Aggregate, TableFunction, aggregate, table_function
from fleetgauge.plans.registry import query
from fleetgauge.plans.views import Views

LIMIT_MS = 60.0


class SlowCalls(Aggregate):
    """Calls, those over a limit, and the three highest distinct latencies."""

    state = result = "calls bigint, slow bigint, worst array<double>"

    def partial(self, rows: pd.DataFrame) -> tuple:
        latency = rows["latency_ms"].dropna()
        return len(rows), int((latency > LIMIT_MS).sum()), latency.drop_duplicates().nlargest(3).tolist()

    def merge(self, one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], one[1] + other[1], sorted({*one[2], *other[2]}, reverse=True)[:3]

    def finish(self, state: tuple) -> tuple:
        return state


@query("user_aggregate", "calls", f"""
WITH d AS (SELECT provider, model, latency_ms, row_number() OVER (PARTITION BY provider, model ORDER BY latency_ms DESC) AS rn
  FROM (SELECT DISTINCT provider, model, latency_ms FROM calls WHERE latency_ms IS NOT NULL))
SELECT c.provider, c.model, count(*) AS calls, count(*) FILTER (c.latency_ms > {LIMIT_MS}) AS slow,
  max(w.w1) AS worst, max(w.w3) AS third
FROM calls c LEFT JOIN (SELECT provider, model, max(latency_ms) FILTER (rn = 1) AS w1, max(latency_ms) FILTER (rn = 3) AS w3
  FROM d GROUP BY provider, model) w ON c.provider = w.provider AND c.model = w.model
GROUP BY c.provider, c.model""")
def _(v: Views) -> DataFrame:
    found = aggregate(v.calls.select("provider", "model", "latency_ms"), ["provider", "model"], SlowCalls())
    return found.select("provider", "model", "calls", "slow", F.get("worst", F.lit(0)).alias("worst"), F.get("worst", F.lit(2)).alias("third"))


class Bursts(TableFunction):
    """Runs of calls with at most `gap` seconds between neighbours: first and last time, calls and errors."""

    def __init__(self, gap: int):
        self.gap, self.n, self.errors = gap, 0, 0
        self.first = self.last = None

    @staticmethod
    def returns(schema: T.StructType, gap: int) -> T.StructType:
        if gap is None or gap < 0:
            raise ValueError("gap must be a number of seconds")
        at = schema["ts"].dataType
        return T.StructType().add("first_ts", at).add("last_ts", at).add("calls", T.LongType()).add("errors", T.LongType())

    def row(self, row: Row) -> Iterable[tuple]:
        if self.n and (row["ts"] - self.last).total_seconds() > self.gap:
            yield from self.end()
            self.n = self.errors = 0
        if self.n == 0:
            self.first = row["ts"]
        self.last = row["ts"]
        self.n += 1
        self.errors += row["status_code"] >= 500

    def end(self) -> Iterable[tuple]:
        yield self.first, self.last, self.n, self.errors


#: Bursts end at midnight, so that a partition is a provider's day.
call_bursts = table_function(Bursts, ["provider", "day"], ["ts"])


@query("user_table_function", "calls", """
WITH d AS (SELECT provider, CAST(ts AS DATE) AS day, ts, status_code,
  lag(ts) OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts) AS prev FROM calls),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 20 MINUTE THEN 1 ELSE 0 END)
  OVER (PARTITION BY provider, day ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM d)
SELECT provider, day, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS calls, count(*) FILTER (status_code >= 500) AS errors
FROM g GROUP BY provider, day, burst""")
def _(v: Views) -> DataFrame:
    calls = v.calls.select("provider", F.to_date("ts").alias("day"), "ts", "status_code")
    return call_bursts(calls.asTable(), gap=F.lit(1200))
