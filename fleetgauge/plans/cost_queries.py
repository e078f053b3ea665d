"""Registered queries: cost analytics and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, plan_chunks
from fleetgauge.operators import alerts, capacity, cost
from fleetgauge.operators.alerts import Rule
from fleetgauge.plans.registry import query
from fleetgauge.plans.traffic_queries import BY_TIME, rounded
from fleetgauge.plans.views import Views


def _times(v: Views) -> DataFrame:
    """Times of the cost items, from the fact table alone."""
    return v.lineitem.select(F.col("l_shipdate").alias("ts"))


_WEEK = """w AS (SELECT *, date_trunc('day', ts) AS period FROM cost_items
  WHERE ts > (SELECT max(ts) FROM cost_items) - INTERVAL 30 DAY AND service <> 'PROMO')"""


@query("cost_report", "cost_items", f"""
WITH {_WEEK}
SELECT CASE WHEN grouping(period) = 0 THEN 'period' WHEN grouping(service) = 0 THEN 'service' ELSE 'total' END AS level,
  CAST(period AS TIMESTAMP) AS period, service, round(sum(amount), 4) AS cost FROM w GROUP BY GROUPING SETS ((period), (service), ())""")
def _(v: Views) -> DataFrame:
    return rounded(cost.cost_report(v.cost_items, "weekly", tag=F.col("service") != "PROMO", times=_times(v)), "cost")


_SERVICES = """s AS (SELECT amount, CASE service WHEN 'PROMO' THEN 'Amazon EC2' WHEN 'ECONOMY' THEN 'S3 Lambda store'
  WHEN 'LARGE' THEN 'EBS' WHEN 'SMALL' THEN 'API Gateway' ELSE service END AS service FROM cost_items)"""


@query("cost_categories", "cost_items", f"""
WITH {_SERVICES}
SELECT round(sum(amount) FILTER (service IN ('Amazon EC2', 'S3 Lambda store')), 1) AS compute_cost,
  round(sum(amount) FILTER (service = 'EBS'), 1) AS storage_cost,
  round(coalesce(sum(amount) FILTER (service = 'API Gateway'), 0), 1) AS network_cost, round(sum(amount), 1) AS total_cost FROM s""")
def _(v: Views) -> DataFrame:
    names = {"PROMO": "Amazon EC2", "ECONOMY": "S3 Lambda store", "LARGE": "EBS", "SMALL": "API Gateway"}
    out = cost.cost_categories(v.cost_items.replace(names, subset=["service"]))
    return rounded(out, "compute_cost", "storage_cost", "network_cost", "total_cost", places=1)


@query("cost_by_provider", "cost_items", """
WITH d AS (SELECT provider, ts::DATE AS day, sum(amount) AS cost FROM cost_items GROUP BY ALL),
s AS (SELECT provider, sum(cost) AS total_cost, count(*) AS days FROM d GROUP BY provider)
SELECT p.provider, round(coalesce(total_cost, 0), 1) AS total_cost, coalesce(days, 0) AS days,
  round(coalesce(total_cost / days, 0), 4) AS mean_daily_cost
FROM (SELECT r_name AS provider FROM region UNION ALL SELECT lower(r_name) FROM region) p LEFT JOIN s ON s.provider = p.provider""")
def _(v: Views) -> DataFrame:
    names = v.region.select(F.col("r_name").alias("provider"))
    out = cost.cost_by_provider(v.cost_items, names.union(names.select(F.lower("provider"))))
    return rounded(rounded(out, "total_cost", places=1), "mean_daily_cost")


@query("cost_today_month", "cost_items", """
WITH n AS (SELECT max(ts) AS now FROM cost_items)
SELECT provider, model, CAST(grouping(provider, model) AS BIGINT) AS level,
  round(coalesce(sum(amount) FILTER (ts::DATE = now::DATE), 0), 4) AS today, round(sum(amount), 4) AS month
FROM cost_items, n WHERE date_trunc('month', ts) = date_trunc('month', now) GROUP BY CUBE (provider, model)""")
def _(v: Views) -> DataFrame:
    return rounded(cost.cost_today_month(v.cost_items, _times(v)), "today", "month")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("daily_cost_pivot", "cost_items", "SELECT ts::DATE AS day, " + ", ".join(
    f"""round(coalesce(sum(amount) FILTER (provider = '{r}'), 0), 4) AS "{r}\"""" for r in _REGIONS
) + " FROM cost_items GROUP BY 1")
def _(v: Views) -> DataFrame:
    return rounded(cost.daily_cost_pivot(v.cost_items, _REGIONS), *_REGIONS)


@query("cost_breakdown", "cost_items", """
SELECT service, round(sum(amount), 1) AS cost, round(100 * sum(amount) / (SELECT sum(amount) FROM cost_items), 4) AS share_pct
FROM cost_items GROUP BY service""")
def _(v: Views) -> DataFrame:
    return rounded(rounded(cost.cost_breakdown(v.cost_items, "service"), "cost", places=1), "share_pct")


_DAILY = """d AS (SELECT ts::DATE AS day, date_trunc('month', ts)::DATE AS month, sum(amount) AS cost FROM cost_items GROUP BY ALL)"""


@query("budget_status", "cost_items", f"""
WITH {_DAILY},
s AS (SELECT day, sum(cost) OVER (PARTITION BY month ORDER BY day) AS spent FROM d)
SELECT day, round(spent, 4) AS spent, round(spent / 2e7 * 100, 4) AS used_pct, round(2e7 - spent, 4) AS remaining,
  round((2e7 - spent) / 2e7, 6) AS remaining_ratio,
  CASE WHEN spent / 2e7 < 0.5 THEN '0-50' WHEN spent / 2e7 < 0.8 THEN '50-80' WHEN spent / 2e7 <= 1 THEN '80-100' ELSE 'over' END AS band,
  spent / 2e7 >= 0.8 AS alert, spent / 2e7 >= 0.9 AS alarm FROM s""")
def _(v: Views) -> DataFrame:
    out = cost.budget_status(v.cost_items, 2e7)
    return rounded(rounded(out, "spent", "used_pct", "remaining"), "remaining_ratio", places=6)


@query("cost_trend", "cost_items", f"""
WITH {_DAILY},
m AS (SELECT month, sum(cost) AS mtd, max(day) AS last FROM d GROUP BY month)
SELECT month, round(mtd, 4) AS month_to_date, round((mtd - lag(mtd) OVER w) / lag(mtd) OVER w * 100, 4) AS change_pct,
  round(mtd / CASE WHEN lead(month) OVER w IS NULL THEN day(last) ELSE day(last_day(month)) END * day(last_day(month)), 4) AS projected_month
FROM m WINDOW w AS (ORDER BY month)""")
def _(v: Views) -> DataFrame:
    return rounded(cost.cost_trend(v.cost_items), "month_to_date", "change_pct", "projected_month")


@query("cost_spikes", "cost_items", f"""
WITH {_DAILY},
j AS (SELECT day, cost, cost - lag(cost) OVER (ORDER BY day) AS jump FROM d)
SELECT day, round(cost, 4) AS cost, round(jump, 4) AS jump, cost > 1.2 * 800000 AS over_budget, coalesce(jump > 100000, false) AS spike
FROM j WHERE cost > 1.2 * 800000 OR jump > 100000""")
def _(v: Views) -> DataFrame:
    return rounded(cost.cost_spikes(v.cost_items, 800000, step=100000), "cost", "jump")


@query("cost_allocation", "cost_items", """
SELECT provider AS team, model AS environment, CAST(grouping(provider, model) AS BIGINT) AS level, round(sum(amount), 1) AS cost
FROM (SELECT provider, CASE WHEN model LIKE '%1' THEN 'untagged' ELSE model END AS model, amount FROM cost_items)
GROUP BY ROLLUP (provider, model)""")
def _(v: Views) -> DataFrame:
    environment = F.when(~F.col("model").endswith("1"), F.col("model"))
    tags = F.create_map(F.lit("team"), F.col("provider"), F.lit("environment"), environment)
    out = cost.cost_allocation(v.cost_items.withColumn("tags", tags), "tags", ["team", "environment"])
    return rounded(out, "cost", places=1)


# Alerts -------------------------------------------------------------------------

_SLOW = Rule("slow", "latency_ms", 40, 300, "warning")

_ISLANDS = """n AS (SELECT *, latency_ms > 40 AS breach, row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS rn FROM calls),
b AS (SELECT *, rn - row_number() OVER (PARTITION BY provider, breach ORDER BY rn) AS island FROM n),
r AS (SELECT provider, min(ts) AS run_start, max(ts) AS run_end, max(rn) AS last_rn, count(*) AS run_length FROM b WHERE breach GROUP BY provider, island),
a AS (SELECT r.provider, run_start, run_start + INTERVAL 300 SECOND AS fired_at, n.ts AS resolved_at, run_length
  FROM r LEFT JOIN n ON n.provider = r.provider AND n.rn = r.last_rn + 1 WHERE coalesce(n.ts, run_end) - run_start >= INTERVAL 300 SECOND)"""


def _slow(v: Views, chunks: Chunks | None = None) -> DataFrame:
    return alerts.alert_for_duration(v.calls, ["provider"], BY_TIME, _SLOW, chunks)


@query("alert_for_duration", "calls", f"""
WITH {_ISLANDS}
SELECT provider, 'slow' AS alert, 'warning' AS severity, run_start, fired_at, resolved_at, run_length FROM a""")
def _(v: Views) -> DataFrame:
    return _slow(v)


_PERIODS = """h AS (SELECT provider, date_trunc('hour', ts) AS period_start, avg(latency_ms) AS mean_value FROM calls GROUP BY ALL),
p AS (SELECT h.provider, h.period_start, h.period_start + INTERVAL 1 HOUR AS period_end, h.mean_value FROM h JOIN h g
  ON g.provider = h.provider AND g.period_start = h.period_start - INTERVAL 1 HOUR WHERE h.mean_value > 55 AND g.mean_value > 55)"""


def _periods(v: Views) -> DataFrame:
    return alerts.alarm_m_periods(v.calls, ["provider"], "ts", "latency_ms", 55, "1 hour")


@query("alarm_m_periods", "calls", f"""
WITH {_PERIODS}
SELECT provider, period_start, period_end, round(mean_value, 4) AS mean_value FROM p""")
def _(v: Views) -> DataFrame:
    return rounded(_periods(v), "mean_value")


_ALIGNED = """s AS (SELECT provider, user_id, date_trunc('hour', ts) AS ts, avg(latency_ms) AS m FROM calls GROUP BY ALL),
al AS (SELECT provider, ts, avg(m) AS v, avg(m) > 50 AS breach, row_number() OVER (PARTITION BY provider ORDER BY ts) AS rn FROM s GROUP BY provider, ts),
ai AS (SELECT *, rn - row_number() OVER (PARTITION BY provider, breach ORDER BY rn) AS island FROM al),
ar AS (SELECT provider, min(ts) AS run_start, max(ts) AS run_end, max(rn) AS last_rn, count(*) AS run_length FROM ai WHERE breach GROUP BY provider, island),
ae AS (SELECT ar.*, coalesce(least(al.ts, CASE WHEN run_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM al) THEN run_start + INTERVAL 7 DAY END), al.ts) AS resolved_at
  FROM ar LEFT JOIN al ON al.provider = ar.provider AND al.rn = ar.last_rn + 1),
aa AS (SELECT * FROM ae WHERE coalesce(resolved_at, run_end) - run_start >= INTERVAL 2 HOUR)"""


def _aligned(v: Views, chunks: Chunks | None = None) -> DataFrame:
    return alerts.alert_aligned(v.calls, ["user_id"], ["provider"], "ts", "latency_ms", 50, "1 hour", 7200, chunks)


@query("alert_aligned", "calls", f"""
WITH {_ALIGNED}
SELECT provider, 'latency_ms_aligned' AS alert, 'warning' AS severity, run_start, run_start + INTERVAL 2 HOUR AS fired_at, resolved_at, run_length FROM aa""")
def _(v: Views) -> DataFrame:
    return _aligned(v)


@query("alert_table", "calls", f"""
WITH {_ISLANDS}, {_PERIODS}, {_ALIGNED},
u AS (SELECT fired_at AS ts, 'warning' AS severity, provider AS resource, 'slow' AS message, resolved_at FROM a
  UNION ALL SELECT period_end, 'critical', provider, 'mean over two periods', period_end FROM p
  UNION ALL SELECT run_start + INTERVAL 2 HOUR, 'warning', provider, 'latency_ms_aligned', resolved_at FROM aa)
SELECT ts, severity, resource, message, CASE WHEN resolved_at IS NULL THEN 'Active' ELSE 'Resolved' END AS status FROM u""")
def _(v: Views) -> DataFrame:
    chunks = plan_chunks(v.events, "ts")
    runs = [
        df.select(F.col("fired_at").alias("ts"), "severity", F.col("provider").alias("resource"), F.col("alert").alias("message"), "resolved_at")
        for df in (_slow(v, chunks), _aligned(v, chunks))
    ]
    periods = _periods(v).select(
        F.col("period_end").alias("ts"), F.lit("critical").alias("severity"), F.col("provider").alias("resource"),
        F.lit("mean over two periods").alias("message"), F.col("period_end").alias("resolved_at"),
    )
    return alerts.alert_table([*runs, periods])


@query("rate_change_alert", "calls", """
WITH h AS (SELECT provider, date_trunc('hour', ts) AS window_start, count(*) AS requests FROM calls GROUP BY ALL),
c AS (SELECT *, (requests - lag(requests) OVER w) * 100.0 / lag(requests) OVER w AS change FROM h WINDOW w AS (PARTITION BY provider ORDER BY window_start))
SELECT provider, window_start, requests, round(change, 4) AS change_pct FROM c WHERE abs(change) > 50""")
def _(v: Views) -> DataFrame:
    return rounded(alerts.rate_change_alert(v.calls, ["provider"], "ts", "1 hour"), "change_pct")


@query("threshold_breaches", "fleet", """
WITH l AS (SELECT provider, arg_max(gpu_utilization, ts) AS duty, CAST(arg_max(queue_length, ts) AS DOUBLE) AS queue,
  CAST(arg_max(latency_p95, ts) AS DOUBLE) AS p95, arg_max(cost_per_hour, ts) AS cost FROM fleet GROUP BY provider),
u AS (SELECT provider, 'duty_cycle' AS metric, duty AS value, 'gpu_metrics' AS metric_group, 80.0::DOUBLE AS threshold FROM l
  UNION ALL SELECT provider, 'queue_length', queue, 'queue_metrics', 100.0 FROM l
  UNION ALL SELECT provider, 'latency_p95', p95, 'response_metrics', 1000.0 FROM l
  UNION ALL SELECT provider, 'cost_per_hour', cost, 'cost_metrics', 10.0 FROM l)
SELECT metric, provider, value, metric_group, threshold FROM u WHERE value > threshold""")
def _(v: Views) -> DataFrame:
    newest = v.fleet.groupBy("provider").agg(F.max_by(F.struct(
        F.col("gpu_utilization").alias("duty_cycle"), "queue_length", "latency_p95", "cost_per_hour"
    ), "ts").alias("l"))
    metrics = ["duty_cycle", "queue_length", "latency_p95", "cost_per_hour"]
    latest = newest.select("provider", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"l.{m}").cast("double").alias("value")) for m in metrics
    ])))
    return alerts.threshold_breaches(latest, capacity.threshold_table(v.spark, capacity.METRIC_THRESHOLDS))


@query("node_status", "node_metrics", """
WITH l AS (SELECT node, arg_max(gpu_utilization, ts) AS gpu, arg_max(queue_length, ts) * 30.0 AS cpu FROM node_metrics GROUP BY node)
SELECT node, CASE WHEN cpu > 80 OR gpu > 90 THEN 'Warning' ELSE 'Running' END AS status FROM l""")
def _(v: Views) -> DataFrame:
    latest = v.node_metrics.groupBy("node").agg(
        F.max_by("gpu_utilization", "ts").alias("gpu"), (F.max_by("queue_length", "ts") * 30.0).alias("cpu")
    ).withColumn("memory", F.lit(None).cast("double"))
    return alerts.node_status(latest, "cpu", "memory", "gpu").select("node", "status")
