"""Registered queries: telemetry, routing and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators import dashboards, routing, telemetry
from fleetgauge.plans.registry import query
from fleetgauge.plans.views import Views

EVENT_TYPES = ("view", "click", "signup", "purchase", "error")
BY_TIME = ["ts", "call_id"]


def failed() -> Column:
    return F.col("status_code") >= 500


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    """Round the named doubles so that summation order does not show."""
    return df.withColumns({n: F.round(n, places) for n in names})


# Telemetry -----------------------------------------------------------------

@query("counter_rollup", "calls", """
SELECT endpoint, method, status_code, count(*) AS value FROM calls GROUP BY endpoint, method, status_code""")
def _(v: Views) -> DataFrame:
    return telemetry.counter_rollup(v.calls, ["endpoint", "method", "status_code"])


@query("gauge_latest", "calls", """
SELECT model, provider, arg_max(latency_ms, call_id) AS value, max(ts) AS updated_at
FROM calls GROUP BY model, provider""")
def _(v: Views) -> DataFrame:
    return telemetry.gauge_latest(v.calls, ["model", "provider"], "latency_ms", BY_TIME)


_BOUNDS = ", ".join(f"('{b:g}', {b})" for b in telemetry.LATENCY_BOUNDS_MS)


@query("histogram_rollup", "calls", f"""
SELECT c.endpoint, b.le, count(*) FILTER (c.latency_ms <= b.bound) AS bucket_count,
  round(sum(c.latency_ms), 4) AS sum, count(c.latency_ms) AS count
FROM calls c CROSS JOIN (VALUES {_BOUNDS}, ('+Inf', 'infinity'::DOUBLE)) b(le, bound) GROUP BY c.endpoint, b.le""")
def _(v: Views) -> DataFrame:
    return rounded(telemetry.histogram_rollup(v.calls, ["endpoint"], "latency_ms"), "sum")


@query("request_metrics", "calls", """
SELECT CASE WHEN grouping(status_code) = 0 THEN 'count' WHEN grouping(method) = 0 THEN 'latency' ELSE 'size' END AS metric,
  endpoint, method, status_code, count(*) AS requests, round(sum(latency_ms), 4) AS latency_sum,
  CAST(sum(request_bytes) AS BIGINT) AS request_bytes, CAST(sum(length(endpoint)) AS BIGINT) AS response_bytes
FROM calls GROUP BY GROUPING SETS ((endpoint, method, status_code), (endpoint, method), (endpoint))""")
def _(v: Views) -> DataFrame:
    sized = v.calls.withColumn("response_bytes", F.length("endpoint"))
    return rounded(telemetry.request_metrics(
        sized, "endpoint", "method", "status_code", "latency_ms", "request_bytes", "response_bytes"
    ), "latency_sum")


@query("inference_metrics", "calls", """
SELECT model, provider, count(*) AS inferences, round(sum(latency_ms), 4) AS latency_sum,
  round(avg(latency_ms), 4) AS latency_mean,
  count(CASE WHEN event_type <> 'error' THEN event_type END) AS classified,
  CAST(arg_max(request_bytes, call_id) AS BIGINT) AS memory
FROM calls GROUP BY model, provider""")
def _(v: Views) -> DataFrame:
    seen = v.calls.withColumn("predicted", F.when(F.col("event_type") != "error", F.col("event_type")))
    seen = seen.withColumn("request_bytes", F.col("request_bytes").cast("bigint"))
    return rounded(telemetry.inference_metrics(
        seen, ["model", "provider"], "latency_ms", "request_bytes", "predicted", BY_TIME
    ), "latency_sum", "latency_mean")


@query("prediction_distribution", "calls", """
WITH n AS (SELECT date_trunc('day', ts) AS window_start, model, event_type AS prediction_class, count(*) AS predictions
  FROM calls WHERE event_type <> 'error' GROUP BY ALL)
SELECT window_start, model, prediction_class, predictions,
  round(100.0 * predictions / sum(predictions) OVER (PARTITION BY window_start, model), 4) AS share_pct FROM n""")
def _(v: Views) -> DataFrame:
    seen = v.calls.withColumn("predicted", F.when(F.col("event_type") != "error", F.col("event_type")))
    return rounded(telemetry.prediction_distribution(seen, "model", "predicted", "ts", "1 day"), "share_pct")


@query("component_status", "calls", """
WITH last AS (SELECT provider, model, max(call_id) AS last_id, max(ts) AS last_seen,
    arg_max(status_code, call_id) AS last_code, max(CASE WHEN status_code >= 500 THEN call_id END) AS down_id
  FROM calls GROUP BY provider, model),
since AS (SELECT c.provider, c.model, min(c.ts) AS since FROM calls c JOIN last l USING (provider, model)
  WHERE c.status_code < 500 AND c.call_id > coalesce(l.down_id, -1) GROUP BY c.provider, c.model)
SELECT l.provider, l.model, CAST(CASE WHEN l.last_code < 500 THEN 1 ELSE 0 END AS BIGINT) AS status, l.last_seen,
  CASE WHEN l.last_code < 500 THEN epoch_us((SELECT max(ts) FROM calls)) / 1e6 - epoch_us(s.since) / 1e6 ELSE 0.0 END AS uptime_seconds
FROM last l LEFT JOIN since s USING (provider, model)""")
def _(v: Views) -> DataFrame:
    return telemetry.component_status(v.calls, ["provider", "model"], BY_TIME, F.col("status_code") < 500)


@query("business_metrics", "calls", """
SELECT date_trunc('day', ts) AS window_start, count(DISTINCT user_id) AS active_users, count(*) AS inferences,
  round(count(*)::DOUBLE / count(DISTINCT user_id), 4) AS inferences_per_user,
  round(100.0 * count(*) FILTER (status_code >= 500) / count(*), 4) AS error_rate_pct
FROM calls GROUP BY 1""")
def _(v: Views) -> DataFrame:
    out = telemetry.business_metrics(v.calls, "ts", "1 day", "user_id", failed())
    return rounded(out, "inferences_per_user", "error_rate_pct")


@query("tier_usage", "calls", """
SELECT model, count(*) FILTER (tier = 'free') AS free, count(*) FILTER (tier = 'premium') AS premium
FROM calls GROUP BY model""")
def _(v: Views) -> DataFrame:
    return telemetry.tier_usage(v.calls, "model", "tier", ["free", "premium"])


@query("inferences_per_user", "calls", """
SELECT tier, count(*) AS inferences, count(DISTINCT user_id) AS users,
  round(count(*)::DOUBLE / count(DISTINCT user_id), 4) AS inferences_per_user FROM calls GROUP BY tier""")
def _(v: Views) -> DataFrame:
    return rounded(telemetry.inferences_per_user(v.calls, "tier", "user_id"), "inferences_per_user")


@query("queue_metrics", "calls", """
WITH g AS (SELECT model, arg_max(request_bytes, call_id) AS queue_length, arg_max(latency_ms, call_id) AS queue_latency
  FROM calls GROUP BY model),
e AS (SELECT model, provider AS error_type, count(*) AS errors FROM calls WHERE status_code >= 500 GROUP BY model, provider)
SELECT g.model, CAST(queue_length AS BIGINT) AS queue_length, queue_latency, error_type, coalesce(errors, 0) AS errors
FROM g LEFT JOIN e ON g.model = e.model""")
def _(v: Views) -> DataFrame:
    seen = v.calls.withColumn("request_bytes", F.col("request_bytes").cast("bigint"))
    return telemetry.queue_metrics(
        seen, "model", "request_bytes", "latency_ms", F.when(failed(), F.col("provider")), BY_TIME
    )


@query("infra_metrics", "calls", """
WITH last AS (SELECT provider, model, event_type, arg_max(latency_ms, call_id) AS value FROM calls
  GROUP BY provider, model, event_type)
SELECT provider, model, CAST(grouping(provider, model) AS BIGINT) AS level,
  round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view,
  round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click,
  round(coalesce(sum(value) FILTER (event_type = 'signup'), 0), 4) AS signup,
  round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS purchase,
  round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 4) AS error,
  round(coalesce(sum(value) FILTER (event_type = 'view'), 0) * 100 / 500.0, 4) AS view_quota_pct
FROM last GROUP BY ROLLUP (provider, model)""")
def _(v: Views) -> DataFrame:
    out = telemetry.infra_metrics(
        v.calls, "provider", "model", "event_type", list(EVENT_TYPES), "latency_ms", BY_TIME, {"view": 500.0}
    )
    return rounded(out, *EVENT_TYPES, "view_quota_pct")


@query("metric_timeseries", "calls", """
SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, provider, count(*) AS samples,
  round(avg(latency_ms), 4) AS mean_value, arg_max(latency_ms, call_id) AS last_value
FROM calls GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    return rounded(telemetry.metric_timeseries(v.calls, ["provider"], "latency_ms", BY_TIME, "15 minutes"), "mean_value")


# Routing --------------------------------------------------------------------

@query("provider_share", "calls", """
SELECT provider, count(*) AS requests, round(100.0 * count(*) / (SELECT count(*) FROM calls), 4) AS share_pct
FROM calls GROUP BY provider""")
def _(v: Views) -> DataFrame:
    return rounded(routing.provider_share(v.calls), "share_pct")


@query("provider_error_rate", "calls", """
SELECT provider, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors,
  round(100.0 * count(*) FILTER (status_code >= 500) / count(*), 4) AS error_rate_pct FROM calls GROUP BY provider""")
def _(v: Views) -> DataFrame:
    return rounded(routing.provider_error_rate(v.calls, failed()), "error_rate_pct")


_RECENT = """recent AS (SELECT provider, avg(latency_ms) AS avg_latency FROM (
  SELECT provider, latency_ms, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, call_id DESC) AS rn
  FROM calls WHERE status_code < 500) WHERE rn <= 100 GROUP BY provider)"""


@query("provider_recent_latency", "calls", f"""
WITH {_RECENT}
SELECT p.provider, round(coalesce(avg_latency, 0), 4) AS avg_latency
FROM (SELECT DISTINCT provider FROM calls) p LEFT JOIN recent r ON p.provider = r.provider""")
def _(v: Views) -> DataFrame:
    return rounded(routing.provider_recent_latency(v.calls, failed(), BY_TIME, "latency_ms"), "avg_latency")


def _routes(v: Views) -> DataFrame:
    """Path, provider and registration rank of every route seen in the calls."""
    rank = F.when(F.col("provider") == "aws", 1).when(F.col("provider") == "gcp", 2).otherwise(3)
    return v.calls.select(F.col("endpoint").alias("path"), "provider").distinct().withColumn("registration", rank)


@query("route_by_latency", "calls", f"""
WITH {_RECENT},
r AS (SELECT DISTINCT endpoint AS path, provider, CASE provider WHEN 'aws' THEN 1 WHEN 'gcp' THEN 2 ELSE 3 END AS registration FROM calls)
SELECT path, provider FROM (SELECT r.path, r.provider,
  row_number() OVER (PARTITION BY path ORDER BY coalesce(avg_latency, 'infinity'::DOUBLE), registration) AS rn
  FROM r LEFT JOIN recent ON r.provider = recent.provider) WHERE rn = 1""")
def _(v: Views) -> DataFrame:
    return routing.route_by_latency(
        _routes(v), routing.provider_recent_latency(v.calls, failed(), BY_TIME, "latency_ms")
    )


@query("route_by_weight", "calls", """
WITH w AS (SELECT provider, 1.0 / avg(latency_ms) AS weight FROM calls GROUP BY provider),
c AS (SELECT provider, sum(weight) OVER (ORDER BY provider) / sum(weight) OVER () AS upto FROM w),
x AS (SELECT call_id, ('0x' || substr(md5(CAST(call_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS x FROM calls)
SELECT call_id, coalesce((SELECT min(provider) FROM c WHERE c.upto >= x.x), (SELECT max(provider) FROM c)) AS routed_to FROM x""")
def _(v: Views) -> DataFrame:
    weights = v.calls.groupBy("provider").agg((F.lit(1.0) / F.avg("latency_ms")).alias("weight"))
    return routing.route_by_weight(v.calls.select("call_id"), weights, "call_id")


_GATEWAYS = """gw AS (SELECT *, concat(provider, '-', model) AS gateway FROM calls),
health AS (SELECT gateway, count(*) FILTER (status_code >= 500) < 1 AS healthy FROM (
  SELECT gateway, status_code, row_number() OVER (PARTITION BY gateway ORDER BY ts DESC, call_id DESC) AS rn FROM gw)
  WHERE rn <= 1 GROUP BY gateway),
routes AS (SELECT DISTINCT endpoint AS path, gateway AS provider FROM gw WHERE model <> 'm4'),
opened AS (SELECT gateway FROM gw GROUP BY gateway HAVING 5 * count(*) FILTER (status_code >= 500) > count(*))"""


def _gateways(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls by gateway, routes of the registered models, gateway health and breaker states."""
    gw = v.calls.withColumn("provider", F.concat_ws("-", "provider", "model"))
    routes = gw.where(F.col("model") != "m4").select(F.col("endpoint").alias("path"), "provider").distinct()
    health = routing.health_now(gw, ["provider"], BY_TIME, failed(), threshold=1)
    rates = routing.provider_error_rate(gw, failed())
    breakers = rates.select("provider", F.when(F.col("error_rate_pct") > 20, "OPEN").otherwise("CLOSED").alias("state"))
    return gw, routes, health, breakers


@query("available_providers", "calls", f"""
WITH {_GATEWAYS}
SELECT path, provider FROM routes WHERE provider IN (SELECT gateway FROM health WHERE healthy)
  AND provider NOT IN (SELECT gateway FROM opened)""")
def _(v: Views) -> DataFrame:
    _, routes, health, breakers = _gateways(v)
    return routing.available_providers(routes, health, breakers)


@query("health_state", "calls", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS rn FROM calls),
b AS (SELECT *, coalesce(max(CASE WHEN status_code < 500 THEN rn END) OVER (PARTITION BY provider ORDER BY ts, call_id), 0) AS base FROM n)
SELECT provider, ts, call_id, rn - base AS consecutive_failures,
  CASE WHEN rn - base >= 3 THEN 'unhealthy' ELSE 'healthy' END AS health FROM b""")
def _(v: Views) -> DataFrame:
    return routing.health_state(v.calls, ["provider"], BY_TIME, failed())


@query("request_outcome", "calls", f"""
WITH {_GATEWAYS},
avail AS (SELECT path, provider FROM routes WHERE provider IN (SELECT gateway FROM health WHERE healthy)
  AND provider NOT IN (SELECT gateway FROM opened))
SELECT call_id, CAST(CASE WHEN endpoint NOT IN (SELECT path FROM routes) THEN 404
  WHEN endpoint NOT IN (SELECT path FROM avail) OR gateway IN (SELECT gateway FROM opened) THEN 503
  WHEN status_code >= 500 THEN 500 ELSE 200 END AS BIGINT) AS outcome FROM gw""")
def _(v: Views) -> DataFrame:
    gw, routes, health, breakers = _gateways(v)
    requests = gw.select("call_id", F.col("endpoint").alias("path"), "provider", "status_code")
    available = routing.available_providers(routes, health, breakers)
    opened = breakers.where(F.col("state") == "OPEN")
    return routing.request_outcome(requests, routes, available, opened, failed()).select("call_id", "outcome")


_SUMMARY_SQL = """
h AS (SELECT provider, count(*) FILTER (status_code >= 500) < 3 AS healthy FROM (
  SELECT provider, status_code, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, call_id DESC) AS rn FROM calls)
  WHERE rn <= 3 GROUP BY provider)"""


@query("routing_summary", "calls", f"""
WITH {_RECENT}, {_SUMMARY_SQL}
SELECT g.n_name AS provider, g.region, g.deployed,
  CASE WHEN h.healthy IS NULL THEN 'unknown' WHEN h.healthy THEN 'healthy' ELSE 'unhealthy' END AS health,
  (SELECT count(DISTINCT endpoint) FROM calls c WHERE c.provider = g.n_name) AS routes_count,
  round(100.0 * (SELECT count(*) FROM calls c WHERE c.provider = g.n_name) / (SELECT count(*) FROM calls), 4) AS request_pct,
  round(coalesce(r.avg_latency, 0), 4) AS avg_latency
FROM (SELECT CASE n_nationkey WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' WHEN 2 THEN 'azure' ELSE lower(n_name) END AS n_name,
    r_name AS region, n_nationkey < 3 AS deployed FROM nation JOIN region ON n_regionkey = r_regionkey) g
LEFT JOIN h ON h.provider = g.n_name LEFT JOIN recent r ON r.provider = g.n_name""")
def _(v: Views) -> DataFrame:
    name = F.lower("n_name")
    for i, p in enumerate(("aws", "gcp", "azure")):
        name = F.when(F.col("n_nationkey") == i, p).otherwise(name)
    gateways = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        name.alias("provider"), F.col("r_name").alias("region"), (F.col("n_nationkey") < 3).alias("deployed")
    )
    out = routing.routing_summary(
        gateways, _routes(v), routing.provider_share(v.calls),
        routing.provider_recent_latency(v.calls, failed(), BY_TIME, "latency_ms"),
        routing.health_now(v.calls, ["provider"], BY_TIME, failed()),
    )
    return rounded(out, "request_pct", "avg_latency")


@query("gateway_metrics", "calls", f"""
WITH epoch AS (SELECT * FROM calls WHERE ts >= TIMESTAMP '2024-01-10'),
{_RECENT.replace("FROM calls", "FROM epoch")}, {_SUMMARY_SQL}
SELECT h.provider, coalesce(e.requests, 0) AS requests, coalesce(e.errors, 0) AS errors,
  round(coalesce(100.0 * e.requests / (SELECT count(*) FROM epoch), 0), 4) AS share_pct,
  round(coalesce(100.0 * e.errors / e.requests, 0), 4) AS error_rate_pct,
  round(coalesce(r.avg_latency, 0), 4) AS avg_latency, h.healthy
FROM h LEFT JOIN (SELECT provider, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors FROM epoch GROUP BY provider) e
  ON h.provider = e.provider LEFT JOIN recent r ON h.provider = r.provider""")
def _(v: Views) -> DataFrame:
    out = routing.gateway_metrics(v.calls, failed(), BY_TIME, "latency_ms", reset_ts="2024-01-10")
    return rounded(out, "share_pct", "error_rate_pct", "avg_latency")


# Dashboards -------------------------------------------------------------------

@query("request_summary", "calls", """
SELECT count(*) AS requests, round(100.0 * count(*) FILTER (status_code < 500) / count(*), 4) AS success_pct,
  round(avg(latency_ms), 4) AS mean_latency, round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency FROM calls""")
def _(v: Views) -> DataFrame:
    return rounded(dashboards.request_summary(v.calls, "latency_ms", failed()), "success_pct", "mean_latency", "p95_latency")


@query("requests_per_model", "calls", "SELECT model, count(*) AS requests FROM calls GROUP BY model")
def _(v: Views) -> DataFrame:
    return dashboards.requests_per_model(v.calls, "model")


@query("endpoint_latency", "calls", """
SELECT endpoint, round(avg(latency_ms), 4) AS mean_latency, count(*) AS requests,
  round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95,
  round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM calls GROUP BY endpoint""")
def _(v: Views) -> DataFrame:
    return rounded(dashboards.endpoint_latency(v.calls, "endpoint", "latency_ms"), "mean_latency", "p50", "p95", "p99")


def _series_sql(points: int, step: int, aggs: str, names: str) -> str:
    return f"""
WITH n AS (SELECT max(ts) AS now FROM calls),
b AS (SELECT c.*, CAST(floor((epoch_us(n.now) - epoch_us(c.ts)) / {step * 1000000}.0) AS BIGINT) AS back FROM calls c, n),
g AS (SELECT back, {aggs} FROM b WHERE back < {points} GROUP BY back)
SELECT CAST({points - 1} - i AS BIGINT) AS point, n.now - to_seconds(i * {step}) AS point_ts, {names}
FROM range({points}) r(i) CROSS JOIN n LEFT JOIN g ON g.back = r.i"""


@query("time_range_series", "calls", _series_sql(
    60, 1440, "count(*) AS requests, round(avg(latency_ms), 4) AS mean_latency",
    "coalesce(requests, 0) AS requests, mean_latency",
))
def _(v: Views) -> DataFrame:
    aggs = {"requests": F.count(F.lit(1)), "mean_latency": F.round(F.avg("latency_ms"), 4)}
    return dashboards.time_range_series(v.calls, "ts", "Last 24 hours", aggs).fillna(0, ["requests"])


@query("resource_series", "calls", _series_sql(
    30, 86400,
    "round(least(greatest(avg(latency_ms) FILTER (event_type = 'click'), 0.0), 100.0), 6) AS click, "
    "round(avg(latency_ms) FILTER (event_type = 'view'), 6) AS view, "
    + ", ".join(f"round(least(greatest(avg(latency_ms) FILTER (event_type = '{e}'), 0.0), 100.0), 6) AS {e}" for e in EVENT_TYPES[2:]),
    "click, view, signup, purchase, error",
))
def _(v: Views) -> DataFrame:
    out = dashboards.resource_series(
        v.calls, "ts", "event_type", "latency_ms", ["click", "view", *EVENT_TYPES[2:]], ("view",), "Last 30 days"
    )
    return rounded(out, *EVENT_TYPES, places=6)


@query("rate_and_error_series", "calls", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS requests,
  round(count(*) / 60.0, 4) AS requests_per_minute,
  round(100.0 * count(*) FILTER (status_code >= 500) / count(*), 4) AS error_pct FROM calls GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return rounded(dashboards.rate_and_error_series(v.calls, "ts", "1 hour", failed()), "requests_per_minute", "error_pct")


@query("kpi_delta", "calls", """
WITH k AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS requests,
  100.0 * count(*) FILTER (status_code < 500) / count(*) AS success_pct, avg(latency_ms) AS mean_latency FROM calls GROUP BY 1)
SELECT window_start, requests, round(success_pct, 4) AS success_pct, round(mean_latency, 4) AS mean_latency,
  requests - lag(requests) OVER w AS requests_delta,
  round(success_pct - lag(success_pct) OVER w, 4) AS success_pct_delta,
  round(mean_latency - lag(mean_latency) OVER w, 4) AS mean_latency_delta
FROM k WINDOW w AS (ORDER BY window_start)""")
def _(v: Views) -> DataFrame:
    out = dashboards.kpi_delta(v.calls, "ts", "1 day", "latency_ms", failed())
    return rounded(out, "success_pct", "mean_latency", "success_pct_delta", "mean_latency_delta")


@query("cluster_cards", "cost_items", """
SELECT r.r_name AS provider, CASE WHEN i.nodes > 0 THEN 'Running' ELSE 'Stopped' END AS status,
  (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS region,
  coalesce(i.nodes, 0) AS nodes, coalesce(i.pods, 0) AS pods, round(coalesce(c.cost, 0), 4) AS cost_per_hour
FROM region r LEFT JOIN (SELECT n_regionkey, count(*) AS pods, count(DISTINCT n_nationkey) AS nodes
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey) i ON i.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT provider, sum(amount) / count(DISTINCT date_trunc('hour', ts)) AS cost FROM cost_items GROUP BY provider) c
  ON c.provider = r.r_name""")
def _(v: Views) -> DataFrame:
    hosts = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        v.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    infra = hosts.groupBy(F.col("r_name").alias("provider")).agg(
        F.count_distinct("n_nationkey").alias("nodes"), F.count(F.lit(1)).alias("pods")
    )
    regions = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(
        F.col("r_name").alias("provider")
    ).agg(F.min("n_name").alias("region"))
    cards = infra.select("provider", F.when(F.col("nodes") > 0, "Running").otherwise("Stopped").alias("status"))
    clusters = regions.join(cards, "provider", "left").fillna("Stopped", ["status"])
    cost = v.cost_items.groupBy("provider").agg(
        (F.sum("amount") / F.count_distinct(F.date_trunc("hour", "ts"))).alias("cost_per_hour")
    )
    return rounded(dashboards.cluster_cards(clusters, infra, cost), "cost_per_hour")


@query("deployment_table", "calls", """
SELECT model, arg_max(provider, call_id) AS provider, arg_max(tier, call_id) AS tier,
  arg_max(status_code, call_id) AS status_code, count(DISTINCT endpoint) AS endpoints FROM calls GROUP BY model""")
def _(v: Views) -> DataFrame:
    return dashboards.deployment_table(v.calls, "model", BY_TIME, ["provider", "tier", "status_code"], "endpoint")
