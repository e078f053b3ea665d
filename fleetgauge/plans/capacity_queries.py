"""Registered queries: capacity planning and forecasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators import capacity, routing
from fleetgauge.operators.capacity import Scaling
from fleetgauge.plans.registry import query
from fleetgauge.plans.traffic_queries import BY_TIME, failed, rounded
from fleetgauge.plans.views import Views


def _weight() -> Column:
    return F.when(F.col("provider") == "p0", 0.8).when(F.col("provider") == "p1", 1.2).otherwise(1.0)


@query("gpu_node_groups", "", """
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN p_size % 2 = 0
  WHEN p_size % 3 = 0 THEN true WHEN p_size % 5 = 0 AND p_type = 'PROMO' THEN true
  WHEN p_brand = 'Brand#13' THEN true ELSE p_size % 13 = 0 END AS gpu FROM part""")
def _(v: Views) -> DataFrame:
    groups = v.part.select(
        "p_partkey",
        F.when(F.col("p_size") % 11 == 0, F.col("p_size") % 2 == 0).alias("is_gpu"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("G4dn."), "p_type")).otherwise("m5.large").alias("instance_type"),
        F.when((F.col("p_size") % 5 == 0) & (F.col("p_type") == "PROMO"), "a2-A100-1g").alias("machine_type"),
        F.create_map(F.lit("node-type"), F.when(F.col("p_brand") == "Brand#13", "gpu").otherwise("cpu")).alias("labels"),
        F.when(F.col("p_size") % 13 == 0, F.array("p_type")).alias("accelerators"),
        F.array().cast("array<string>").alias("config_accelerators"),
    )
    return capacity.gpu_node_groups(groups).select("p_partkey", "gpu")


@query("node_group_size", "", """
SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size
  WHEN p_size % 3 = 0 AND p_size % 5 = 0 THEN p_size + 1 WHEN p_size % 7 = 0 THEN 0 ELSE p_size + 2 END AS BIGINT) AS size FROM part""")
def _(v: Views) -> DataFrame:
    s = F.col("p_size")
    groups = v.part.select(
        "p_partkey", F.when(s % 2 == 0, s).alias("desired_capacity"), F.when(s % 3 == 0, F.lit(1)).alias("min_node_count"),
        F.when(s % 5 == 0, s + 1).alias("current_node_count"),
        F.when((s % 7 != 0) | ((s % 3 == 0) & (s % 5 == 0)), s + 2).alias("initial_node_count"),
    )
    return capacity.node_group_size(groups).select("p_partkey", "size")


@query("avg_node_metric", "node_metrics", """
SELECT node % 3 AS provider, ts, round(avg(gpu_utilization), 8) AS gpu_utilization, 0.0::DOUBLE AS gpu_memory
FROM node_metrics GROUP BY node % 3, ts""")
def _(v: Views) -> DataFrame:
    # A snapshot holds one entry per node of the provider, so the map is as small as the fleet.
    nodes = F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("string"), F.col("gpu_utilization"))))
    snapshots = v.node_metrics.groupBy((F.col("node") % 3).alias("provider"), "ts").agg(
        F.create_map(F.lit("gpu_utilization"), nodes).alias("gpu_metrics")
    )
    return rounded(snapshots.select(
        "provider", "ts", capacity.avg_node_metric("gpu_metrics", "gpu_utilization").alias("gpu_utilization"),
        capacity.avg_node_metric("gpu_metrics", "gpu_memory").alias("gpu_memory"),
    ), "gpu_utilization", places=8)


@query("recent_history", "calls", """
SELECT provider, call_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, call_id DESC) AS rn FROM calls)
WHERE rn <= 1000""")
def _(v: Views) -> DataFrame:
    return capacity.recent_history(v.calls.select("provider", "call_id", "ts"), ["provider"], BY_TIME)


@query("scaling_history", "fleet", """
SELECT ts, provider, gpu_utilization, queue_length, latency_p95, gpu_node_count AS size FROM fleet""")
def _(v: Views) -> DataFrame:
    return capacity.scaling_history(v.fleet)


_G = """g AS (SELECT ts, count(*) AS providers, CAST(sum(gpu_node_count) AS BIGINT) AS total_gpu_nodes,
  CAST(sum(queue_length) AS BIGINT) AS total_queue_length, sum(cost_per_hour) AS total_cost_per_hour,
  avg(gpu_utilization) AS avg_gpu_utilization, avg(latency_p95) AS avg_latency_p95 FROM fleet GROUP BY ts)"""


@query("global_rollup", "fleet", f"""
WITH {_G}
SELECT ts, providers, total_gpu_nodes, total_queue_length, round(total_cost_per_hour, 8) AS total_cost_per_hour,
  round(avg_gpu_utilization, 8) AS avg_gpu_utilization, round(avg_latency_p95, 8) AS avg_latency_p95 FROM g""")
def _(v: Views) -> DataFrame:
    return rounded(capacity.global_rollup(v.fleet, ["ts"]), "total_cost_per_hour", "avg_gpu_utilization", "avg_latency_p95", places=8)


_SIZES = """s AS (SELECT *,
  CAST(CASE WHEN gpu_utilization > 80 THEN trunc(gpu_node_count * least(gpu_utilization / 70, 2))
    WHEN gpu_utilization < 0.7 * 70 THEN greatest(1, trunc(gpu_node_count * greatest(gpu_utilization / 70, 0.5)))
    ELSE gpu_node_count END AS BIGINT) AS gpu_size,
  CAST(CASE WHEN queue_length > 100 THEN trunc(gpu_node_count * least(queue_length / 50.0, 2))
    WHEN queue_length < 0.3 * 50 THEN greatest(1, trunc(gpu_node_count * 0.5)) ELSE gpu_node_count END AS BIGINT) AS queue_size,
  CAST(CASE WHEN latency_p95 > 1000 THEN trunc(gpu_node_count * least(latency_p95 / 1000.0, 2)) ELSE gpu_node_count END AS BIGINT) AS latency_size
  FROM fleet),
d AS (SELECT *, CAST(greatest(1, least(greatest(gpu_size, queue_size, latency_size), 20)) AS BIGINT) AS desired_size FROM s)"""


@query("reactive_size", "fleet", f"""
WITH {_SIZES}
SELECT ts, provider, gpu_size, queue_size, latency_size, desired_size FROM d""")
def _(v: Views) -> DataFrame:
    return capacity.reactive_size(v.fleet).select("ts", "provider", "gpu_size", "queue_size", "latency_size", "desired_size")


@query("cost_cap", "fleet", f"""
WITH {_SIZES}
SELECT ts, provider, desired_size, CASE WHEN desired_size > gpu_node_count
    AND cost_per_hour + cost_per_hour / greatest(1, gpu_node_count) * (desired_size - gpu_node_count) > 100
  THEN greatest(gpu_node_count, least(desired_size, CAST(trunc(gpu_node_count * (100 / cost_per_hour)) AS BIGINT)))
  ELSE desired_size END AS capped_size FROM d""")
def _(v: Views) -> DataFrame:
    return capacity.cost_cap(capacity.reactive_size(v.fleet)).select("ts", "provider", "desired_size", "capped_size")


@query("scaling_reason", "fleet", f"""
WITH {_SIZES}
SELECT ts, provider, CASE
  WHEN desired_size > gpu_node_count THEN 'Scale up: ' || coalesce(nullif(concat_ws(', ',
    CASE WHEN gpu_utilization > 80 THEN printf('GPU utilization %.1f%% > threshold 80%%', gpu_utilization) END,
    CASE WHEN queue_length > 100 THEN 'Queue length ' || queue_length || ' > threshold 100' END,
    CASE WHEN latency_p95 > 1000 THEN 'P95 latency ' || latency_p95 || 'ms > threshold 1000ms' END), ''),
    'Predictive scaling based on load pattern')
  WHEN desired_size < gpu_node_count THEN 'Scale down: ' || coalesce(nullif(concat_ws(', ',
    CASE WHEN gpu_utilization < 49 THEN printf('GPU utilization %.1f%% < target 49.0%%', gpu_utilization) END,
    CASE WHEN queue_length < 15 THEN 'Queue length ' || queue_length || ' < target 15.0' END), ''), 'Cost optimization')
  ELSE 'No change needed' END AS reason FROM d""")
def _(v: Views) -> DataFrame:
    return capacity.scaling_reason(capacity.reactive_size(v.fleet)).select("ts", "provider", "reason")


_NEED = f"""{_G},
n AS (SELECT f.*, CASE f.provider WHEN 'p0' THEN 0.8 WHEN 'p1' THEN 1.2 ELSE 1.0 END::DOUBLE AS weight, g.providers, g.total_gpu_nodes,
  CASE WHEN avg_gpu_utilization > 70 * 1.1 OR total_queue_length > 70 * 1.1 THEN 'up'
    WHEN avg_gpu_utilization < 70 * 0.7 AND total_queue_length < 70 * 0.7 THEN 'down' ELSE 'stable' END AS need,
  greatest(avg_gpu_utilization / 70, total_queue_length / 70) AS strain
  FROM fleet f JOIN g ON f.ts = g.ts),
m AS (SELECT *,
  CAST(CASE need WHEN 'up' THEN greatest(1, least(20, trunc(total_gpu_nodes * least(strain, 2))))
    WHEN 'down' THEN greatest(1, trunc(total_gpu_nodes * greatest(strain, 0.5))) ELSE total_gpu_nodes END AS BIGINT) AS desired_total_nodes,
  CASE WHEN need = 'up' AND (gpu_utilization > 70 OR queue_length > 70.0 / providers) THEN 'scale_up'
    WHEN need = 'down' AND gpu_utilization < 70 * 0.7 AND queue_length < 70.0 / providers * 0.7 THEN 'scale_down' ELSE 'stable' END AS role FROM n)"""

_CROSS = Scaling(target_queue=70.0)


def _needs(v: Views) -> DataFrame:
    return capacity.scaling_need(v.fleet.withColumn("weight", _weight()), ["ts"], _CROSS)


@query("scaling_need", "fleet", f"""
WITH {_NEED}
SELECT ts, provider, need, desired_total_nodes, role FROM m""")
def _(v: Views) -> DataFrame:
    return _needs(v).select("ts", "provider", "need", "desired_total_nodes", "role")


_UP = f"""{_NEED},
c AS (SELECT * FROM m WHERE desired_total_nodes > total_gpu_nodes
  AND (role = 'scale_up' OR NOT EXISTS (SELECT 1 FROM m x WHERE x.ts = m.ts AND x.role = 'scale_up'))),
a AS (SELECT ts, provider, gpu_node_count AS current_nodes, greatest(1, least(20, gpu_node_count
  + CAST(trunc((desired_total_nodes - total_gpu_nodes) * (weight / sum(weight) OVER (PARTITION BY ts))) AS BIGINT))) AS desired_nodes FROM c)"""


@query("allocate_up", "fleet", f"""
WITH {_UP}
SELECT ts, provider, current_nodes, desired_nodes,
  CASE WHEN desired_nodes > current_nodes THEN 'scale_up' ELSE 'no_change' END AS action, desired_nodes - current_nodes AS delta FROM a""")
def _(v: Views) -> DataFrame:
    return capacity.allocate_up(_needs(v), ["ts"], _CROSS)


@query("cross_reason", "fleet", f"""
WITH {_UP}
SELECT ts, provider, CASE WHEN desired_nodes > current_nodes THEN 'Cross-cloud scale up: Balancing load across cloud providers based on cost weights'
  ELSE 'No change needed in cross-cloud allocation' END AS reason FROM a""")
def _(v: Views) -> DataFrame:
    made = capacity.allocate_up(_needs(v), ["ts"], _CROSS)
    return made.select("ts", "provider", capacity.cross_reason(F.col("current_nodes"), F.col("desired_nodes"), "cost").alias("reason"))


@query("allocate_down", "fleet", f"""
WITH {_NEED},
c AS (SELECT *, greatest(0, gpu_node_count - 1) AS spare FROM m WHERE desired_total_nodes < total_gpu_nodes
  AND (role = 'scale_down' OR NOT EXISTS (SELECT 1 FROM m x WHERE x.ts = m.ts AND x.role = 'scale_down'))),
a AS (SELECT ts, provider, gpu_node_count AS current_nodes, CAST(gpu_node_count - greatest(0, least(spare,
  total_gpu_nodes - desired_total_nodes - coalesce(sum(spare) OVER (PARTITION BY ts ORDER BY weight, provider
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS desired_nodes FROM c)
SELECT ts, provider, current_nodes, desired_nodes,
  CASE WHEN desired_nodes < current_nodes THEN 'scale_down' ELSE 'no_change' END AS action, desired_nodes - current_nodes AS delta FROM a""")
def _(v: Views) -> DataFrame:
    return capacity.allocate_down(_needs(v), ["ts"], _CROSS)


@query("distribute_groups", "", """
WITH g AS (SELECT n_nationkey, n_name AS node_group, n_regionkey AS provider,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) % 10 AS size FROM nation),
t AS (SELECT n_regionkey AS provider, count(*) % 25 - 12 AS delta FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey),
a AS (SELECT g.provider, node_group, size, delta, row_number() OVER w AS rn,
  CASE WHEN delta > 0 THEN CAST(trunc(delta * coalesce(size / nullif(sum(size) OVER p, 0), 1.0 / count(*) OVER p)) AS BIGINT)
    ELSE -greatest(0, least(greatest(0, size - 1), -delta - coalesce(sum(greatest(0, size - 1)) OVER (PARTITION BY g.provider
      ORDER BY size DESC, node_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS move
  FROM g JOIN t ON g.provider = t.provider WINDOW w AS (PARTITION BY g.provider ORDER BY size DESC, node_group), p AS (PARTITION BY g.provider))
SELECT provider, node_group, size, delta, CAST(greatest(1, least(20, size + move
  + CASE WHEN rn = 1 THEN delta - sum(move) OVER (PARTITION BY provider) ELSE 0 END)) AS BIGINT) AS desired_size FROM a""")
def _(v: Views) -> DataFrame:
    hosts = v.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    groups = v.nation.join(hosts, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("n_regionkey").alias("provider"), F.col("n_name").alias("node_group"),
        (F.coalesce("n", F.lit(0)) % 10).alias("size"),
    )
    delta = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_regionkey").alias("provider")
    ).agg((F.count(F.lit(1)) % 25 - 12).alias("delta"))
    return capacity.distribute_groups(groups.join(delta, "provider"), ["provider"])


@query("provider_weights", "fleet", """
WITH m AS (SELECT provider, 1 / avg(cost_per_hour) AS c, 1 / avg(latency_p95) AS l FROM fleet GROUP BY provider)
SELECT provider, round((c / avg(c) OVER () + l / avg(l) OVER ()) / 2, 4) AS weight FROM m""")
def _(v: Views) -> DataFrame:
    return rounded(capacity.provider_weights(v.fleet, "balanced"), "weight")


_DECISIONS = f"""{_SIZES},
x AS (SELECT provider, ts, gpu_node_count AS current_size, desired_size, queue_length % 5 <> 0 AS successful,
  CASE WHEN desired_size > gpu_node_count THEN 'up' ELSE 'down' END AS direction FROM d WHERE desired_size <> gpu_node_count)"""


def _decisions(v: Views) -> DataFrame:
    sized = capacity.reactive_size(v.fleet).where(F.col("desired_size") != F.col("gpu_node_count"))
    return sized.select(
        "provider", "ts", F.col("gpu_node_count").alias("current_size"), "desired_size",
        (F.col("queue_length") % 5 != 0).alias("successful"),
        F.when(F.col("desired_size") > F.col("gpu_node_count"), "up").otherwise("down").alias("direction"),
    )


_COOLDOWN = Scaling(window_up=7200, window_down=18000)


@query("cooldown_filter", "fleet", f"""
WITH RECURSIVE {_DECISIONS},
n AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY provider ORDER BY ts) AS rn,
  CASE WHEN NOT successful THEN 0 WHEN direction = 'up' THEN 7200000000 ELSE 18000000000 END AS hold FROM x),
r AS (SELECT provider, ts, direction, successful, rn, true AS accepted, us + hold AS until FROM n WHERE rn = 1
  UNION ALL SELECT n.provider, n.ts, n.direction, n.successful, n.rn, n.us >= r.until,
    CASE WHEN n.us >= r.until THEN n.us + n.hold ELSE r.until END FROM r JOIN n ON n.provider = r.provider AND n.rn = r.rn + 1)
SELECT provider, ts, direction, successful, accepted FROM r""")
def _(v: Views) -> DataFrame:
    out = capacity.cooldown_filter(_decisions(v), "provider", "ts", "direction", "successful", cfg=_COOLDOWN)
    return out.select("provider", "ts", "direction", "successful", "accepted")


@query("cooldown_filter_same_direction", "fleet", f"""
WITH RECURSIVE {_DECISIONS},
n AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY provider, direction ORDER BY ts) AS rn,
  CASE WHEN NOT successful THEN 0 WHEN direction = 'up' THEN 7200000000 ELSE 18000000000 END AS hold FROM x),
r AS (SELECT provider, ts, direction, successful, rn, true AS accepted, us + hold AS until FROM n WHERE rn = 1
  UNION ALL SELECT n.provider, n.ts, n.direction, n.successful, n.rn, n.us >= r.until,
    CASE WHEN n.us >= r.until THEN n.us + n.hold ELSE r.until END
  FROM r JOIN n ON n.provider = r.provider AND n.direction = r.direction AND n.rn = r.rn + 1)
SELECT provider, ts, direction, successful, accepted FROM r""")
def _(v: Views) -> DataFrame:
    out = capacity.cooldown_filter(
        _decisions(v), "provider", "ts", "direction", "successful", same_direction_only=True, cfg=_COOLDOWN
    )
    return out.select("provider", "ts", "direction", "successful", "accepted")


@query("scaling_audit", "fleet", f"""
WITH {_DECISIONS}
SELECT provider, direction, count(*) AS decisions, count(*) FILTER (successful) AS successes,
  count(*) FILTER (NOT successful) AS failures, CAST(sum(desired_size - current_size) AS BIGINT) AS net_change
FROM x GROUP BY provider, direction""")
def _(v: Views) -> DataFrame:
    return capacity.scaling_audit(_decisions(v).drop("direction"), ["provider"])


_CYCLE = """i AS (SELECT provider, value, row_number() OVER (PARTITION BY provider ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY provider) AS n
  FROM (SELECT provider, ts, gpu_utilization AS value, row_number() OVER (PARTITION BY provider ORDER BY ts DESC) AS back FROM fleet) WHERE back <= 240),
c AS (SELECT a.provider, l.lag, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 9) AS correlation
  FROM i a, range(1, 97) l(lag), i b WHERE l.lag <= a.n // 2 AND a.n >= 24 AND b.provider = a.provider AND b.idx = a.idx + l.lag
  GROUP BY a.provider, l.lag),
p AS (SELECT *, lag(correlation) OVER w AS before, lead(correlation) OVER w AS after FROM c WINDOW w AS (PARTITION BY provider ORDER BY lag)),
k AS (SELECT provider, lag AS cycle_length, correlation FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY correlation DESC, lag) AS rn
  FROM p WHERE correlation > before AND correlation > after AND correlation > 0.05) WHERE rn = 1)"""


def _cycles(v: Views) -> DataFrame:
    return capacity.detect_cycle(v.fleet, ["provider"], "ts", "gpu_utilization", points=240, max_lag=96, threshold=0.05)


def _forecasts(v: Views) -> DataFrame:
    return capacity.forecast_cyclic(
        v.fleet, _cycles(v), ["provider"], "ts", "gpu_utilization",
        points=240, forecast_minutes=5760, interval_seconds=3600,
    )


_FORECAST = """f AS (SELECT k.provider, k.cycle_length, avg(i.value) AS forecast, count(*) AS samples FROM i JOIN k ON i.provider = k.provider
  WHERE k.cycle_length <= 96 AND i.idx % k.cycle_length = (i.n % k.cycle_length + 96) % k.cycle_length
  GROUP BY k.provider, k.cycle_length HAVING count(*) >= 3)"""


@query("detect_cycle", "fleet", f"""
WITH {_CYCLE}
SELECT provider, cycle_length, round(correlation, 4) AS correlation FROM k""")
def _(v: Views) -> DataFrame:
    return rounded(_cycles(v), "correlation")


@query("forecast_cyclic", "fleet", f"""
WITH {_CYCLE}, {_FORECAST}
SELECT provider, cycle_length, round(forecast, 8) AS forecast, samples, 0.8::DOUBLE AS confidence FROM f""")
def _(v: Views) -> DataFrame:
    return rounded(_forecasts(v), "forecast", places=8)


@query("predictive_size", "fleet", f"""
WITH {_SIZES}, {_CYCLE}, {_FORECAST},
q AS (SELECT d.ts, d.provider, d.desired_size, CAST(CASE WHEN forecast > 70 * 1.1 THEN trunc(gpu_node_count * least(forecast / 70, 2))
  WHEN forecast < 70 * 0.7 THEN greatest(1, trunc(gpu_node_count * greatest(forecast / 70, 0.5))) END AS BIGINT) AS predicted_size
  FROM d LEFT JOIN f ON d.provider = f.provider)
SELECT ts, provider, predicted_size, CAST(greatest(1, least(20, coalesce(predicted_size, desired_size))) AS BIGINT) AS planned_size FROM q""")
def _(v: Views) -> DataFrame:
    out = capacity.predictive_size(capacity.reactive_size(v.fleet), _forecasts(v), ["provider"])
    return out.select("ts", "provider", "predicted_size", "planned_size")


def _clusters(v: Views) -> DataFrame:
    """Cluster lists as JSON text, one list per supplier row."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "AWSCluster").when(k % 4 == 1, "GCPCluster").when(k % 4 == 2, "AzureCluster").otherwise("MetalCluster")
    item = F.struct(
        F.struct(F.col("s_name").alias("name"), F.lit("default").alias("namespace")).alias("metadata"),
        F.when(k % 7 != 0, F.struct(F.struct(kind.alias("kind")).alias("infrastructureRef"))).alias("spec"),
        F.struct(
            F.when(k % 5 != 0, F.lit("Provisioned")).alias("phase"), F.when(k % 3 == 0, True).alias("controlPlaneReady"),
            (k % 2 == 0).alias("infrastructureReady"),
            F.when(k % 6 != 0, F.struct(F.concat("n_name", F.lit(".host.example")).alias("host"))).alias("controlPlaneEndpoint"),
        ).alias("status"),
    )
    return v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.to_json(F.struct(F.array(item).alias("items"))).alias("body")
    )


_CLUSTERS = """cl AS (SELECT s_name AS name, 'default' AS namespace,
  CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE ['aws', 'gcp', 'azure', 'unknown'][s_suppkey % 4 + 1] END AS provider,
  CASE WHEN s_suppkey % 6 = 0 THEN 'unknown' ELSE n_name END AS region,
  CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'Provisioned' END AS status,
  s_suppkey % 3 = 0 AS control_plane_ready, s_suppkey % 2 = 0 AS infrastructure_ready
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_name <> (SELECT min(s_name) FROM supplier))"""


@query("cluster_inventory", "", f"WITH {_CLUSTERS} SELECT * FROM cl")
def _(v: Views) -> DataFrame:
    first = v.supplier.agg(F.min("s_name")).first()[0]
    return capacity.cluster_inventory(_clusters(v), "body", first).drop("created_at")


@query("platform_status", "calls fleet", f"""
WITH {_CLUSTERS},
h AS (SELECT provider, count(*) FILTER (status_code >= 500) < 3 AS healthy FROM (
  SELECT provider, status_code, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, call_id DESC) AS rn FROM calls)
  WHERE rn <= 3 GROUP BY provider),
s AS (SELECT 'api_gateway' AS subsystem, count(*) AS items, count(*) FILTER (healthy) AS healthy FROM h
  UNION ALL SELECT 'autoscaling', count(DISTINCT provider), count(DISTINCT provider) FROM fleet
  UNION ALL SELECT 'cluster_api', count(*), count(*) FILTER (control_plane_ready AND infrastructure_ready) FROM cl)
SELECT subsystem, items, healthy, items = healthy AS ok FROM s""")
def _(v: Views) -> DataFrame:
    first = v.supplier.agg(F.min("s_name")).first()[0]
    health = routing.health_now(v.calls, ["provider"], BY_TIME, failed()).select(
        F.when(F.col("healthy"), "healthy").otherwise("unhealthy").alias("health")
    )
    return capacity.platform_status(health, v.fleet, capacity.cluster_inventory(_clusters(v), "body", first))
