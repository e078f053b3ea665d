"""Capacity planning: sizing, allocation over providers, cooldown and load forecasting.

Frames of provider snapshots have one row per `at` (usually a time) and provider:
provider, gpu_node_count, gpu_utilization, queue_length, latency_p95,
cost_per_hour and, where weights matter, weight. Windows over one `at` hold one
row per provider.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, latest_n, plan_chunks
from fleetgauge.functions.common import col, count_if, ratio, same_keys, truncated, with_total
from fleetgauge.functions.replay import hold_off


@dataclass(frozen=True)
class Scaling:
    """Scaling settings with their default values."""

    # The defaults of scaling decisions.
    min_replicas: int = 1
    max_replicas: int = 20
    target_utilization: float = 70.0
    target_queue: float = 50.0
    up_factor: float = 2.0
    down_factor: float = 0.5
    window_up: float = 60.0
    window_down: float = 300.0
    max_cost_per_hour: float = 100.0
    duty_cycle: float = 80
    queue_threshold: float = 100
    latency_threshold: float = 1000

    def clamp(self, size: Column) -> Column:
        return F.greatest(F.lit(self.min_replicas).cast("bigint"), F.least(size, F.lit(self.max_replicas).cast("bigint")))

    def floor(self, size: Column) -> Column:
        return F.greatest(F.lit(self.min_replicas).cast("bigint"), size)


DEFAULTS = Scaling()

# Text fragments that mark a GPU instance or machine type.
GPU_INSTANCE_WORDS = ("gpu", "g4", "g5", "p2", "p3", "p4")
GPU_MACHINE_WORDS = ("gpu", "a100", "t4", "v100", "p100")

# Provider weights of the cost strategy; any other provider has 1.0.
COST_STRATEGY_WEIGHTS = {"aws": 0.8, "gcp": 1.2}

# Configured metric thresholds.
METRIC_THRESHOLDS = {
    "gpu_metrics": {"duty_cycle": 80.0, "memory_used": 80.0, "power_usage": 90.0},
    "queue_metrics": {"queue_length": 100.0, "queue_latency": 2000.0},
    "response_metrics": {"latency_p95": 1000.0, "error_rate": 5.0},
    "cost_metrics": {"cost_per_request": 0.01, "cost_per_hour": 10.0},
}


# Inventory -----------------------------------------------------------------------

def _has_word(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))


def gpu_node_groups(df: DataFrame) -> DataFrame:
    """Add `gpu`: the explicit flag decides; otherwise instance type, machine type, labels or accelerators.

    Columns: is_gpu, instance_type, machine_type, labels MAP, accelerators and config_accelerators ARRAY.
    """
    labelled = (F.col("labels")["node-type"] == "gpu") | (F.col("labels")["accelerator"] == "gpu")
    attached = (F.size(F.coalesce("accelerators", F.array())) > 0) | (
        F.size(F.coalesce("config_accelerators", F.array())) > 0
    )
    guess = (
        _has_word(F.col("instance_type"), GPU_INSTANCE_WORDS)
        | _has_word(F.col("machine_type"), GPU_MACHINE_WORDS)
        | F.coalesce(labelled, F.lit(False)) | attached
    )
    return df.withColumn("gpu", F.coalesce(F.col("is_gpu"), guess))


def node_group_size(df: DataFrame) -> DataFrame:
    """Add `size` from whichever field the provider fills.

    Columns: desired_capacity, min_node_count, current_node_count, initial_node_count.
    """
    size = (
        F.when(F.col("desired_capacity").isNotNull(), F.col("desired_capacity"))
        .when(F.col("min_node_count").isNotNull(), F.coalesce("current_node_count", "initial_node_count"))
        .otherwise(F.col("initial_node_count"))
    )
    return df.withColumn("size", F.coalesce(size, F.lit(0)).cast("bigint"))


def cluster_inventory(df: DataFrame, body: str, management_cluster: str) -> DataFrame:
    """Flatten JSON cluster lists: one row per workload cluster."""
    schema = (
        "items ARRAY<STRUCT<metadata: STRUCT<name: STRING, namespace: STRING, creationTimestamp: STRING>, "
        "spec: STRUCT<infrastructureRef: STRUCT<kind: STRING>>, "
        "status: STRUCT<phase: STRING, controlPlaneReady: BOOLEAN, infrastructureReady: BOOLEAN, "
        "controlPlaneEndpoint: STRUCT<host: STRING>>>>"
    )
    one = df.select(F.explode(F.from_json(body, schema)["items"]).alias("c"))
    kind = F.lower("c.spec.infrastructureRef.kind")
    provider = F.lit("unknown")
    for name in ("azure", "gcp", "aws"):
        provider = F.when(kind.contains(name), name).otherwise(provider)
    unknown = F.lit("unknown")
    return one.where(~F.col("c.metadata.name").eqNullSafe(F.lit(management_cluster))).select(
        F.col("c.metadata.name").alias("name"), F.col("c.metadata.namespace").alias("namespace"),
        provider.alias("provider"),
        F.when(F.col("c.status.controlPlaneEndpoint").isNull(), unknown)
        .otherwise(F.coalesce(F.substring_index("c.status.controlPlaneEndpoint.host", ".", 1), F.lit(""))).alias("region"),
        F.coalesce("c.status.phase", unknown).alias("status"),
        F.coalesce("c.status.controlPlaneReady", F.lit(False)).alias("control_plane_ready"),
        F.coalesce("c.status.infrastructureReady", F.lit(False)).alias("infrastructure_ready"),
        F.col("c.metadata.creationTimestamp").alias("created_at"),
    )


def platform_status(routing: DataFrame, scaling: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per subsystem: items, healthy items and whether all are healthy.

    routing: health; scaling: provider, ts; clusters: control_plane_ready, infrastructure_ready.
    """
    n = F.count(F.lit(1)).alias("items")
    parts = (
        routing.agg(F.lit("api_gateway").alias("subsystem"), n, count_if(F.col("health") == "healthy").alias("healthy")),
        scaling.agg(
            F.lit("autoscaling").alias("subsystem"), F.count_distinct("provider").alias("items"),
            F.count_distinct(F.when(F.col("ts").isNotNull(), F.col("provider"))).alias("healthy"),
        ),
        clusters.agg(
            F.lit("cluster_api").alias("subsystem"), n,
            count_if(F.col("control_plane_ready") & F.col("infrastructure_ready")).alias("healthy"),
        ),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("ok", F.col("items") == F.col("healthy"))


# Metrics --------------------------------------------------------------------------

def avg_node_metric(metrics: str | Column, name: str) -> Column:
    """Mean over nodes of one metric in a MAP<metric, MAP<node, value>>; 0 when missing or empty."""
    values = F.map_values(F.element_at(col(metrics), name))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0))


def recent_history(df: DataFrame, keys: list[str], order: list[str], n: int = 1000) -> DataFrame:
    """The last `n` samples per provider."""
    return latest_n(df, keys, order, n)


def threshold_table(spark: SparkSession, config: dict[str, list[dict] | dict[str, float]]) -> DataFrame:
    """Thresholds by metric group; entries without a name or a value are dropped."""
    rows = []
    for group, entries in config.items():
        pairs = entries.items() if isinstance(entries, dict) else [(e.get("name"), e.get("threshold")) for e in entries]
        rows += [(group, name, float(value)) for name, value in pairs if name and value is not None]
    schema = "metric_group string, metric string, threshold double"
    return spark.createDataFrame(rows, schema)


def scaling_history(df: DataFrame) -> DataFrame:
    """Flat series of utilisation, queue, p95 and size per provider snapshot."""
    return df.select("ts", "provider", "gpu_utilization", "queue_length", "latency_p95", F.col("gpu_node_count").alias("size"))


def scaling_audit(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions by direction and success. Columns: current_size, desired_size, successful."""
    direction = (
        F.when(F.col("desired_size") > F.col("current_size"), "up")
        .when(F.col("desired_size") < F.col("current_size"), "down").otherwise("none")
    )
    return decisions.groupBy(*keys, direction.alias("direction")).agg(
        F.count(F.lit(1)).alias("decisions"), count_if(F.col("successful")).alias("successes"),
        count_if(~F.col("successful")).alias("failures"),
        F.sum(F.col("desired_size") - F.col("current_size")).alias("net_change"),
    )


# Sizing ----------------------------------------------------------------------------

def reactive_size(df: DataFrame, size: str = "gpu_node_count", cfg: Scaling = DEFAULTS) -> DataFrame:
    """Sizes by GPU, queue and latency, and the clamped greatest of them."""
    n, util, queue, p95 = F.col(size), F.col("gpu_utilization"), F.col("queue_length"), F.col("latency_p95")
    up, down = F.lit(cfg.up_factor), F.lit(cfg.down_factor)
    load, backlog, delay = util / cfg.target_utilization, queue / cfg.target_queue, p95 / cfg.latency_threshold
    gpu = (
        F.when(util > cfg.duty_cycle, truncated(n * F.least(load, up)))
        .when(util < 0.7 * cfg.target_utilization, cfg.floor(truncated(n * F.greatest(load, down))))
        .otherwise(n)
    )
    queued = (
        F.when(queue > cfg.queue_threshold, truncated(n * F.least(backlog, up)))
        .when(queue < 0.3 * cfg.target_queue, cfg.floor(truncated(n * down)))
        .otherwise(n)
    )
    slow = F.when(p95 > cfg.latency_threshold, truncated(n * F.least(delay, up))).otherwise(n)
    return (
        df.withColumn("gpu_size", gpu).withColumn("queue_size", queued).withColumn("latency_size", slow)
        .withColumn("desired_size", cfg.clamp(F.greatest("gpu_size", "queue_size", "latency_size")))
    )


def cost_cap(df: DataFrame, size: str = "gpu_node_count", desired: str = "desired_size", cfg: Scaling = DEFAULTS) -> DataFrame:
    """Limit scale-ups to what the hourly budget allows."""
    n, want, cost = F.col(size), F.col(desired), F.col("cost_per_hour")
    estimate = cost + cost / F.greatest(F.lit(1), n) * (want - n)
    affordable = truncated(n * F.try_divide(F.lit(cfg.max_cost_per_hour), cost))
    over = (want > n) & (estimate > cfg.max_cost_per_hour)
    return df.withColumn("capped_size", F.when(over, F.greatest(n, F.least(want, affordable))).otherwise(want))


def _one_decimal(c: Column | float) -> Column:
    return F.replace(F.format_number(c if isinstance(c, Column) else F.lit(float(c)), 1), F.lit(","), F.lit(""))


def scaling_reason(df: DataFrame, size: str = "gpu_node_count", desired: str = "desired_size", cfg: Scaling = DEFAULTS) -> DataFrame:
    """Add `reason`, the text that explains a size change."""
    n, want = F.col(size), F.col(desired)
    util, queue, p95 = F.col("gpu_utilization"), F.col("queue_length"), F.col("latency_p95")

    # Wording of the reasons.
    up_clauses = F.concat_ws(
        ", ",
        F.when(util > cfg.duty_cycle, F.concat(
            F.lit("GPU utilization "), _one_decimal(util), F.lit(f"% > threshold {cfg.duty_cycle}%"))),
        F.when(queue > cfg.queue_threshold, F.concat(
            F.lit("Queue length "), queue, F.lit(f" > threshold {cfg.queue_threshold}"))),
        F.when(p95 > cfg.latency_threshold, F.concat(
            F.lit("P95 latency "), p95, F.lit(f"ms > threshold {cfg.latency_threshold}ms"))),
    )
    low_util, low_queue = 0.7 * cfg.target_utilization, 0.3 * cfg.target_queue
    down_clauses = F.concat_ws(
        ", ",
        F.when(util < low_util, F.concat(
            F.lit("GPU utilization "), _one_decimal(util), F.lit("% < target "), _one_decimal(low_util), F.lit("%"))),
        F.when(queue < low_queue, F.concat(
            F.lit("Queue length "), queue, F.lit(" < target "), _one_decimal(low_queue))),
    )

    def either(clauses: Column, fallback: str) -> Column:
        return F.when(clauses == "", F.lit(fallback)).otherwise(clauses)

    return df.withColumn("reason", F.when(
        want > n, F.concat(F.lit("Scale up: "), either(up_clauses, "Predictive scaling based on load pattern"))
    ).when(
        want < n, F.concat(F.lit("Scale down: "), either(down_clauses, "Cost optimization"))
    ).otherwise("No change needed"))


def cross_reason(size: Column, desired: Column, strategy: str) -> Column:
    """Reason text of a size change made across providers."""
    # Wording of the reasons.
    return (
        F.when(desired > size, f"Cross-cloud scale up: Balancing load across cloud providers based on {strategy} weights")
        .when(desired < size, f"Cross-cloud scale down: Optimizing distribution across cloud providers based on {strategy} weights")
        .otherwise("No change needed in cross-cloud allocation")
    )


# Allocation over providers ------------------------------------------------------------

def global_rollup(df: DataFrame, at: list[str]) -> DataFrame:
    """Totals over usable providers; utilisation and p95 are plain means of the provider values."""
    zero = F.lit(0)
    return df.groupBy(*at).agg(
        F.count(F.lit(1)).alias("providers"),
        F.coalesce(F.sum("gpu_node_count"), zero).alias("total_gpu_nodes"),
        F.coalesce(F.sum("queue_length"), zero).alias("total_queue_length"),
        F.coalesce(F.sum("cost_per_hour"), F.lit(0.0)).alias("total_cost_per_hour"),
        F.coalesce(F.avg("gpu_utilization"), F.lit(0.0)).alias("avg_gpu_utilization"),
        F.coalesce(F.avg("latency_p95"), F.lit(0.0)).alias("avg_latency_p95"),
    )


def scaling_need(df: DataFrame, at: list[str], cfg: Scaling = DEFAULTS) -> DataFrame:
    """Per provider: the global direction, the desired total and whether the provider takes part."""
    total = same_keys(df, global_rollup(df, at), at)
    util, queue, nodes = F.col("avg_gpu_utilization"), F.col("total_queue_length"), F.col("total_gpu_nodes")
    target_u, target_q = cfg.target_utilization, cfg.target_queue
    up = (util > target_u * 1.1) | (queue > target_q * 1.1)
    down = (util < target_u * 0.7) & (queue < target_q * 0.7)
    share = F.lit(target_q) / F.col("providers")
    strain = F.greatest(util / target_u, queue / target_q)
    want = (
        F.when(up, cfg.clamp(truncated(nodes * F.least(strain, F.lit(cfg.up_factor)))))
        .when(down, cfg.floor(truncated(nodes * F.greatest(strain, F.lit(cfg.down_factor)))))
        .otherwise(nodes)
    )
    mine_up = (F.col("gpu_utilization") > target_u) | (F.col("queue_length") > share)
    mine_down = (F.col("gpu_utilization") < target_u * 0.7) & (F.col("queue_length") < share * 0.7)
    role = F.when(up & mine_up, "scale_up").when(~up & down & mine_down, "scale_down").otherwise("stable")
    return (
        total.withColumn("need", F.when(up, "up").when(down, "down").otherwise("stable"))
        .withColumn("desired_total_nodes", want).withColumn("role", role)
    )


def _members(df: DataFrame, at: list[str], role: str) -> DataFrame:
    """Providers with the role, or all of them where none has it."""
    some = F.max(F.col("role") == role).over(Window.partitionBy(*at))
    return df.withColumn("__some", some).where(~F.col("__some") | (F.col("role") == role)).drop("__some")


def _allocation(df: DataFrame, at: list[str], action: str) -> DataFrame:
    changed = F.col("desired_nodes") > F.col("gpu_node_count") if action == "scale_up" else F.col("desired_nodes") < F.col("gpu_node_count")
    return df.select(
        *at, "provider", F.col("gpu_node_count").alias("current_nodes"), "desired_nodes",
        F.when(changed, action).otherwise("no_change").alias("action"),
        (F.col("desired_nodes") - F.col("gpu_node_count")).alias("delta"),
    )


def allocate_up(needs: DataFrame, at: list[str], cfg: Scaling = DEFAULTS) -> DataFrame:
    """Extra nodes by weight; the truncated remainder is not given out."""
    chosen = _members(needs.where(F.col("desired_total_nodes") > F.col("total_gpu_nodes")), at, "scale_up")
    extra = F.col("desired_total_nodes") - F.col("total_gpu_nodes")
    share = truncated(extra * ratio("weight", F.sum("weight").over(Window.partitionBy(*at))))
    return _allocation(chosen.withColumn("desired_nodes", cfg.clamp(F.col("gpu_node_count") + share)), at, "scale_up")


def allocate_down(needs: DataFrame, at: list[str], cfg: Scaling = DEFAULTS) -> DataFrame:
    """Remove nodes from the lowest weight first, never below the minimum."""
    chosen = _members(needs.where(F.col("desired_total_nodes") < F.col("total_gpu_nodes")), at, "scale_down")
    spare = F.greatest(F.lit(0), F.col("gpu_node_count") - cfg.min_replicas)
    w = Window.partitionBy(*at).orderBy("weight", "provider").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total_gpu_nodes") - F.col("desired_total_nodes") - F.coalesce(F.sum("__spare").over(w), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("__spare"), left))
    planned = chosen.withColumn("__spare", spare).withColumn("desired_nodes", F.col("gpu_node_count") - taken)
    return _allocation(planned, at, "scale_down")


def distribute_groups(df: DataFrame, keys: list[str], cfg: Scaling = DEFAULTS) -> DataFrame:
    """Spread a provider's `delta` over its node groups (`node_group`, `size`).

    Up: in proportion to size (equally when all are empty), truncated. Down:
    largest first. What is left goes to the largest group, then sizes are clamped.
    """
    w = Window.partitionBy(*keys)
    largest = w.orderBy(F.col("size").desc(), "node_group")
    before = largest.rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.try_divide(F.col("size"), F.sum("size").over(w)), F.lit(1.0) / F.count(F.lit(1)).over(w))
    up = truncated(F.col("delta") * part)
    spare = F.greatest(F.lit(0), F.col("size") - cfg.min_replicas)
    down = -F.greatest(F.lit(0), F.least(F.col("__spare"), -F.col("delta") - F.coalesce(F.sum("__spare").over(before), F.lit(0))))
    moved = df.withColumn("__spare", spare).withColumn("__move", F.when(F.col("delta") > 0, up).otherwise(down))
    rest = F.col("delta") - F.sum("__move").over(w)
    final = F.col("size") + F.col("__move") + F.when(F.row_number().over(largest) == 1, rest).otherwise(0)
    return moved.withColumn("desired_size", cfg.clamp(final.cast("bigint"))).drop("__spare", "__move")


def provider_weights(df: DataFrame, strategy: str, provider: str = "provider") -> DataFrame:
    """Weight per provider.

    fixed: the constant cost table; cost, latency: inverse mean of the measured
    cost or latency, scaled to a mean of 1; balanced: mean of both; else 1.
    """
    means = df.groupBy(provider).agg(F.avg("cost_per_hour").alias("__cost"), F.avg("latency_p95").alias("__latency"))
    if strategy == "fixed":
        weight = F.lit(1.0)
        for name, value in COST_STRATEGY_WEIGHTS.items():
            weight = F.when(F.col(provider) == name, value).otherwise(weight)
        return means.select(provider, weight.alias("weight"))
    if strategy not in ("cost", "latency", "balanced"):
        return means.select(provider, F.lit(1.0).alias("weight"))
    inverse = means.select(
        provider, F.try_divide(F.lit(1.0), F.col("__cost")).alias("__c"), F.try_divide(F.lit(1.0), F.col("__latency")).alias("__l")
    )
    level = inverse.agg(F.avg("__c").alias("__mc"), F.avg("__l").alias("__ml"))
    cost = F.coalesce(F.try_divide(F.col("__c"), F.col("__mc")), F.lit(1.0))
    latency = F.coalesce(F.try_divide(F.col("__l"), F.col("__ml")), F.lit(1.0))
    weight = {"cost": cost, "latency": latency, "balanced": (cost + latency) / 2}[strategy]
    return with_total(inverse, level).select(provider, weight.alias("weight"))


def cooldown_filter(
    df: DataFrame, provider: str, ts: str, direction: str, successful: str,
    same_direction_only: bool = False, cfg: Scaling = DEFAULTS, chunks: Chunks | None = None,
) -> DataFrame:
    """Add `accepted`: decisions outside the stabilisation windows of the provider.

    Either window blocks, or with `same_direction_only` just the one of the same
    direction. Only accepted and successful decisions start a window, and
    decisions of one pass (same provider and time) do not block each other.
    """
    window_us = F.when(F.col(direction) == "up", int(cfg.window_up * 1e6)).otherwise(int(cfg.window_down * 1e6))
    hold = F.when(F.col(successful), window_us).otherwise(0).cast("bigint")
    keys = [provider, direction] if same_direction_only else [provider]
    passes = df.groupBy(*keys, ts).agg(F.max(hold).alias("__hold"))
    longest = int(max(cfg.window_up, cfg.window_down) * 1e6)
    marked = hold_off(passes, keys, [ts], "__hold", longest, chunks or plan_chunks(df, ts), "accepted")
    return same_keys(df, marked.drop("__hold"), [*keys, ts])


# Forecast --------------------------------------------------------------------------------

def _series(df: DataFrame, keys: list[str], ts: str, value: str, points: int) -> DataFrame:
    """The last `points` values per key with a zero-based index and their number."""
    w = Window.partitionBy(*keys)
    return latest_n(df.select(*keys, ts, value), keys, [ts], points).select(
        *keys, (F.row_number().over(w.orderBy(ts)) - 1).alias("idx"),
        F.col(value).alias("value"), F.count(F.lit(1)).over(w).alias("n"),
    )


def lag_correlations(df: DataFrame, keys: list[str], ts: str, value: str, points: int, max_lag: int) -> DataFrame:
    """Correlation of the series with itself per lag (null without variance), rounded to 9 places."""
    series = _series(df, keys, ts, value, points).where(F.col("n") >= 24)
    top = F.least(F.floor(F.col("n") / 2), F.lit(max_lag)).cast("int")
    early = series.where(top >= 1).select(
        *keys, F.col("value").alias("__a"), F.explode(F.sequence(F.lit(1), top)).alias("lag"), "idx"
    ).withColumn("idx", F.col("idx") + F.col("lag"))
    late = series.select(*keys, "idx", F.col("value").alias("__b"))
    spread = F.stddev_pop("__a") * F.stddev_pop("__b")
    return same_keys(early, late, [*keys, "idx"], "inner").groupBy(*keys, "lag").agg(
        F.round(F.try_divide(F.covar_pop("__a", "__b"), spread), 9).alias("correlation")
    )


def detect_cycle(
    df: DataFrame, keys: list[str], ts: str, value: str,
    points: int = 60, max_lag: int = 96, threshold: float = 0.7,
) -> DataFrame:
    """Cycle length per key: the strongest interior peak of the autocorrelation above `threshold`.

    Equal peaks go to the smallest lag; a key without a peak has no row.
    """
    w = Window.partitionBy(*keys).orderBy("lag")
    c = F.col("correlation")
    peaks = (
        lag_correlations(df, keys, ts, value, points, max_lag)
        .withColumn("__before", F.lag(c).over(w)).withColumn("__after", F.lead(c).over(w))
        .where((c > F.col("__before")) & (c > F.col("__after")) & (c > threshold))
    )
    best = F.max_by(F.struct(F.col("lag"), c), F.struct(c, -F.col("lag")))
    return peaks.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, F.col("__best.lag").cast("bigint").alias("cycle_length"), F.col("__best.correlation").alias("correlation")
    )


def forecast_cyclic(
    df: DataFrame, cycles: DataFrame, keys: list[str], ts: str, value: str,
    points: int = 60, forecast_minutes: int = 30, interval_seconds: int = 15, confidence_threshold: float = 0.8,
) -> DataFrame:
    """Mean of the past values at the forecast phase of the cycle, if there are enough of them."""
    ahead = forecast_minutes * 60 // interval_seconds
    cycle = F.col("cycle_length")
    phase = F.pmod(F.pmod(F.col("n"), cycle) + ahead, cycle)
    at_phase = (
        same_keys(_series(df, keys, ts, value, points), cycles.where(cycle <= ahead), keys, "inner")
        .where(F.pmod(F.col("idx"), cycle) == phase)
    )
    return (
        at_phase.groupBy(*keys, "cycle_length")
        .agg(F.avg("value").alias("forecast"), F.count(F.lit(1)).alias("samples"))
        .withColumn("confidence", F.when(F.col("samples") >= 3, 0.8).otherwise(0.5))
        .where(F.col("confidence") >= confidence_threshold)
    )


def predictive_size(sized: DataFrame, forecasts: DataFrame, keys: list[str], size: str = "gpu_node_count", cfg: Scaling = DEFAULTS) -> DataFrame:
    """Size from the forecast; without a clear forecast the reactive `desired_size` stays."""
    n, f = F.col(size), F.col("forecast")
    load = f / cfg.target_utilization
    predicted = (
        F.when(f > cfg.target_utilization * 1.1, truncated(n * F.least(load, F.lit(cfg.up_factor))))
        .when(f < cfg.target_utilization * 0.7, cfg.floor(truncated(n * F.greatest(load, F.lit(cfg.down_factor)))))
    )
    return (
        same_keys(sized, forecasts.select(*keys, "forecast"), keys)
        .withColumn("predicted_size", predicted)
        .withColumn("planned_size", cfg.clamp(F.coalesce("predicted_size", "desired_size")))
    )
