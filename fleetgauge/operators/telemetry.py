"""Rollups of metric events: counters, gauges, histograms and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.common import col, count_if, percent, ratio, same_keys, with_total

# Default upper bounds of latency histograms, in milliseconds.
LATENCY_BOUNDS_MS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)


def _newest(order: list[str], **cols: str | Column) -> Column:
    """Values of the newest row as one struct (max over order, then values)."""
    return F.max(F.struct(*[F.col(o).alias(f"__o_{o}") for o in order], *[col(c).alias(n) for n, c in cols.items()]))


def counter_rollup(df: DataFrame, labels: list[str], amount: str | Column | None = None) -> DataFrame:
    """Sum of increments (row count by default) per label set."""
    inc = F.count(F.lit(1)) if amount is None else F.sum(col(amount))
    return df.groupBy(*labels).agg(inc.alias("value"))


def gauge_latest(df: DataFrame, labels: list[str], value: str | Column, order: list[str]) -> DataFrame:
    """Last written value per label set."""
    return df.groupBy(*labels).agg(_newest(order, value=value).alias("__last")).select(
        *labels, F.col("__last.value").alias("value"), F.col(f"__last.__o_{order[0]}").alias("updated_at")
    )


def histogram_rollup(
    df: DataFrame, labels: list[str], value: str | Column, bounds: tuple[float, ...] = LATENCY_BOUNDS_MS
) -> DataFrame:
    """Cumulative buckets `le` with sum and count per label set.

    All buckets are conditional counts of one aggregate, so a row is read once
    and only one partial row per label set and task is shuffled.
    """
    v = col(value).cast("double")
    names = [*[f"{b:g}" for b in bounds], "+Inf"]
    conds = [*[v <= b for b in bounds], v.isNotNull()]
    wide = df.groupBy(*labels).agg(
        *[count_if(c).alias(f"__b{i}") for i, c in enumerate(conds)],
        F.sum(v).alias("sum"), F.count(v).alias("count"),
    )
    buckets = F.inline(F.array(*[
        F.struct(F.lit(n).alias("le"), F.col(f"__b{i}").alias("bucket_count")) for i, n in enumerate(names)
    ]))
    return wide.select(*labels, buckets, "sum", "count")


def request_metrics(
    df: DataFrame, endpoint: str, method: str, status: str, latency: str, request_size: str, response_size: str
) -> DataFrame:
    """Counts by status, latency by method and sizes by endpoint from one scan."""
    level = F.when(F.grouping(status) == 0, "count").when(F.grouping(method) == 0, "latency").otherwise("size")
    sets = [[F.col(endpoint), F.col(method), F.col(status)], [F.col(endpoint), F.col(method)], [F.col(endpoint)]]
    out = df.groupingSets(sets, F.col(endpoint), F.col(method), F.col(status)).agg(
        level.alias("metric"),
        F.count(F.lit(1)).alias("requests"),
        F.sum(latency).alias("latency_sum"),
        F.sum(request_size).alias("request_bytes"),
        F.sum(response_size).alias("response_bytes"),
    )
    return out.select("metric", endpoint, method, status, "requests", "latency_sum", "request_bytes", "response_bytes")


def inference_metrics(
    df: DataFrame, keys: list[str], latency: str, memory: str, prediction: str, order: list[str]
) -> DataFrame:
    """Inference count, latency sum and mean, classified count and last memory gauge."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inferences"),
        F.sum(latency).alias("latency_sum"),
        F.avg(latency).alias("latency_mean"),
        F.count(prediction).alias("classified"),
        _newest(order, value=memory).getField("value").alias("memory"),
    )


def prediction_distribution(df: DataFrame, model: str, prediction: str, ts: str, width: str) -> DataFrame:
    """Predictions per window, model and class, with the share of the class; null classes do not count."""
    counted = (
        df.where(F.col(prediction).isNotNull())
        .groupBy(F.window(ts, width).start.alias("window_start"), model, F.col(prediction).alias("prediction_class"))
        .agg(F.count(F.lit(1)).alias("predictions"))
    )
    total = counted.groupBy("window_start", model).agg(F.sum("predictions").alias("__all"))
    return same_keys(counted, total, ["window_start", model]).select(
        "window_start", model, "prediction_class", "predictions", percent("predictions", "__all").alias("share_pct")
    )


def component_status(df: DataFrame, keys: list[str], order: list[str], up: Column) -> DataFrame:
    """Latest state per component and how long it has been up, measured at the newest row of the table.

    Two grouped aggregates find the start of the current run, so no component is
    sorted as a whole.
    """
    ts = order[0]
    state = df.withColumn("__up", up)
    at = F.struct(*[F.col(o) for o in order])
    last = state.groupBy(*keys).agg(
        F.max(F.when(~F.col("__up"), at)).alias("__down"),
        F.max(F.struct(*[F.col(o) for o in order], F.col("__up").alias("up"))).alias("__last"),
    )
    since = (
        same_keys(state.where("__up").select(*keys, *order), last.select(*keys, "__down"), keys)
        .where(F.col("__down").isNull() | (at > F.col("__down")))
        .groupBy(*keys).agg(F.min(ts).alias("__since"))
    )
    now = df.agg(F.max(ts).alias("__now"))
    uptime = F.unix_micros(F.col("__now").cast("timestamp")) - F.unix_micros(F.col("__since").cast("timestamp"))
    return with_total(same_keys(last, since, keys), now).select(
        *keys,
        F.col("__last.up").cast("bigint").alias("status"),
        F.col(f"__last.{ts}").alias("last_seen"),
        F.coalesce(F.when(F.col("__last.up"), uptime / 1e6), F.lit(0.0)).alias("uptime_seconds"),
    )


def business_metrics(df: DataFrame, ts: str, width: str, user: str, failed: Column, approximate: bool = False) -> DataFrame:
    """Active users, inferences per active user and error percentage per window."""
    users = F.approx_count_distinct(user) if approximate else F.count_distinct(F.col(user))
    return (
        df.groupBy(F.window(ts, width).start.alias("window_start"))
        .agg(users.alias("active_users"), F.count(F.lit(1)).alias("inferences"), count_if(failed).alias("__errors"))
        .select(
            "window_start", "active_users", "inferences",
            ratio("inferences", "active_users").alias("inferences_per_user"),
            percent("__errors", "inferences").alias("error_rate_pct"),
        )
    )


def tier_usage(df: DataFrame, model: str, tier: str, tiers: list[str]) -> DataFrame:
    """Usage per model, one column per tier."""
    return df.groupBy(model).pivot(tier, tiers).agg(F.count(F.lit(1))).fillna(0, subset=tiers)


def inferences_per_user(df: DataFrame, tier: str, user: str) -> DataFrame:
    """Inferences and users per tier."""
    return df.groupBy(tier).agg(
        F.count(F.lit(1)).alias("inferences"), F.count_distinct(F.col(user)).alias("users")
    ).withColumn("inferences_per_user", ratio("inferences", "users"))


def queue_metrics(
    df: DataFrame, queue: str, length: str, latency: str, error_type: str | Column, order: list[str]
) -> DataFrame:
    """Last length and latency per queue, with its error counts by type."""
    parts = df.withColumn("error_type", col(error_type)).groupBy(queue, "error_type").agg(
        _newest(order, length=length, latency=latency).alias("__last"), F.count(F.lit(1)).alias("errors")
    )
    gauges = parts.groupBy(queue).agg(F.max("__last").alias("__last"))
    errors = parts.where(F.col("error_type").isNotNull()).select(queue, "error_type", "errors")
    return same_keys(gauges, errors, [queue]).select(
        queue, F.col("__last.length").alias("queue_length"), F.col("__last.latency").alias("queue_latency"),
        "error_type", F.coalesce("errors", F.lit(0)).alias("errors"),
    )


def infra_metrics(
    df: DataFrame, provider: str, namespace: str, resource: str, resources: list[str], value: str,
    order: list[str], quota: dict[str, float],
) -> DataFrame:
    """Last gauges per provider and namespace, totals per provider and over all, and quota use."""
    last = gauge_latest(df.where(F.col(resource).isin(resources)), [provider, namespace, resource], value, order)
    sums = last.rollup(provider, namespace).agg(
        F.grouping_id().cast("bigint").alias("level"),
        *[F.coalesce(F.sum(F.when(F.col(resource) == r, F.col("value"))), F.lit(0.0)).alias(r) for r in resources],
    )
    return sums.select("*", *[percent(r, F.lit(q)).alias(f"{r}_quota_pct") for r, q in quota.items()])


def metric_timeseries(df: DataFrame, labels: list[str], value: str, order: list[str], width: str) -> DataFrame:
    """One sample per interval and label set: count, mean and last value."""
    return df.groupBy(F.window(order[0], width).alias("__w"), *labels).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(value).alias("mean_value"),
        _newest(order, value=value).getField("value").alias("last_value"),
    ).select(F.col("__w.start").alias("window_start"), *labels, "samples", "mean_value", "last_value")
