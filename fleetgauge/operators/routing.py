"""Traffic and routing analytics over a table of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, latest_n, plan_chunks, streak
from fleetgauge.functions.common import count_if, percent, same_keys, uniform, with_total

RECENT_CALLS = 100
FAILOVER_THRESHOLD = 3


def provider_share(df: DataFrame, provider: str = "provider") -> DataFrame:
    """Requests per provider and percentage of all requests."""
    counts = df.groupBy(provider).agg(F.count(F.lit(1)).alias("requests"))
    return with_total(counts, counts.agg(F.sum("requests").alias("__all"))).select(
        provider, "requests", percent("requests", "__all").alias("share_pct")
    )


def provider_error_rate(df: DataFrame, failed: Column, provider: str = "provider") -> DataFrame:
    """Errors as a percentage of requests per provider."""
    return (
        df.groupBy(provider).agg(F.count(F.lit(1)).alias("requests"), count_if(failed).alias("errors"))
        .withColumn("error_rate_pct", percent("errors", "requests"))
    )


def _recent_means(df: DataFrame, failed: Column, order: list[str], latency: str, provider: str, n: int) -> DataFrame:
    recent = latest_n(df.where(~failed).select(provider, *order, latency), [provider], order, n)
    return recent.groupBy(provider).agg(F.avg(latency).alias("avg_latency"))


def provider_recent_latency(
    df: DataFrame, failed: Column, order: list[str], latency: str, provider: str = "provider", n: int = RECENT_CALLS
) -> DataFrame:
    """Mean latency of the last `n` successful calls per provider; 0 for a provider with none."""
    means = _recent_means(df, failed, order, latency, provider, n)
    return same_keys(df.select(provider).distinct(), means, [provider]).select(
        provider, F.coalesce("avg_latency", F.lit(0.0)).alias("avg_latency")
    )


def route_by_latency(routes: DataFrame, latencies: DataFrame) -> DataFrame:
    """Per path the provider with the least latency.

    routes: path, provider, registration (rank); latencies: provider, avg_latency.
    A provider without data sorts last; ties go to the earlier registration.
    """
    known = same_keys(routes, latencies.select("provider", "avg_latency"), ["provider"])
    best = F.min(F.struct(
        F.coalesce("avg_latency", F.lit(float("inf"))).alias("latency"), F.col("registration"), F.col("provider")
    ))
    return known.groupBy("path").agg(best.alias("__best")).select("path", F.col("__best.provider").alias("provider"))


def route_by_weight(requests: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Give every request a provider by weight.

    weights: provider, weight, one row per provider. The cumulative table is one
    array in one row, so every request is matched in place, without a join that
    grows with the providers.
    """
    total = weights.agg(F.sum("weight").alias("__sum"))
    w = Window.orderBy("provider").rowsBetween(Window.unboundedPreceding, 0)
    cum = with_total(weights, total).select(
        "provider", (F.sum("weight").over(w) / F.col("__sum")).alias("upto")
    )
    table = cum.agg(F.array_sort(F.collect_list(F.struct("upto", "provider"))).alias("__cum"))
    x = uniform(key)
    hit = F.filter("__cum", lambda c: c["upto"] >= F.col("__x"))
    return (
        with_total(requests.withColumn("__x", x), table)
        .withColumn("routed_to", F.coalesce(F.get(hit, F.lit(0))["provider"], F.element_at("__cum", -1)["provider"]))
        .drop("__x", "__cum")
    )


def available_providers(routes: DataFrame, health: DataFrame, breakers: DataFrame) -> DataFrame:
    """Routes whose provider is healthy and whose breaker is not open.

    health: provider, healthy; breakers: provider, state.
    """
    healthy = health.where("healthy").select("provider")
    blocked = breakers.where(F.col("state") == "OPEN").select("provider")
    return routes.join(healthy, "provider", "left_semi").join(blocked, "provider", "left_anti").select(*routes.columns)


def health_state(
    df: DataFrame, keys: list[str], order: list[str], failed: Column,
    threshold: int = FAILOVER_THRESHOLD, chunks: Chunks | None = None,
) -> DataFrame:
    """Length of the failure run after every check, and the state that follows from it."""
    data = df.select(*keys, *order, failed.alias("__failed"))
    chunks = chunks or plan_chunks(df, order[0])
    counted = streak(data, keys, order, chunks, F.col("__failed"), "consecutive_failures")
    return counted.select(
        *keys, *order, "consecutive_failures",
        F.when(F.col("consecutive_failures") >= threshold, "unhealthy").otherwise("healthy").alias("health"),
    )


def health_now(df: DataFrame, keys: list[str], order: list[str], failed: Column, threshold: int = FAILOVER_THRESHOLD) -> DataFrame:
    """Current health per key from its newest `threshold` checks alone."""
    recent = latest_n(df.select(*keys, *order, failed.alias("__failed")), keys, order, threshold)
    fails = count_if(F.col("__failed"))
    return recent.groupBy(*keys).agg((fails < threshold).alias("healthy"))


def request_outcome(requests: DataFrame, routes: DataFrame, available: DataFrame, open_breakers: DataFrame, failed: Column) -> DataFrame:
    """Status of every request: 404 without a route, 503 without a provider or behind an open breaker, 500, 200.

    requests: path, provider; routes: path; available: path; open_breakers: provider.
    """
    known = routes.select("path").distinct().withColumn("__routed", F.lit(True))
    served = available.select("path").distinct().withColumn("__served", F.lit(True))
    opened = open_breakers.select("provider").distinct().withColumn("__open", F.lit(True))
    joined = requests.join(known, "path", "left").join(served, "path", "left").join(opened, "provider", "left")
    outcome = (
        F.when(F.col("__routed").isNull(), 404)
        .when(F.col("__served").isNull() | F.col("__open").isNotNull(), 503)
        .when(failed, 500).otherwise(200)
    )
    return joined.withColumn("outcome", outcome.cast("bigint")).drop("__routed", "__served", "__open")


def routing_summary(
    gateways: DataFrame, routes: DataFrame, shares: DataFrame, latencies: DataFrame, health: DataFrame
) -> DataFrame:
    """One row per gateway with zeros where it is idle.

    gateways: provider, region, deployed.
    """
    counts = routes.groupBy("provider").agg(F.count_distinct("path").alias("routes_count"))
    out = gateways
    for part in (counts, shares.select("provider", "share_pct"), latencies, health):
        out = same_keys(out, part, ["provider"])
    state = F.when(F.col("healthy").isNull(), "unknown").when(F.col("healthy"), "healthy").otherwise("unhealthy")
    return out.select(
        "provider", "region", "deployed", state.alias("health"),
        F.coalesce("routes_count", F.lit(0)).alias("routes_count"),
        F.coalesce("share_pct", F.lit(0.0)).alias("request_pct"),
        F.coalesce("avg_latency", F.lit(0.0)).alias("avg_latency"),
    )


def gateway_metrics(
    df: DataFrame, failed: Column, order: list[str], latency: str, reset_ts: str | None = None, provider: str = "provider"
) -> DataFrame:
    """Requests, share, error rate, recent latency and health per provider.

    `reset_ts` starts a new epoch for the counters; health looks at all calls.
    """
    since = df if reset_ts is None else df.where(F.col(order[0]) >= F.lit(reset_ts).cast(df.schema[order[0]].dataType))
    rates = provider_error_rate(since, failed, provider)
    rates = with_total(rates, rates.agg(F.sum("requests").alias("__all"))).withColumn("share_pct", percent("requests", "__all"))
    recent = _recent_means(since, failed, order, latency, provider, RECENT_CALLS)
    health = health_now(df, [provider], order, failed)
    out = same_keys(same_keys(health, rates, [provider]), recent, [provider])
    return out.select(
        provider,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "errors")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("share_pct", "error_rate_pct", "avg_latency")],
        "healthy",
    )
