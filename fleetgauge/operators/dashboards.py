"""Queries behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, exact_percentiles
from fleetgauge.functions.common import count_if, micros, percent, same_keys, with_total

# Dashboard time range -> (number of points, seconds between points).
TIME_RANGES = {
    "Last 1 hour": (60, 60),
    "Last 6 hours": (60, 360),
    "Last 24 hours": (60, 1440),
    "Last 7 days": (7, 86400),
    "Last 30 days": (30, 86400),
}
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_percentiles(
    df: DataFrame, keys: list[str], latency: str, wanted: dict[str, float] = PERCENTILES,
    approximate: bool = False, chunks: Chunks | None = None,
) -> DataFrame:
    """Latency percentiles per key: exact by default, or from a bounded sketch."""
    if not approximate:
        return exact_percentiles(df, keys, latency, wanted, chunks)
    return df.groupBy(*keys).agg(*[F.approx_percentile(latency, p).alias(n) for n, p in wanted.items()])


def request_summary(df: DataFrame, latency: str, failed: Column, approximate: bool = False) -> DataFrame:
    """Total, success percentage, mean and p95 latency over all requests."""
    base = df.agg(
        F.count(F.lit(1)).alias("requests"), percent(count_if(~failed), F.count(F.lit(1))).alias("success_pct"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean_latency"),
    )
    return with_total(base, latency_percentiles(df, [], latency, {"p95_latency": 0.95}, approximate))


def requests_per_model(df: DataFrame, model: str) -> DataFrame:
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("requests"))


def endpoint_latency(df: DataFrame, endpoint: str, latency: str, approximate: bool = False, chunks: Chunks | None = None) -> DataFrame:
    """Mean and percentiles of latency by endpoint, exact ones from the same counts as the mean."""
    if not approximate:
        found = exact_percentiles(df, [endpoint], latency, PERCENTILES, chunks, mean="mean_latency", rows="requests")
        return found.select(endpoint, "mean_latency", "requests", *PERCENTILES)
    return df.groupBy(endpoint).agg(
        F.avg(latency).alias("mean_latency"), F.count(F.lit(1)).alias("requests"),
        *[F.approx_percentile(latency, p).alias(n) for n, p in PERCENTILES.items()],
    )


def time_range_series(df: DataFrame, ts: str, time_range: str, aggs: dict[str, Column], now: Column | None = None) -> DataFrame:
    """Evenly spaced points back from `now` (the newest row by default), empty points included.

    Point k covers the step that ends k steps before `now`.
    """
    points, step = TIME_RANGES[time_range]
    spark = df.sparkSession
    newest = df.agg(F.max(ts).alias("__now")) if now is None else spark.range(1).select(now.alias("__now"))
    back = F.floor((micros("__now") - micros(ts)) / F.lit(step * 1_000_000)).cast("bigint")
    found = (
        with_total(df, newest).withColumn("__back", back).where(F.col("__back").between(0, points - 1))
        .groupBy("__back").agg(*[c.alias(n) for n, c in aggs.items()])
    )
    grid = with_total(spark.range(points).withColumnRenamed("id", "__back"), newest)
    at = F.col("__now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("__back") * step)
    return same_keys(grid, found, ["__back"]).select(
        (F.lit(points - 1) - F.col("__back")).alias("point"), at.alias("point_ts"), *aggs
    )


def resource_series(
    df: DataFrame, ts: str, metric: str, value: str, metrics: list[str], unclipped: tuple[str, ...], time_range: str,
) -> DataFrame:
    """Mean of each resource over time, one column per resource, clipped to 0..100 unless named in `unclipped`."""
    aggs = {}
    for m in metrics:
        mean = F.avg(F.when(F.col(metric) == m, F.col(value)))
        aggs[m] = mean if m in unclipped else F.least(F.greatest(mean, F.lit(0.0)), F.lit(100.0))
    return time_range_series(df, ts, time_range, aggs)


def rate_and_error_series(df: DataFrame, ts: str, width: str, failed: Column) -> DataFrame:
    """Requests per minute and error percentage per window."""
    w = F.window(ts, width)
    minutes = (micros("window_end") - micros("window_start")) / F.lit(60e6)
    return (
        df.groupBy(w.alias("__w")).agg(F.count(F.lit(1)).alias("requests"), count_if(failed).alias("__errors"))
        .select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), "requests", "__errors")
        .select(
            "window_start", "requests", (F.col("requests") / minutes).alias("requests_per_minute"),
            percent("__errors", "requests").alias("error_pct"),
        )
    )


def kpi_delta(df: DataFrame, ts: str, width: str, latency: str, failed: Column) -> DataFrame:
    """Requests, success percentage and mean latency per period, with the change from the period before."""
    kpi = df.groupBy(F.window(ts, width).start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"),
        percent(count_if(~failed), F.count(F.lit(1))).alias("success_pct"),
        F.avg(latency).alias("mean_latency"),
    )
    w = Window.orderBy("window_start")
    return kpi.select(
        "*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in ("requests", "success_pct", "mean_latency")]
    )


def cluster_cards(clusters: DataFrame, infra: DataFrame, hourly_cost: DataFrame) -> DataFrame:
    """Status, nodes, pods, region and cost per hour of every provider.

    clusters: provider, region, status; infra: provider, nodes, pods; hourly_cost: provider, cost_per_hour.
    """
    out = same_keys(same_keys(clusters, infra, ["provider"]), hourly_cost, ["provider"])
    return out.select(
        "provider", "status", "region",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "pods")],
        F.coalesce("cost_per_hour", F.lit(0.0)).alias("cost_per_hour"),
    )


def deployment_table(df: DataFrame, model: str, order: list[str], columns: list[str], endpoint: str) -> DataFrame:
    """Newest deployment record per model and the number of endpoints it has had."""
    newest = F.max(F.struct(*[F.col(o).alias(f"__o_{o}") for o in order], *[F.col(c) for c in columns]))
    return df.groupBy(model).agg(newest.alias("__new"), F.count_distinct(F.col(endpoint)).alias("endpoints")).select(
        model, *[F.col(f"__new.{c}").alias(c) for c in columns], "endpoints"
    )
