"""Alert evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, plan_chunks, runs
from fleetgauge.functions.common import interval, micros, with_total

AUTO_CLOSE_SECONDS = 604800.0


@dataclass(frozen=True)
class Rule:
    """Fires when `metric` stays above `bound` for `hold` seconds."""

    name: str
    metric: str
    bound: float
    hold: float
    severity: str


# Configured alert rules.
RULES = (
    Rule("high_gpu_utilization", "gpu_utilization", 90, 300, "warning"),
    Rule("high_error_rate", "error_rate", 5, 120, "critical"),
    Rule("high_latency", "latency_p95", 2000, 300, "warning"),
    Rule("cost_budget_exceeded", "cost_per_hour", 100, 600, "critical"),
)


def alert_for_duration(
    df: DataFrame, keys: list[str], order: list[str], rule: Rule, chunks: Chunks | None = None,
    auto_close: float | None = None,
) -> DataFrame:
    """One row per alert: the metric was above the bound for at least the hold time.

    Fires at run start + hold and is resolved by the first sample back at or
    under the bound, or after `auto_close` seconds; null while still active.
    """
    ts = order[0]
    found = runs(df, keys, order, chunks or plan_chunks(df, ts), F.col(rule.metric) > rule.bound)
    resolved = F.col("run_stop")
    if auto_close is not None:
        newest = df.agg(F.max(ts).alias("__now"))
        found = with_total(found, newest)
        limit = F.col("run_start") + interval(auto_close)
        resolved = F.coalesce(F.least(resolved, F.when(limit <= F.col("__now"), limit)), resolved)
    lasted = micros(F.coalesce(resolved, F.col("run_end"))) - micros("run_start")
    return found.where(lasted >= int(rule.hold * 1_000_000)).select(
        *keys, F.lit(rule.name).alias("alert"), F.lit(rule.severity).alias("severity"),
        "run_start", (F.col("run_start") + interval(rule.hold)).alias("fired_at"),
        resolved.alias("resolved_at"), "run_length",
    )


def alarm_m_periods(
    df: DataFrame, keys: list[str], ts: str, value: str, bound: float, width: str = "5 minutes", periods: int = 2
) -> DataFrame:
    """Periods that complete `periods` successive means above the bound; a missing period breaks the run."""
    means = df.groupBy(*keys, F.window(ts, width).alias("__w")).agg(F.avg(value).alias("mean_value")).select(
        *keys, F.col("__w.start").alias("period_start"), F.col("__w.end").alias("period_end"), "mean_value"
    )
    w = Window.partitionBy(*keys).orderBy("period_start")
    hit = F.col("mean_value") > bound
    for back in range(1, periods):
        gap = (micros("period_start") - micros(F.lag("period_start", back).over(w))) == back * (
            micros("period_end") - micros("period_start")
        )
        hit = hit & F.coalesce(gap & (F.lag("mean_value", back).over(w) > bound), F.lit(False))
    return means.withColumn("__hit", hit).where("__hit").drop("__hit")


def aligned_means(df: DataFrame, series: list[str], groups: list[str], ts: str, value: str, width: str = "60 seconds") -> DataFrame:
    """Mean per series and period, then the mean of those over the series of a group."""
    per_series = df.groupBy(*groups, *series, F.window(ts, width).start.alias("ts")).agg(F.avg(value).alias("__m"))
    return per_series.groupBy(*groups, "ts").agg(F.avg("__m").alias(value))


def alert_aligned(
    df: DataFrame, series: list[str], groups: list[str], ts: str, value: str, bound: float,
    width: str = "60 seconds", hold: float = 60, chunks: Chunks | None = None,
) -> DataFrame:
    """Alerts on the aligned mean of a group, closed after seven days at the latest."""
    aligned = aligned_means(df, series, groups, ts, value, width)
    rule = Rule(f"{value}_aligned", value, bound, hold, "warning")
    return alert_for_duration(
        aligned, groups, ["ts"], rule, Chunks("ts", (chunks or plan_chunks(df, ts)).splits), AUTO_CLOSE_SECONDS
    )


def alert_table(sources: list[DataFrame]) -> DataFrame:
    """All alerts in one table, newest first.

    Each source has ts, severity, resource, message and resolved_at.
    """
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.select(
        "ts", "severity", "resource", "message",
        F.when(F.col("resolved_at").isNull(), "Active").otherwise("Resolved").alias("status"),
    ).orderBy(F.col("ts").desc(), "resource", "message")


def rate_change_alert(df: DataFrame, keys: list[str], ts: str, width: str, threshold_pct: float = 50.0) -> DataFrame:
    """Windows whose request count differs from the window before by more than `threshold_pct` percent."""
    counts = df.groupBy(*keys, F.window(ts, width).start.alias("window_start")).agg(F.count(F.lit(1)).alias("requests"))
    w = Window.partitionBy(*keys).orderBy("window_start")
    before = F.lag("requests").over(w)
    change = F.try_divide((F.col("requests") - before) * F.lit(100.0), before)
    return counts.withColumn("change_pct", change).where(F.abs("change_pct") > threshold_pct)


def threshold_breaches(latest: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Latest metric values above their configured threshold.

    latest: metric and value beside any keys; thresholds: metric_group, metric, threshold.
    """
    return latest.join(thresholds, "metric").where(F.col("value") > F.col("threshold"))


def node_status(df: DataFrame, cpu: str, memory: str, gpu: str, bounds: tuple[float, float, float] = (80, 85, 90)) -> DataFrame:
    """Add `status`: Warning when any use is above its bound."""
    over: Column = F.lit(False)
    for c, b in zip((cpu, memory, gpu), bounds, strict=True):
        over = over | F.coalesce(F.col(c) > b, F.lit(False))
    return df.withColumn("status", F.when(over, "Warning").otherwise("Running"))
