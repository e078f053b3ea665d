"""Resilience rules replayed over event tables: breaker, rate limit, debounce, TTL cache, retries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, following, plan_chunks, prefix
from fleetgauge.functions.common import interval, micros, same_keys
from fleetgauge.functions.replay import BreakerRule, breaker, hold_off, map_batches


def circuit_breaker(
    df: DataFrame, keys: list[str], order: list[str], failed: Column,
    failure_threshold: int = 5, recovery_timeout: float = 60, half_open_max_calls: int = 1,
    reset_on_success: bool = True, chunks: Chunks | None = None,
) -> DataFrame:
    """Breaker state before and after every call, and whether the call was rejected.

    `reset_on_success=False` keeps counting failures over successes in the CLOSED state.
    """
    data = df.select(*keys, *order, F.coalesce(failed, F.lit(False)).alias("failed"))
    rule = BreakerRule(failure_threshold, int(recovery_timeout * 1_000_000), half_open_max_calls, reset_on_success)
    return breaker(data, keys, order, "failed", chunks or plan_chunks(df, order[0]), rule)


def breaker_status(
    replayed: DataFrame, keys: list[str], order: list[str], failure_threshold: int, recovery_timeout: float
) -> DataFrame:
    """Newest state, failure count and last counted failure per key of `circuit_breaker` output."""
    newest = F.max(F.struct(*[F.col(o) for o in order], "state_after", "failure_count"))
    return replayed.groupBy(*keys).agg(
        newest.alias("__new"),
        F.max(F.when(F.col("failed") & ~F.col("rejected"), F.col(order[0]))).alias("last_failure_ts"),
    ).select(
        *keys, F.col("__new.state_after").alias("state"), F.col("__new.failure_count").alias("failure_count"),
        "last_failure_ts", F.lit(failure_threshold).cast("bigint").alias("failure_threshold"),
        F.lit(float(recovery_timeout)).alias("recovery_timeout"),
    )


def rate_limit_flags(
    df: DataFrame, keys: list[str], order: list[str], calls: int, period: float, chunks: Chunks | None = None
) -> DataFrame:
    """Calls in the window that ends at each call (both ends included) and whether they exceed the limit.

    The count is a difference of two running counts, up to the call and up to
    just before the start of its window. Calls are first counted per time, and a
    probe at each window start takes part in the same running sum, so a period of
    any density costs two rows per distinct time.
    """
    ts = order[0]
    data = df.select(*keys, *order)
    splits = (chunks or plan_chunks(df, ts)).splits
    us = micros(ts).alias("__us")
    times = data.groupBy(*keys, us).agg(F.count(F.lit(1)).alias("__n")).withColumn("__t", F.col("__us")).withColumn("__kind", F.lit(1))
    probes = times.withColumn("__t", F.col("__us") - int(period * 1_000_000)).withColumn("__kind", F.lit(0)).withColumn(
        "__n", F.lit(0).cast("bigint")
    )
    summed = prefix(
        times.unionByName(probes), keys, ["__t", "__kind"], Chunks("__t", splits), {"__upto": ("sum", F.col("__n"))}
    )
    # A time has one row of each kind: the running count at the call, and at its probe.
    held = summed.groupBy(*keys, "__us").agg(F.sum(
        F.when(F.col("__kind") == 1, F.col("__upto")).otherwise(-F.col("__upto"))
    ).alias("calls_in_period"))
    return same_keys(data.withColumn("__us", micros(ts)), held, [*keys, "__us"]).select(
        *keys, *order, "calls_in_period", (F.col("calls_in_period") > calls).alias("exceeded")
    )


def rate_limit_admission(
    df: DataFrame, keys: list[str], order: list[str], calls: int, period: float, chunks: Chunks | None = None
) -> DataFrame:
    """Time at which each call is admitted when calls over the limit wait.

    Call k waits for call k - calls to leave the window:
    admitted(k) = max(arrival(k), admitted(k - calls) + period). Within a lane
    (k mod calls) that is a running maximum of arrival - lane position * period.
    """
    ts = order[0]
    data = df.select(*keys, *order)
    chunks = chunks or plan_chunks(df, ts)
    p = F.lit(int(period * 1_000_000)).cast("bigint")
    one = F.lit(1).cast("bigint")
    numbered = (
        prefix(data, keys, order, chunks, {"__k": ("sum", one)})
        .withColumn("__lane", F.pmod(F.col("__k") - 1, F.lit(calls)))
        .withColumn("__at", F.floor((F.col("__k") - 1) / F.lit(calls)))
        .withColumn("__slack", micros(ts) - F.col("__at") * p)
    )
    lanes = prefix(numbered, [*keys, "__lane"], order, chunks, {"__worst": ("max", F.col("__slack"))})
    wait = F.col("__worst") + F.col("__at") * p - micros(ts)
    seconds = (wait / F.lit(1e6)).cast("double")
    return lanes.select(
        *keys, *order, seconds.alias("wait_seconds"),
        (F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait / F.lit(1_000_000))).alias("admitted_ts"),
    )


def debounce(df: DataFrame, keys: list[str], order: list[str], wait_time: float, chunks: Chunks | None = None) -> DataFrame:
    """The last event of every burst: no newer event of the key within `wait_time`."""
    ts = order[0]
    chunks = chunks or plan_chunks(df, ts)
    nexts = following(df, keys, order, chunks, {"__next_ts": ts})
    quiet = F.col("__next_ts").isNull() | (micros("__next_ts") - micros(ts) >= int(wait_time * 1_000_000))
    return nexts.where(quiet).select(*df.columns, (F.col(ts) + interval(wait_time)).alias("emitted_ts"))


def ttl_cache_hits(df: DataFrame, keys: list[str], order: list[str], ttl: float, chunks: Chunks | None = None) -> DataFrame:
    """Whether each lookup hits an entry younger than `ttl`; only a miss stores."""
    us = int(ttl * 1_000_000)
    data = df.select(*keys, *order, F.lit(us).cast("bigint").alias("__hold"))
    marked = hold_off(data, keys, order, "__hold", us, chunks or plan_chunks(df, order[0]), "miss")
    return marked.select(*keys, *order, (~F.col("miss")).alias("hit"))


def failure_stats(df: DataFrame, error_type: str, ts: str) -> DataFrame:
    """Count and last time per error type."""
    return df.where(F.col(error_type).isNotNull()).groupBy(error_type).agg(
        F.count(F.lit(1)).alias("failures"), F.max(ts).alias("last_failure_ts")
    )


def retry_schedule(
    operations: DataFrame, key: str, started: str, max_retries: int = 3, base_delay: float = 1.0, factor: float = 2.0
) -> DataFrame:
    """Expected time of every attempt: the first at the start, then after base * factor^n more seconds."""
    waited = F.aggregate(
        F.sequence(F.lit(1), F.col("attempt")), F.lit(0.0),
        lambda acc, i: acc + F.lit(float(base_delay)) * F.pow(F.lit(float(factor)), i - 1),
    )
    waited = F.when(F.col("attempt") == 0, F.lit(0.0)).otherwise(waited)
    return (
        operations.select(key, started, F.explode(F.sequence(F.lit(0), F.lit(max_retries))).alias("attempt"))
        .withColumn("delay_seconds", waited)
        .withColumn("expected_ts", F.col(started) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), "delay_seconds"))
        .withColumn("attempt", F.col("attempt").cast("bigint"))
    )


def match_attempts(
    schedule: DataFrame, attempts: DataFrame, key: str, schedule_id: list[str], ts: str, attempt_id: str,
    tolerance: float, chunks: Chunks | None = None,
) -> DataFrame:
    """First logged attempt of the key at or up to `tolerance` seconds after each expected time.

    An as-of join without a join: expected and logged times go into one ordered
    sequence, and the running minimum from its end is, for each expected time,
    the first attempt that follows. Every row is read once, whatever the number
    of rows per key.
    """
    none = F.lit(None)
    expected = schedule.select(
        key, F.col("expected_ts").alias("__t"), F.lit(0).alias("__kind"),
        F.struct(*schedule_id).alias("__sid"), none.cast(attempts.schema[attempt_id].dataType).alias("__aid"),
    )
    logged = attempts.select(
        key, F.col(ts).alias("__t"), F.lit(1).alias("__kind"),
        none.cast(expected.schema["__sid"].dataType).alias("__sid"), F.col(attempt_id).alias("__aid"),
    )
    chunks = Chunks("__t", (chunks or plan_chunks(attempts, ts)).splits)
    found = prefix(
        expected.unionByName(logged), [key], ["__t", "__kind", "__sid", "__aid"], chunks,
        {"__first": ("min", F.when(F.col("__kind") == 1, F.struct("__t", "__aid")))}, reverse=True,
    ).where(F.col("__kind") == 0)
    near = micros("__first.__t") - micros("__t") <= int(tolerance * 1_000_000)
    return found.select(
        key, *[F.col(f"__sid.{c}").alias(c) for c in schedule_id], F.col("__t").alias("expected_ts"),
        F.when(near, F.col("__first.__t")).alias("matched_ts"), F.when(near, F.col("__first.__aid")).alias("matched_id"),
    )


def map_partitions(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user function to all rows in parallel, batch by batch; rows carry their own order key."""
    return map_batches(df, fn, schema)
