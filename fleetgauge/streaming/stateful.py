"""Keyed rules with state: breaker, TTL cache, cooldown and rate limit.

A micro-batch hands each key its new rows; they are taken in time order and the
state between batches is a few numbers per key. Rows that arrive in a later batch
than a newer row of their key are applied on arrival. The rows of a key in one
micro-batch are in memory together: bound them by the source's rate
(maxFilesPerTrigger, maxOffsetsPerTrigger). A key that sees no row for
`forget` seconds of event time loses its state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetgauge.functions.common import micros
from fleetgauge.functions.replay import BREAKER_COLUMNS, NEVER, BreakerRule
from fleetgauge.operators import capacity
from fleetgauge.operators.capacity import DEFAULTS, Scaling
from fleetgauge.operators.routing import FAILOVER_THRESHOLD
from fleetgauge.streaming.windows import event_time


def _stateful(
    df: DataFrame, keys: list[str], order: list[str], extra: list[str], delay: str, forget: float,
    out_columns: str, state_schema: str, start: tuple,
    step: Callable[[pd.DataFrame, tuple], tuple[dict[str, list], tuple]],
) -> DataFrame:
    cols = [*keys, *order, *extra]
    data = event_time(df.select(*cols), order[0], delay).withColumn("__us", micros(order[0]))
    schema = T.StructType([data.schema[c] for c in cols]).toDDL() + f", {out_columns}"
    sort_by = ["__us", *order[1:]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(sort_by)
        added, left = step(rows, state.get if state.exists else start)
        state.update(left)
        last_ms = int(rows["__us"].iloc[-1]) // 1000
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + int(forget * 1000) + 1)
        yield rows[cols].assign(**added)

    return data.groupBy(*keys).applyInPandasWithState(
        run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def breaker_stream(
    df: DataFrame, keys: list[str], order: list[str], failed: Column, delay: str,
    failure_threshold: int = 5, recovery_timeout: float = 60, half_open_max_calls: int = 1,
    reset_on_success: bool = True, forget: float = 86400,
) -> DataFrame:
    """Breaker state around every call; the columns of the batch operator."""
    rule = BreakerRule(failure_threshold, int(recovery_timeout * 1_000_000), half_open_max_calls, reset_on_success)

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict[str, list], tuple]:
        out, code, until = rule.walk(rows["__us"].tolist(), rows["failed"].tolist(), *state)
        return out, (code, until)

    data = df.withColumn("failed", F.coalesce(failed, F.lit(False)))
    return _stateful(
        data, keys, order, ["failed"], delay, forget, BREAKER_COLUMNS, "code bigint, until bigint", (0, NEVER), step
    )


def hold_off_stream(
    df: DataFrame, keys: list[str], order: list[str], hold_us: str, out: str, delay: str, forget: float = 86400
) -> DataFrame:
    """Rows let through at least one hold time after the last one that was."""

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict[str, list], tuple]:
        until, through = state[0], []
        for ts, hold in zip(rows["__us"].tolist(), rows[hold_us].tolist(), strict=True):
            through.append(ts >= until)
            if ts >= until:
                until = ts + hold
        return {out: through}, (until,)

    return _stateful(df, keys, order, [hold_us], delay, forget, f"`{out}` boolean", "until bigint", (NEVER,), step)


def ttl_cache_stream(df: DataFrame, keys: list[str], order: list[str], ttl: float, delay: str) -> DataFrame:
    """Hit or miss per lookup; a key is forgotten once its entry has expired."""
    held = df.withColumn("__hold", F.lit(int(ttl * 1_000_000)).cast("bigint"))
    marked = hold_off_stream(held, keys, order, "__hold", "__miss", delay, forget=ttl)
    return marked.select(*keys, *order, (~F.col("__miss")).alias("hit"))


def rate_limit_stream(df: DataFrame, keys: list[str], order: list[str], calls: int, period: float, delay: str) -> DataFrame:
    """Whether a call exceeds the limit. The last `calls` times per key decide, so no more are kept.

    Of calls at one time the batch operator counts all for each; a stream sees them one by one and counts those before.
    """
    span = int(period * 1_000_000)

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict[str, list], tuple]:
        recent, flags = deque(state[0], calls), []
        for ts in rows["__us"].tolist():
            flags.append(len(recent) == calls and ts - recent[0] <= span)
            recent.append(ts)
        return {"exceeded": flags}, (list(recent),)

    return _stateful(df, keys, order, [], delay, period, "exceeded boolean", "recent array<bigint>", ([],), step)


def admission_stream(df: DataFrame, keys: list[str], order: list[str], calls: int, period: float, delay: str, forget: float = 86400) -> DataFrame:
    """Time at which each call is admitted when calls over the limit wait; the admissions of the last `calls` calls are kept.

    Choose `forget` longer than any wait: a key that is forgotten admits its next call at once.
    """
    span = int(period * 1_000_000)

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict[str, list], tuple]:
        admitted, waits = deque(state[0], calls), []
        for ts in rows["__us"].tolist():
            at = max(ts, admitted[0] + span) if len(admitted) == calls else ts
            admitted.append(at)
            waits.append(at - ts)
        return {"wait_us": waits}, (list(admitted),)

    out = _stateful(df, keys, order, [], delay, forget, "wait_us bigint", "admitted array<bigint>", ([],), step)
    later = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("wait_us") / F.lit(1_000_000))
    return out.select(*keys, *order, (F.col("wait_us") / F.lit(1e6)).alias("wait_seconds"), (F.col(order[0]) + later).alias("admitted_ts"))


def health_stream(df: DataFrame, keys: list[str], order: list[str], failed: Column, delay: str, threshold: int = FAILOVER_THRESHOLD) -> DataFrame:
    """Length of the failure run after every check, and the health that follows from it."""

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict[str, list], tuple]:
        run, out = state[0], []
        for fail in rows["failed"].tolist():
            run = run + 1 if fail else 0
            out.append(run)
        return {"consecutive_failures": out}, (run,)

    data = df.withColumn("failed", F.coalesce(failed, F.lit(False)))
    counted = _stateful(data, keys, order, ["failed"], delay, 86400, "consecutive_failures bigint", "run bigint", (0,), step)
    health = F.when(F.col("consecutive_failures") >= threshold, "unhealthy").otherwise("healthy")
    return counted.select(*keys, *order, "consecutive_failures", health.alias("health"))


def decision_stream(snapshots: DataFrame, delay: str, cfg: Scaling = DEFAULTS) -> DataFrame:
    """Scaling decisions from a stream of provider snapshots, outside the stabilisation windows.

    Sizing, cost cap and reason are projections; only the cooldown keeps state.
    """
    sized = capacity.cost_cap(capacity.reactive_size(snapshots, cfg=cfg), cfg=cfg).where(
        F.col("capped_size") != F.col("gpu_node_count")
    )
    window = F.when(F.col("capped_size") > F.col("gpu_node_count"), int(cfg.window_up * 1e6)).otherwise(int(cfg.window_down * 1e6))
    packed = capacity.scaling_reason(sized, desired="capped_size", cfg=cfg).select(
        "provider", "ts", F.col("gpu_node_count").alias("current_size"), "capped_size", "reason", window.cast("bigint").alias("hold_us")
    )
    kept = ["current_size", "capped_size", "reason"]
    marked = hold_off_stream(packed, ["provider"], ["ts", *kept], "hold_us", "accepted", delay)
    return marked.where("accepted").select("provider", "ts", "current_size", F.col("capped_size").alias("desired_size"), "reason")
