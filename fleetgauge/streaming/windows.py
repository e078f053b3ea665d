"""Windowed and joined streams: counters, series, debounce, request and response pairs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetgauge.functions.common import col, interval
from fleetgauge.operators import observability, telemetry


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as an instant (zone-less times are taken in the session zone) with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def counter_stream(
    df: DataFrame, labels: list[str], ts: str, width: str, delay: str, amount: str | Column | None = None
) -> DataFrame:
    """Increments per window and label set."""
    inc = F.count(F.lit(1)) if amount is None else F.sum(col(amount))
    return event_time(df, ts, delay).groupBy(F.window(ts, width), *labels).agg(inc.alias("value")).select(
        F.col("window.start").alias("window_start"), *labels, "value"
    )


def timeseries_stream(df: DataFrame, labels: list[str], value: str, order: list[str], width: str, delay: str) -> DataFrame:
    """One sample per interval and label set, as in the batch form."""
    return telemetry.metric_timeseries(event_time(df, order[0], delay), labels, value, order, width)


def debounce_stream(df: DataFrame, keys: list[str], order: list[str], wait_time: float, delay: str, keep: list[str] = ()) -> DataFrame:
    """Last event of every burst: a session closes after `wait_time` seconds without an event.

    Sessions that touch are merged, so the gap is one microsecond short of the wait.
    """
    ts = order[0]
    session = F.session_window(F.col(ts), f"{int(wait_time * 1_000_000) - 1} microseconds")
    last = F.max(F.struct(*[F.col(o) for o in order], *[F.col(c) for c in keep]))
    return event_time(df, ts, delay).groupBy(session, *keys).agg(last.alias("__last")).select(
        *keys, *[F.col(f"__last.{c}").alias(c) for c in (*order, *keep)], (F.col(f"__last.{ts}") + interval(wait_time)).alias("emitted_ts")
    )


def request_response_stream(
    requests: DataFrame, responses: DataFrame, key: str, delay: str, longest: float
) -> DataFrame:
    """Pair request and response records that are at most `longest` seconds apart; unpaired ones follow the watermark."""
    left = event_time(requests, "request_ts", delay)
    right = event_time(responses.withColumnRenamed(key, "__key"), "response_ts", delay)
    near = (F.col("response_ts") >= F.col("request_ts")) & (F.col("response_ts") <= F.col("request_ts") + interval(longest))
    joined = left.join(right, (F.col(key) == F.col("__key")) & near, "full_outer")
    # The batch operator adds the same columns once both sides are in one row.
    return observability.pair_columns(joined.withColumn(key, F.coalesce(key, "__key")).drop("__key"))


def span_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append spans as JSON lines, each exactly once."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def snapshot_sink(df: DataFrame, path: str, checkpoint: str, ts: str = "ts", provider: str = "provider") -> DataStreamWriter:
    """Append history by provider and hour, once per clock hour."""
    out = df.withColumn("hour", F.date_format(F.date_trunc("hour", F.col(ts)), "yyyy-MM-dd-HH"))
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(provider, "hour").trigger(processingTime="1 hour").outputMode("append")
    )
