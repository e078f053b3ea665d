"""Logs, traces and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import exact_percentiles
from fleetgauge.functions.common import count_if, cut, micros, percent, same_keys


def log_filter(
    df: DataFrame, levels: list[str] | None = None, components: list[str] | None = None, term: str = "",
    since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Log rows by level, component, time range and a case-insensitive literal substring."""
    out = df
    if levels is not None:
        out = out.where(F.col("level").isin(levels))
    if components is not None:
        out = out.where(F.col("component").isin(components))
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    return out.where(F.lower("message").contains(term.lower())) if term else out


def log_search(df: DataFrame, tie: str, limit: int | None = None, **filters) -> DataFrame:
    """Matching rows, newest first; with `limit` only a top-k per task is kept."""
    out = log_filter(df, **filters).orderBy(F.col("ts").desc(), F.col(tie).desc())
    return out if limit is None else out.limit(limit)


def log_count(df: DataFrame, **filters) -> DataFrame:
    """Number of matching rows."""
    return log_filter(df, **filters).agg(F.count(F.lit(1)).alias("logs"))


def pair_columns(df: DataFrame) -> DataFrame:
    """Add `duration_ms` and `pairing` to rows with request_ts and response_ts."""
    took = (micros("response_ts") - micros("request_ts")) / F.lit(1e3)
    state = F.when(F.col("response_ts").isNull(), "no_response").when(F.col("request_ts").isNull(), "no_request").otherwise("paired")
    return df.withColumn("duration_ms", took).withColumn("pairing", state)


def request_response_join(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Pair request and response records; the unpaired of both sides stay.

    requests: key, request_ts; responses: key, response_ts, status_code.
    """
    return pair_columns(requests.join(responses, key, "full_outer"))


def error_summary(df: DataFrame, endpoint: str, method: str, error_type: str, code: str, duration: str) -> DataFrame:
    """Errors by endpoint, method, type and status (500 when the error has no code)."""
    status = F.coalesce(F.col(code), F.lit(500)).cast("bigint")
    return df.where(F.col(error_type).isNotNull()).groupBy(endpoint, method, error_type, status.alias("status")).agg(
        F.count(F.lit(1)).alias("errors"), F.avg(duration).alias("mean_duration"), F.max(duration).alias("max_duration")
    )


def span_durations(df: DataFrame, start: str = "start", end: str = "end", status: str = "status") -> DataFrame:
    """Add `duration` (null while the span is open) and `is_error`."""
    return df.withColumn("duration", F.col(end) - F.col(start)).withColumn(
        "is_error", F.coalesce(F.lower(status) == "error", F.lit(False))
    )


def span_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spans, open spans, errors and duration percentiles per service or name."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spans"), count_if(F.col("duration").isNull()).alias("open_spans"),
        count_if(F.col("is_error")).alias("errors"), F.avg("duration").alias("mean_duration"),
    )
    return same_keys(base, exact_percentiles(df, keys, "duration", {"p50": 0.5, "p95": 0.95}), keys)


def trace_tree(df: DataFrame, trace: str, span: str, parent: str) -> DataFrame:
    """Root, depth and number of children of every span.

    A span without a known parent is a root. Spans that lie on a cycle of parents or hang from one have no
    root: root_id and depth are null. A span that is reported repeatedly counts once, with its smallest parent.

    Each round doubles the distance that a span sees up its chain and moves only those that haven't
    reached a root; the others are done and only looked up. The depth of a trace is less than its number of
    spans, so the logarithm of the largest trace bounds the rounds, and what still moves then is cyclic.
    Each lookup is by (trace, span), which is unique on one side; adaptive execution splits the
    other where many spans look for one root.
    """
    links = df.groupBy(trace, span).agg(F.min(parent).alias(parent))
    ids = links.select(F.col(trace).alias("__t"), F.col(span).alias("__id"))
    known = links.join(ids, (F.col(trace) == F.col("__t")) & (F.col(parent) == F.col("__id")), "left")
    found = F.col("__id").isNotNull()
    moving = cut(known.select(
        trace, span, F.when(found, F.col(parent)).otherwise(F.col(span)).alias("root_id"),
        F.when(found, 1).otherwise(0).cast("bigint").alias("depth"), F.when(found, F.col(parent)).alias("__parent"),
    ))
    done = moving.where("depth = 0")
    moving = moving.where("depth > 0")
    largest = df.groupBy(trace).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(largest.bit_length() + 1):
        if not moving.limit(1).count():
            break
        up = done.select(trace, span, "root_id", "depth", F.lit(True).alias("__ends")).unionByName(
            moving.select(trace, span, "root_id", "depth", F.lit(False).alias("__ends")))
        up = up.toDF("__t", "__s", "__up", "__more", "__ends")
        seen = cut(moving.join(up, (F.col(trace) == F.col("__t")) & (F.col("root_id") == F.col("__s"))).select(
            trace, span, F.col("__up").alias("root_id"), (F.col("depth") + F.col("__more")).alias("depth"), "__parent", "__ends",
        ))
        done = done.unionByName(seen.where("__ends").drop("__ends"))
        moving = seen.where("NOT __ends").drop("__ends")
    lost = moving.withColumns({"root_id": F.lit(None).cast(df.schema[span].dataType), "depth": F.lit(None).cast("bigint")})
    state = done.unionByName(lost)
    children = state.where(F.col("__parent").isNotNull()).groupBy(trace, F.col("__parent").alias(span)).agg(
        F.count(F.lit(1)).alias("children")
    )
    return same_keys(state.drop("__parent"), children, [trace, span]).select(
        trace, span, "root_id", "depth", F.coalesce("children", F.lit(0)).alias("children")
    )


def trace_context(df: DataFrame, headers: str, current_trace: str, current_span: str) -> DataFrame:
    """Trace and span id from incoming headers, and the headers to send on.

    The outgoing pair is set only when both current ids are known.
    """
    # Header names.
    trace_header, span_header = "X-Trace-ID", "X-Span-ID"
    both = F.coalesce(F.length(current_trace) > 0, F.lit(False)) & F.coalesce(F.length(current_span) > 0, F.lit(False))
    kept = F.map_filter(headers, lambda k, _: ~k.isin(trace_header, span_header))
    sent = F.create_map(F.lit(trace_header), F.col(current_trace), F.lit(span_header), F.col(current_span))
    return df.withColumns({
        "trace_id": F.col(headers)[trace_header], "span_id": F.col(headers)[span_header],
        "outgoing": F.when(both, F.map_concat(kept, sent)).otherwise(F.col(headers)),
    })


def audit_summary(audit: DataFrame, roles: DataFrame, user: str, action: str, ts: str) -> DataFrame:
    """Actions per user with role: count, models touched and last time.

    roles: user, role. Rows are counted before they meet the roles.
    """
    counts = audit.groupBy(user, action).agg(
        F.count(F.lit(1)).alias("actions"), F.count_distinct("model").alias("models"), F.max(ts).alias("last_ts")
    )
    return same_keys(counts, roles.select(user, "role"), [user]).withColumn("role", F.coalesce("role", F.lit("unknown")))


def security_coverage(df: DataFrame, model: str, controls: list[str]) -> DataFrame:
    """Models that meet each control, as n, m and percent."""
    n = df.agg(
        F.count_distinct(F.col(model)).alias("models"),
        *[F.count_distinct(F.when(F.col(c), F.col(model))).alias(c) for c in controls],
    )
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("control"), F.col(c).alias("covered")) for c in controls]))
    return n.select(rows, "models").withColumn("coverage_pct", percent("covered", "models"))
