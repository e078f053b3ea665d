"""Registered queries: logs, traces, audit and the artifact catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import crypto, redact
from fleetgauge.operators import catalog, observability
from fleetgauge.plans.registry import query
from fleetgauge.plans.traffic_queries import failed, rounded
from fleetgauge.plans.views import Views
from fleetgauge.sources import blockdigest

# Logs, traces, audit ------------------------------------------------------------


@query("log_search", "logs", """
SELECT event_id, ts, level, component, message FROM logs WHERE level IN ('ERROR', 'WARNING') AND component = 'api'
  AND contains(lower(message), '"k": 1') AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC""")
def _(v: Views) -> DataFrame:
    since = F.lit("2024-01-05").cast("timestamp_ntz")
    return observability.log_search(
        v.logs, "event_id", levels=["ERROR", "WARNING"], components=["api"], term='"K": 1', since=since
    )


@query("log_count", "logs", "SELECT count(*) AS logs FROM logs WHERE level <> 'INFO' AND contains(lower(message), '7')")
def _(v: Views) -> DataFrame:
    return observability.log_count(v.logs, levels=["ERROR", "WARNING"], term="7")


@query("request_response_join", "calls", """
WITH q AS (SELECT call_id AS request_id, ts AS request_ts, endpoint FROM calls WHERE event_type <> 'signup'),
p AS (SELECT call_id AS request_id, ts + to_milliseconds(CAST(round(latency_ms) AS INTEGER)) AS response_ts, status_code FROM calls WHERE event_type <> 'view')
SELECT coalesce(q.request_id, p.request_id) AS request_id, request_ts, endpoint, response_ts, status_code,
  (epoch_us(response_ts) - epoch_us(request_ts)) / 1e3 AS duration_ms,
  CASE WHEN response_ts IS NULL THEN 'no_response' WHEN request_ts IS NULL THEN 'no_request' ELSE 'paired' END AS pairing
FROM q FULL JOIN p ON q.request_id = p.request_id""")
def _(v: Views) -> DataFrame:
    calls = v.calls.withColumnRenamed("call_id", "request_id")
    requests = calls.where(F.col("event_type") != "signup").select("request_id", F.col("ts").alias("request_ts"), "endpoint")
    took = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round("latency_ms") / 1000)
    responses = calls.where(F.col("event_type") != "view").select(
        "request_id", (F.col("ts") + took).alias("response_ts"), "status_code"
    )
    return observability.request_response_join(requests, responses)


@query("error_summary", "calls", """
SELECT endpoint, method, provider AS error_type, CAST(CASE WHEN user_id % 3 = 0 THEN 500 ELSE 400 + user_id % 10 END AS BIGINT) AS status,
  count(*) AS errors, round(avg(latency_ms), 6) AS mean_duration, max(latency_ms) AS max_duration
FROM calls WHERE status_code >= 500 GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    seen = v.calls.withColumn("error_type", F.when(failed(), F.col("provider"))).withColumn(
        "code", F.when(F.col("user_id") % 3 != 0, 400 + F.col("user_id") % 10)
    )
    return rounded(observability.error_summary(seen, "endpoint", "method", "error_type", "code", "latency_ms"), "mean_duration", places=6)


@query("redact", "", """
SELECT event_id, '{"api_key": "[REDACTED]", "auth": {"user": "u' || user_id || '", "Token": "[REDACTED]"}, "emails": ["a", {"phone": "[REDACTED]", "n": '
  || event_id || '}], "note": "' || event_type || '"}' AS body FROM events""")
def _(v: Views) -> DataFrame:
    body = F.concat(
        F.lit('{"api_key": "x", "auth": {"user": "u'), "user_id", F.lit('", "Token": '), "event_id",
        F.lit('}, "emails": ["a", {"phone": null, "n": '), "event_id", F.lit('}], "note": "'), "event_type", F.lit('"}'),
    )
    return v.events.select("event_id", redact.redact_json(body).alias("body"))


_SPANS = """s AS (SELECT conv_id AS trace_id, turn AS span_id, role AS service, CASE WHEN turn = 3 THEN NULL ELSE length(text) END AS duration,
  turn = 1 AND conv_id % 3 = 0 AS is_error FROM conversations)"""


def _spans(v: Views) -> DataFrame:
    timed = v.conversations.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.col("role").alias("service"),
        (F.col("turn") * 1000).alias("start"),
        F.when(F.col("turn") != 3, F.col("turn") * 1000 + F.length("text")).alias("end"),
        F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), "ERROR").otherwise("ok").alias("status"),
    )
    return observability.span_durations(timed)


@query("span_durations", "", f"""
WITH {_SPANS}
SELECT trace_id, span_id, service, CAST(duration AS BIGINT) AS duration, is_error FROM s""")
def _(v: Views) -> DataFrame:
    return _spans(v).select("trace_id", "span_id", "service", "duration", "is_error")


@query("span_stats", "", f"""
WITH {_SPANS}
SELECT service, count(*) AS spans, count(*) FILTER (duration IS NULL) AS open_spans, count(*) FILTER (is_error) AS errors,
  round(avg(duration), 6) AS mean_duration, round(quantile_cont(duration, 0.5), 4) AS p50, round(quantile_cont(duration, 0.95), 4) AS p95
FROM s GROUP BY service""")
def _(v: Views) -> DataFrame:
    out = observability.span_stats(_spans(v), ["service"])
    return rounded(rounded(out, "mean_duration", places=6), "p50", "p95")


@query("trace_tree", "spans", """
WITH RECURSIVE t AS (SELECT trace_id, span_id, span_id AS root_id, 0 AS depth FROM spans s
    WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id)
  UNION ALL SELECT s.trace_id, s.span_id, t.root_id, t.depth + 1 FROM spans s JOIN t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id),
c AS (SELECT trace_id, parent_id, count(*) AS children FROM spans GROUP BY ALL)
SELECT t.trace_id, t.span_id, t.root_id, CAST(t.depth AS BIGINT) AS depth, coalesce(c.children, 0) AS children
FROM t LEFT JOIN c ON c.trace_id = t.trace_id AND c.parent_id = t.span_id""")
def _(v: Views) -> DataFrame:
    return observability.trace_tree(v.spans, "trace_id", "span_id", "parent_id")


@query("trace_context", "", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 't' || user_id END AS trace_id, CASE WHEN user_id % 3 = 0 THEN 's' || event_id END AS span_id,
  CASE WHEN user_id % 5 <> 0 THEN 'cur' || user_id WHEN user_id % 2 = 0 THEN 't' || user_id END AS sent_trace FROM events""")
def _(v: Views) -> DataFrame:
    u = F.col("user_id")
    headers = F.map_concat(
        F.when(u % 2 == 0, F.create_map(F.lit("X-Trace-ID"), F.concat(F.lit("t"), u))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(u % 3 == 0, F.create_map(F.lit("X-Span-ID"), F.concat(F.lit("s"), "event_id"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    seen = v.events.select(
        "event_id", headers.alias("headers"), F.concat(F.lit("cur"), u).alias("cur_trace"), F.when(u % 5 != 0, "sp").alias("cur_span")
    )
    out = observability.trace_context(seen, "headers", "cur_trace", "cur_span")
    return out.select("event_id", "trace_id", "span_id", F.col("outgoing")["X-Trace-ID"].alias("sent_trace"))


@query("audit_summary", "calls", """
SELECT user_id, event_type, count(*) AS actions, count(DISTINCT model) AS models, max(ts) AS last_ts,
  CASE WHEN user_id % 4 = 0 THEN 'admin' WHEN user_id % 4 = 1 THEN 'viewer' ELSE 'unknown' END AS role FROM calls GROUP BY user_id, event_type""")
def _(v: Views) -> DataFrame:
    roles = v.calls.where(F.col("user_id") % 4 < 2).select(
        "user_id", F.when(F.col("user_id") % 4 == 0, "admin").otherwise("viewer").alias("role")
    ).distinct()
    return observability.audit_summary(v.calls, roles, "user_id", "event_type", "ts")


@query("security_coverage", "artifacts", """
WITH m AS (SELECT count(DISTINCT model_name) AS models, count(DISTINCT CASE WHEN provider = 'zh' AND size_bytes > 40000 THEN model_name END) AS encrypted,
  count(DISTINCT CASE WHEN version % 97 = 0 THEN model_name END) AS controlled FROM artifacts)
SELECT 'encrypted' AS control, encrypted AS covered, models, round(100.0 * encrypted / models, 4) AS coverage_pct FROM m
UNION ALL SELECT 'controlled', controlled, models, round(100.0 * controlled / models, 4) FROM m""")
def _(v: Views) -> DataFrame:
    flagged = v.artifacts.select(
        "model_name", ((F.col("provider") == "zh") & (F.col("size_bytes") > 40000)).alias("encrypted"),
        (F.col("version") % 97 == 0).alias("controlled"),
    )
    return rounded(observability.security_coverage(flagged, "model_name", ["encrypted", "controlled"]), "coverage_pct")


# Artifact catalog ------------------------------------------------------------------

_CATALOG = """reg AS (SELECT model_name, CAST(version % 40 AS VARCHAR) AS version, provider, version AS seq, size_bytes,
  TIMESTAMP '2024-01-01' + to_days(CAST(version % 50 AS INTEGER)) AS registered_at, sha256(content) AS checksum FROM artifacts),
cat AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_name, version ORDER BY seq DESC) AS rn FROM reg) WHERE rn = 1),
loc AS (SELECT model_name, version, provider, min(seq) AS pos FROM reg GROUP BY ALL),
act AS (SELECT model_name, version, provider, arg_min(checksum, seq) AS actual_checksum FROM reg WHERE size_bytes % 9 <> 0 GROUP BY ALL)"""


def _registrations(v: Views) -> DataFrame:
    days = F.make_dt_interval((F.col("doc_id") % 50).cast("int"), F.lit(0), F.lit(0), F.lit(0.0))
    return v.documents.select(
        F.initcap("source").alias("model_name"), (F.col("doc_id") % 40).cast("string").alias("version"),
        F.col("lang").alias("provider"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size_bytes"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + days).alias("registered_at"), crypto.checksum("text").alias("checksum"),
    )


def _catalog(v: Views) -> DataFrame:
    return catalog.register_versions(None, _registrations(v))


def _locations(v: Views) -> DataFrame:
    named = _registrations(v).withColumn("model_name", catalog.normal_name("model_name"))
    return named.groupBy("model_name", "version", "provider").agg(F.min("seq").alias("pos"))


def _actual(v: Views) -> DataFrame:
    named = _registrations(v).withColumn("model_name", catalog.normal_name("model_name")).where(F.col("size_bytes") % 9 != 0)
    return named.groupBy("model_name", "version", "provider").agg(F.min_by("checksum", "seq").alias("actual_checksum"))


@query("register_versions", "artifacts", f"WITH {_CATALOG} SELECT * FROM cat")
def _(v: Views) -> DataFrame:
    return _catalog(v)


@query("checksums", "artifacts", "SELECT model_name, version, sha256(content) AS sha256, md5(content) AS md5 FROM artifacts")
def _(v: Views) -> DataFrame:
    return v.artifacts.select("model_name", "version", crypto.checksum("content").alias("sha256"), crypto.checksum("content", "md5").alias("md5"))


@query("block_checksums")
def _(v: Views) -> DataFrame:
    """Tree digests of the files of a table, read in ranges; no engine of tables sees the bytes of its files, so tests hold the rule."""
    found = blockdigest.file_checksums(v.spark, f"{v.folder}/lineitem.parquet", block_bytes=1 << 16, range_bytes=1 << 20)
    return found.select(F.substring_index("path", "/", -1).alias("file"), "size", "blocks", "checksum")



@query("latest_version", "artifacts", f"""
WITH {_CATALOG}
SELECT model_name, version, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY registered_at DESC, seq) AS rn FROM cat) WHERE rn = 1""")
def _(v: Views) -> DataFrame:
    return catalog.latest_version(_catalog(v))


@query("list_versions", "artifacts", f"""
WITH {_CATALOG}
SELECT c.model_name, c.version, c.registered_at, c.size_bytes, string_agg(l.provider, ',' ORDER BY l.provider) AS providers
FROM cat c LEFT JOIN loc l ON l.model_name = c.model_name AND l.version = c.version GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    return catalog.list_versions(_catalog(v), _locations(v)).withColumn("providers", F.array_join("providers", ","))


@query("weights_info", "artifacts", f"""
WITH {_CATALOG}
SELECT model_name, version, size_bytes, count(*) OVER (PARTITION BY model_name) AS version_count FROM cat""")
def _(v: Views) -> DataFrame:
    return catalog.weights_info(_catalog(v))


_VERIFIED = """ver AS (SELECT l.model_name, l.version, l.provider, l.pos, coalesce(c.checksum = a.actual_checksum, false) AS verified
  FROM loc l JOIN cat c ON c.model_name = l.model_name AND c.version = l.version
  LEFT JOIN act a ON a.model_name = l.model_name AND a.version = l.version AND a.provider = l.provider)"""


@query("verify_integrity", "artifacts", f"WITH {_CATALOG}, {_VERIFIED} SELECT model_name, version, provider, verified FROM ver")
def _(v: Views) -> DataFrame:
    return catalog.verify_integrity(_locations(v), _catalog(v), _actual(v))


@query("pick_replica", "artifacts", f"""
WITH {_CATALOG}, {_VERIFIED}
SELECT model_name, version, arg_min(provider, pos) FILTER (verified) AS provider, NOT bool_or(verified) AS failed FROM ver GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    return catalog.pick_replica(_locations(v), _catalog(v), _actual(v))


@query("replication_gap", "artifacts", f"""
WITH {_CATALOG}
SELECT model_name, version, provider FROM (SELECT model_name, version, unnest(['en', 'fr']) AS provider FROM cat)
EXCEPT SELECT model_name, version, provider FROM loc""")
def _(v: Views) -> DataFrame:
    return catalog.missing_replicas(_catalog(v), _locations(v), ["en", "fr"])


@query("replication_diff", "artifacts", f"""
WITH {_CATALOG},
e AS (SELECT model_name, version FROM loc WHERE provider = 'en'), f AS (SELECT model_name, version FROM loc WHERE provider = 'fr')
SELECT *, 'copy' AS action FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'delete' FROM (SELECT * FROM f EXCEPT SELECT * FROM e)""")
def _(v: Views) -> DataFrame:
    return catalog.replication_diff(_locations(v), "en", "fr")


_REQUESTS = """req AS (SELECT DISTINCT 'src' || n_nationkey AS model_name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE CAST(n_nationkey AS VARCHAR) END AS version FROM nation)"""


def _requests(v: Views) -> DataFrame:
    n = F.col("n_nationkey")
    return v.nation.select(F.concat(F.lit("Src"), n).alias("model_name"), F.when(n % 2 != 0, n.cast("string")).alias("version"))


@query("delete_versions", "artifacts", f"""
WITH {_CATALOG}, {_REQUESTS}
SELECT model_name, version FROM cat c WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.model_name = c.model_name AND (r.version IS NULL OR r.version = c.version))""")
def _(v: Views) -> DataFrame:
    return catalog.delete_versions(_catalog(v), _requests(v))[0].select("model_name", "version")


@query("delete_report", "artifacts", f"""
WITH {_CATALOG}, {_REQUESTS}
SELECT model_name, version, EXISTS (SELECT 1 FROM cat c WHERE c.model_name = r.model_name AND (r.version IS NULL OR r.version = c.version)) AS found FROM req r""")
def _(v: Views) -> DataFrame:
    return catalog.delete_versions(_catalog(v), _requests(v))[1]


@query("cache_eviction", "", """
WITH r AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY n_chars % 1000, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n_chars) OVER () AS total FROM documents)
SELECT n_chars % 1000 AS atime, doc_id, n_chars FROM r WHERE total > 400000 AND total - before > 0.8 * 400000""")
def _(v: Views) -> DataFrame:
    files = v.documents.select((F.col("n_chars") % 1000).alias("atime"), "doc_id", "n_chars")
    return catalog.cache_eviction(files, ["atime", "doc_id"], "n_chars", 400_000)


@query("storage_status", "artifacts", """
SELECT provider, CAST(grouping(provider) AS BIGINT) AS level, count(DISTINCT model_name) AS models, count(DISTINCT (model_name, version)) AS versions,
  CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  round(sum(size_bytes / 1e9 * CASE provider WHEN 'en' THEN 100.0 WHEN 'fr' THEN 70.0 ELSE 0.0 END), 6) AS cost,
  round(100.0 * sum(size_bytes) / (SELECT sum(size_bytes) FROM artifacts), 4) AS share_pct FROM artifacts GROUP BY ROLLUP (provider)""")
def _(v: Views) -> DataFrame:
    out = catalog.storage_status(v.artifacts, {"en": 100.0, "fr": 70.0})
    return rounded(rounded(out, "share_pct"), "cost", places=6)


@query("compare_versions", "artifacts", f"""
WITH {_CATALOG},
p AS (SELECT model_name, min(version) AS version_a, max(version) AS version_b FROM cat GROUP BY model_name),
s AS (SELECT model_name, version, list(DISTINCT provider) AS providers FROM loc GROUP BY ALL)
SELECT p.model_name, version_a, version_b, b.size_bytes - a.size_bytes AS size_change,
  CAST(abs(date_diff('day', a.registered_at, b.registered_at)) AS INTEGER) AS days_apart,
  array_to_string(list_sort(list_filter(sa.providers, lambda x: list_contains(sb.providers, x))), ',') AS in_both,
  array_to_string(list_sort(list_filter(sa.providers, lambda x: NOT list_contains(sb.providers, x))), ',') AS only_in_a,
  array_to_string(list_sort(list_filter(sb.providers, lambda x: NOT list_contains(sa.providers, x))), ',') AS only_in_b
FROM p JOIN cat a ON a.model_name = p.model_name AND a.version = version_a JOIN cat b ON b.model_name = p.model_name AND b.version = version_b
JOIN s sa ON sa.model_name = p.model_name AND sa.version = version_a JOIN s sb ON sb.model_name = p.model_name AND sb.version = version_b""")
def _(v: Views) -> DataFrame:
    listed = catalog.list_versions(_catalog(v), _locations(v))
    pairs = _catalog(v).groupBy("model_name").agg(F.min("version").alias("version_a"), F.max("version").alias("version_b"))
    return catalog.compare_versions(listed, pairs)


@query("exists_by_prefix", "", """
SELECT 'src' || n_nationkey AS prefix, EXISTS (SELECT 1 FROM documents WHERE starts_with(source || '/' || doc_id, 'src' || n_nationkey)) AS "exists" FROM nation""")
def _(v: Views) -> DataFrame:
    objects = v.documents.select(F.concat_ws("/", "source", "doc_id").alias("name"))
    return catalog.exists_by_prefix(v.nation.select(F.concat(F.lit("src"), "n_nationkey").alias("prefix")), objects)


_KEY = b"fixture signing key"
_INNER = bytes(b ^ 0x36 for b in _KEY.ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in _KEY.ljust(64, b"\0")).hex()


@query("hmac_rows", "", f"""
SELECT doc_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(text)))) AS signature, doc_id % 2 = 0 AS valid FROM documents""")
def _(v: Views) -> DataFrame:
    signed = v.documents.select("doc_id", "text", crypto.hmac_sha256("text", _KEY).alias("signature"))
    seen = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    return signed.select("doc_id", "signature", crypto.hmac_matches(seen, "signature", _KEY).alias("valid"))


@query("encrypt_column", "", "SELECT doc_id, sha256(text) AS plain_hash, true AS hidden, true AS wrong_key_fails FROM documents")
def _(v: Views) -> DataFrame:
    key, other = b"0123456789abcdef", b"fedcba9876543210"
    token = v.documents.select("doc_id", "text", crypto.encrypt_column("text", key).alias("token"))
    return token.select(
        "doc_id", F.sha2(crypto.decrypt_column("token", key), 256).alias("plain_hash"),
        (F.col("token") != F.col("text")).alias("hidden"),
        crypto.decrypt_column("token", other, strict=False).isNull().alias("wrong_key_fails"),
    )
