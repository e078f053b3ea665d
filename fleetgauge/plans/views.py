"""Domain views over the driver tables.

Each view is one SQL text that Spark and the checking engine both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge import ship

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "calls": """
SELECT event_id AS call_id, ts, user_id,
  CASE WHEN user_id % 3 = 0 THEN 'aws' WHEN user_id % 3 = 1 THEN 'gcp' ELSE 'azure' END AS provider,
  concat('/models/m', cast(user_id % 5 AS varchar(10)), '/predict') AS endpoint,
  concat('m', cast(user_id % 5 AS varchar(10))) AS model,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN user_id % 2 = 0 THEN 'premium' ELSE 'free' END AS tier,
  event_type, length(props) AS request_bytes, value AS latency_ms
FROM events""",
    "node_metrics": """
SELECT user_id % 8 AS node, date_trunc('hour', ts) AS ts,
  least(100.0, avg(value)) AS gpu_utilization, count(*) AS queue_length
FROM events GROUP BY user_id % 8, date_trunc('hour', ts)""",
    "fleet": """
SELECT ts, concat('p', cast(node % 3 AS varchar(10))) AS provider, count(*) * 2 AS gpu_node_count,
  round(avg(util), 6) AS gpu_utilization, cast(sum(calls) * 4 AS bigint) AS queue_length,
  cast(floor(max(util) * 15) AS bigint) AS latency_p95, round(sum(util) * 0.7, 6) AS cost_per_hour
FROM (SELECT user_id % 8 AS node, date_trunc('hour', ts) AS ts, least(100.0, avg(value) * 1.4) AS util, count(*) AS calls
  FROM events GROUP BY user_id % 8, date_trunc('hour', ts)) n
GROUP BY ts, node % 3""",
    "cost_items": """
SELECT l.l_shipdate AS ts, r.r_name AS provider, p.p_type AS service, p.p_brand AS model,
  l.l_extendedprice * (1 - l.l_discount) AS amount
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey""",
    "artifacts": """
SELECT lower(replace(source, ' ', '_')) AS model_name, doc_id AS version,
  lang AS provider, n_chars AS size_bytes, text AS content FROM documents""",
    "spans": """
SELECT conv_id AS trace_id, turn AS span_id,
  CASE WHEN turn = 0 THEN NULL ELSE turn - 1 END AS parent_id,
  role AS service, length(text) AS duration FROM conversations""",
    "features": """
SELECT o.o_orderkey AS row_id,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_totalprice END AS price,
  c.c_acctbal AS balance, o.o_orderpriority AS priority,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS segment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "doc_target": """
SELECT d.doc_id, d.lang, d.n_chars, l.quality AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "logs": """
SELECT event_id, ts,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'model' END AS component, props AS message
FROM events""",
}


class Views:
    """Lazy access to tables and domain views of one folder: `v.calls`, `v.events`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        # Event times carry no zone; all conversions to instants are made in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL that may name any table; tables are bound as arguments, not as global views."""
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        used = [t for t in TABLES if t in words]
        for t in used:
            text = _bind(text, t)
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def _bind(text: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table} ", f"{word} {{{table}}} ")
        text = text.replace(f"{word} {table}\n", f"{word} {{{table}}}\n")
        if text.endswith(f"{word} {table}"):
            text = text[: -len(table)] + f"{{{table}}}"
    return text
