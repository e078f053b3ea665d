"""Registered queries: sources, features, models, evaluation and pipelines."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.common import with_total
from fleetgauge.operators import evaluation, features, models, networks
from fleetgauge.plans.pipeline import declared_pipeline
from fleetgauge.plans.registry import query
from fleetgauge.plans.traffic_queries import BY_TIME, rounded
from fleetgauge.plans.views import Views
from fleetgauge.sources import loglines, tables

# Sources ---------------------------------------------------------------------------


@query("read_parquet", "", "SELECT * FROM part")
def _(v: Views) -> DataFrame:
    return tables.read_parquet(v.spark, f"{v.folder}/part.parquet")


@query("parse_log_lines", "logs", """
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('milliseconds', ts) END AS ts, CASE WHEN event_id % 9 <> 0 THEN component END AS name,
  CASE WHEN event_id % 9 <> 0 THEN level END AS level, CASE WHEN event_id % 9 <> 0 THEN message END AS message FROM logs""")
def _(v: Views) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("Traceback "), "message")).otherwise(
        F.concat_ws(" - ", stamp, "component", "level", "message")
    )
    return loglines.parse_log_lines(v.logs.select("event_id", line.alias("value"))).drop("value")


@query("parse_metric_lines", "", """
SELECT event_id, date_trunc('milliseconds', ts) AS ts, CASE WHEN user_id % 3 = 0 THEN event_type END AS metric,
  CASE WHEN user_id % 3 = 0 THEN value END AS metric_value, CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 THEN user_id END AS step,
  CASE WHEN user_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END AS depth,
  CASE WHEN user_id % 3 = 2 THEN 'm' || user_id END AS model, CASE WHEN user_id % 3 = 2 THEN 'Forest' END AS model_type FROM events""")
def _(v: Views) -> DataFrame:
    u = F.col("user_id")
    number = F.replace(F.format_number("value", 6), F.lit(","), F.lit(""))
    metric = F.concat("event_type", F.lit("="), number, F.when(u % 2 == 0, F.concat(F.lit(" (step="), u, F.lit(")"))).otherwise(""))
    params = F.concat(F.lit("PARAMETERS: depth="), u, F.lit(", rate=0.1"))
    body = F.when(u % 3 == 0, metric).when(u % 3 == 1, params).otherwise(F.concat(F.lit("MODEL: m"), u, F.lit(" (Forest)")))
    lines = v.events.select("event_id", F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), body).alias("value"))
    out = loglines.parse_metric_lines(lines)
    return out.select("event_id", "ts", "metric", "metric_value", "step", F.col("params")["depth"].alias("depth"), "model", "model_type")


@query("parse_records", "", """
SELECT event_id, a, b, CASE user_id % 5 WHEN 2 THEN 'the body is neither a list nor an object' WHEN 3 THEN 'arrays have different lengths' WHEN 4 THEN 'the body is empty' END AS _error
FROM (SELECT event_id, user_id, unnest(CASE user_id % 5 WHEN 0 THEN [{'a': user_id, 'b': 'x'}, {'a': event_id, 'b': NULL}]
  WHEN 1 THEN [{'a': user_id, 'b': 'y'}, {'a': event_id, 'b': 'z'}] ELSE [{'a': NULL, 'b': NULL}] END, recursive := true) FROM events)""")
def _(v: Views) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    body = (
        F.when(u % 5 == 0, F.concat(F.lit('[{"a": '), u, F.lit(', "b": "x"}, {"a": '), e, F.lit("}]")))
        .when(u % 5 == 1, F.concat(F.lit('{"a": ['), u, F.lit(", "), e, F.lit('], "b": ["y", "z"]}')))
        .when(u % 5 == 2, u.cast("string"))
        .when(u % 5 == 3, F.concat(F.lit('{"a": [1, 2], "b": ["'), e, F.lit('"]}')))
    )
    return tables.parse_records(v.events.select("event_id", body.alias("body")), "body", "a bigint, b string", ["event_id"])


# Features ---------------------------------------------------------------------------

_STATS = """st AS (SELECT avg(price) AS pm, var_pop(price) * count(price) / count(*) AS pv, avg(balance) AS bm, var_pop(balance) AS bv,
  min(balance) AS b0, max(balance) AS b1 FROM features),
mo AS (SELECT segment AS mode FROM features WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)"""
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _hot(column: str, names: list[str], source: str) -> str:
    return ", ".join(f"""CASE WHEN {source} = '{n}' THEN 1.0 ELSE 0.0 END::DOUBLE AS "{column}_{n}\"""" for n in names)


_KINDS = {
    "orders": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
               "o_orderdate": "other", "o_orderpriority": "categorical"},
    "customer": {"c_custkey": "numeric", "c_name": "categorical", "c_nationkey": "numeric", "c_acctbal": "numeric",
                 "c_mktsegment": "categorical"},
}


@query("infer_feature_types", "", " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{k}' AS kind, count({c}) AS known FROM {t}"
    for t, kinds in _KINDS.items() for c, k in kinds.items()
))
def _(v: Views) -> DataFrame:
    """Kind of every column beside how many known values it has; the kind comes from the schema."""
    out = None
    for name in _KINDS:
        df = v.table(name)
        numeric, categorical = features.infer_feature_types(df)
        kinds = {**{c: "numeric" for c in numeric}, **{c: "categorical" for c in categorical}}
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        rows = F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), F.lit(kinds.get(c, "other")).alias("kind"), F.col(c).alias("known"))
            for c in df.columns
        ]))
        one = counts.select(rows)
        out = one if out is None else out.unionByName(one)
    return out


@query("impute_mean", "features", f"""
WITH {_STATS} SELECT row_id, round(coalesce(price, pm), 4) AS price, balance FROM features, st""")
def _(v: Views) -> DataFrame:
    return rounded(features.impute_mean(v.features.select("row_id", "price", "balance"), ["price", "balance"]), "price")


@query("impute_mode", "features", f"""
WITH {_STATS} SELECT row_id, priority, coalesce(segment, mode) AS segment FROM features, mo""")
def _(v: Views) -> DataFrame:
    return features.impute_mode(v.features.select("row_id", "priority", "segment"), ["priority", "segment"])


@query("scale_standard", "features", """
SELECT row_id, round((price - (SELECT avg(price) FROM features)) / (SELECT stddev_pop(price) FROM features), 6) AS price,
  round((balance - (SELECT avg(balance) FROM features)) / (SELECT stddev_pop(balance) FROM features), 6) AS balance, 0.0::DOUBLE AS flat FROM features""")
def _(v: Views) -> DataFrame:
    data = v.features.select("row_id", "price", "balance", F.lit(7.0).alias("flat"))
    return rounded(features.scale(data, ["price", "balance", "flat"], "standard"), "price", "balance", places=6)


@query("scale_minmax", "features", f"""
WITH {_STATS}
SELECT row_id, round((balance - b0) / (b1 - b0), 6) AS balance, 0.0::DOUBLE AS flat FROM features, st""")
def _(v: Views) -> DataFrame:
    data = v.features.select("row_id", "balance", F.lit(7.0).alias("flat"))
    return rounded(features.scale(data, ["balance", "flat"], "minmax"), "balance", places=6)


@query("one_hot", "features", f"""
SELECT row_id, {_hot('priority', _PRIORITIES, 'priority')}, {_hot('segment', _SEGMENTS, 'segment')},
  CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS segment_nan FROM features""")
def _(v: Views) -> DataFrame:
    return features.one_hot(v.features.select("row_id", "priority", "segment"), ["priority", "segment"])


_PREPROCESSED = f"""pp AS (SELECT row_id, round((coalesce(price, pm) - pm) / sqrt(pv), 6) AS price, round((balance - bm) / sqrt(bv), 6) AS balance,
  {_hot('priority', _PRIORITIES, 'priority')}, {_hot('segment', _SEGMENTS, 'coalesce(segment, mode)')} FROM features, st, mo)"""


@query("preprocess", "features", f"WITH {_STATS}, {_PREPROCESSED} SELECT * FROM pp")
def _(v: Views) -> DataFrame:
    out, _ = features.preprocess(v.features, numeric=["price", "balance"], categorical=["priority", "segment"])
    return rounded(out, "price", "balance", places=6)


@query("preprocess_transform", "features", f"""
WITH tr AS (SELECT * FROM features WHERE balance > 0 AND segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')),
st AS (SELECT avg(price) AS pm, var_pop(price) * count(price) / count(*) AS pv, avg(balance) AS bm, var_pop(balance) AS bv FROM tr),
mo AS (SELECT segment AS mode FROM tr GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT row_id, round((coalesce(price, pm) - pm) / sqrt(pv), 6) AS price, round((balance - bm) / sqrt(bv), 6) AS balance,
  {_hot('priority', _PRIORITIES, 'priority')}, {_hot('segment', _SEGMENTS[:3], 'coalesce(segment, mode)')} FROM features, st, mo""")
def _(v: Views) -> DataFrame:
    train = v.features.where((F.col("balance") > 0) & F.col("segment").isin(_SEGMENTS[:3]))
    steps = features.fit(train, ["price", "balance"], ["priority", "segment"])
    return rounded(features.transform(v.features, steps), "price", "balance", places=6)


@query("train_test_split", "features", """
SELECT *, CASE WHEN ('0x' || substr(md5(row_id || ':42'), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS side FROM features""")
def _(v: Views) -> DataFrame:
    train, test = features.train_test_split(v.features, "row_id")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("label_encode", "features", """
SELECT row_id, segment, CASE WHEN segment IS NOT NULL THEN dense_rank() OVER (ORDER BY segment NULLS LAST) - 1 END AS code FROM features""")
def _(v: Views) -> DataFrame:
    return features.label_encode(v.features.select("row_id", "segment"), "segment", "code")


@query("target_encode", "doc_target", """
WITH tr AS (SELECT * FROM doc_target WHERE n_chars > 500), p AS (SELECT avg(label) AS prior FROM tr),
s AS (SELECT lang, sum(label) AS s, count(*) AS n FROM tr GROUP BY lang)
SELECT doc_id, d.lang, round(CASE WHEN n IS NULL THEN prior ELSE (s + 10 * prior) / (n + 10) END, 6) AS encoded
FROM doc_target d CROSS JOIN p LEFT JOIN s ON s.lang = d.lang""")
def _(v: Views) -> DataFrame:
    out = features.target_encode(v.doc_target, F.col("n_chars") > 500, "lang", "label", 10.0, "encoded")
    return rounded(out.select("doc_id", "lang", "encoded"), "encoded", places=6)


# Models ---------------------------------------------------------------------------------


def _doc_frame(v: Views) -> DataFrame:
    """Labelled documents with numeric features."""
    d = v.documents.join(v.labels, "doc_id")
    return d.select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        F.size(F.split("text", " ")).cast("double").alias("words"),
        F.col("quality").cast("double").alias("label"),
    )


_DOC_FEATURES = ["chars", "lines", "words"]


def _metric_rows(v: Views, metrics: dict[str, float]) -> DataFrame:
    return v.spark.createDataFrame([(k, float(x)) for k, x in metrics.items() if k != "train_time_seconds"], "name string, value double")


def _forest(v: Views) -> tuple[models.Trained, DataFrame]:
    train, test = features.train_test_split(_doc_frame(v), "doc_id")
    return models.train_model(train, _DOC_FEATURES, "label", params={"numTrees": 20, "maxDepth": 5}, eval_data=test), test


@query("train_model")
def _(v: Views) -> DataFrame:
    return _metric_rows(v, _forest(v)[0].metrics)


@query("train_regression", "", """
WITH d AS (SELECT c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM d),
w AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb, my, ma, mb FROM m),
e AS (SELECT y, y - (my + wa * (a - ma) + wb * (b - mb)) AS e FROM d, w)
SELECT 'train_mse' AS name, round(avg(e * e) / 1e6, 4) AS value FROM e UNION ALL SELECT 'train_rmse', round(sqrt(avg(e * e)) / 1e6, 4) FROM e
UNION ALL SELECT 'train_mae', round(avg(abs(e)) / 1e6, 4) FROM e UNION ALL SELECT 'train_r2', round((1 - sum(e * e) / (var_pop(y) * count(*))) / 1e6, 4) FROM e""")
def _(v: Views) -> DataFrame:
    data = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), F.col("o_totalprice").alias("label")
    )
    found = _metric_rows(v, models.train_model(data, ["c_acctbal", "nation"], "label", "linear_regression").metrics)
    return rounded(found.withColumn("value", F.col("value") / 1e6), "value")


@query("train_mlp")
def _(v: Views) -> DataFrame:
    wide = v.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), *[
        F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)
    ])
    trained = models.train_mlp(wide, [f"e{i}" for i in range(64)], "label", classes=10, max_iter=20)
    return models.score_batch(trained, wide, ["vec_id", "label"])


@query("train_network", "", """
SELECT round(regr_r2(n_chars, words), 3) AS r2, count(*) AS documents FROM (SELECT n_chars, len(string_split(text, ' ')) AS words FROM documents)""")
def _(v: Views) -> DataFrame:
    """A network without hidden layers is a linear model: what its steps find explains as much as the closed solution."""
    docs = v.documents.select("n_chars", F.size(F.split("text", " ", -1)).alias("words"))
    trained = networks.train_network(docs, ["words"], "n_chars", hidden=(), dropout=0.0, learning_rate=0.2, max_iter=60)
    scored = networks.predict(trained, docs, ["n_chars"])
    found = evaluation.regression_metrics(scored.withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "prediction")
    return found.select(F.round("r2", 3).alias("r2"), F.lit(docs.count()).alias("documents"))


@query("cross_validate")
def _(v: Views) -> DataFrame:
    scores = models.cross_validate(_doc_frame(v), _DOC_FEATURES, "label", "random_forest_classifier", "doc_id", folds=5, params={"numTrees": 5, "maxDepth": 3})
    return _metric_rows(v, scores)


@query("fold_column", "", """
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def _(v: Views) -> DataFrame:
    return models.fold_column(v.labels.select("doc_id", "quality"), "quality", "doc_id", 5)


_TEST_ROWS = """SELECT l.doc_id, CAST(quality AS DOUBLE) AS label, {} FROM labels l JOIN documents d ON d.doc_id = l.doc_id
WHERE ('0x' || substr(md5(l.doc_id || ':42'), 1, 8))::BIGINT / 4294967296.0 < 0.2"""


@query("score_batch", "", _TEST_ROWS.format("true AS known_class"))
def _(v: Views) -> DataFrame:
    """Every row of the test part is scored, once, with a class that was learned; which one depends on random draws."""
    trained, test = _forest(v)
    scored = models.score_batch(trained, test, ["doc_id", "label"])
    return scored.select("doc_id", "label", F.col("prediction").isin(0.0, 1.0).alias("known_class"))


@query("score_proba", "", _TEST_ROWS.format("CAST(2 AS BIGINT) AS classes, CAST(1.0 AS DOUBLE) AS total, true AS most_likely"))
def _(v: Views) -> DataFrame:
    """Probabilities of both classes that add up to one, and the prediction is the likelier."""
    trained, test = _forest(v)
    p = F.col("probability")
    likely = F.get(p, F.col("prediction").cast("int")) == F.array_max(p)
    total = F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 9)
    return models.score_proba(trained, test, ["doc_id", "label"]).select(
        "doc_id", "label", F.size(p).cast("bigint").alias("classes"), total.alias("total"), likely.alias("most_likely")
    )


@query("encode_wide", "", """
WITH s AS (SELECT list(source ORDER BY source) AS names FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT doc_id, list_transform(names, lambda x: CASE WHEN x = source THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS source_vector FROM documents, s""")
def _(v: Views) -> DataFrame:
    out, _ = features.encode_wide(v.documents.select("doc_id", "source"), ["source"])
    return out.select("doc_id", vector_to_array("source_vector").alias("source_vector"))


# Evaluation ----------------------------------------------------------------------------------


@query("infer_task", "", """
SELECT count(DISTINCT label) AS classes, 0::BIGINT AS fractions, CASE WHEN count(DISTINCT label) = 2 THEN 'binary'
  WHEN count(DISTINCT label) < 10 THEN 'multiclass' ELSE 'regression' END AS task FROM embeddings
UNION ALL SELECT count(DISTINCT quality), 0, CASE WHEN count(DISTINCT quality) = 2 THEN 'binary' ELSE 'multiclass' END FROM labels
UNION ALL SELECT count(DISTINCT CASE WHEN value = floor(value) THEN value END), count(*) FILTER (value <> floor(value)), 'regression' FROM events""")
def _(v: Views) -> DataFrame:
    parts = [evaluation.infer_task(v.table(t), c) for t, c in (("embeddings", "label"), ("labels", "quality"), ("events", "value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SCORES = """cs AS (SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS prediction FROM embeddings)"""
_WEIGHTED = """c AS (SELECT label AS k FROM x UNION SELECT prediction FROM x),
r AS (SELECT k, count(*) FILTER (label = k) AS n, count(*) FILTER (prediction = k) AS p, count(*) FILTER (label = k AND prediction = k) AS h FROM c, x GROUP BY k),
s AS (SELECT *, coalesce(h / nullif(p, 0), 0) AS pr, coalesce(h / nullif(n, 0), 0) AS re FROM r)
SELECT round(sum(h) / sum(n), 6) AS accuracy, round(sum(pr * n) / sum(n), 6) AS precision, round(sum(re * n) / sum(n), 6) AS recall,
  round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * n) / sum(n), 6) AS f1 FROM s"""
_SCORE_NAMES = ("accuracy", "precision", "recall", "f1")


def _class_scores(v: Views) -> DataFrame:
    return v.embeddings.select(
        "vec_id", F.col("label").cast("bigint").alias("label"), evaluation.argmax_class("embedding").alias("prediction")
    )


@query("argmax_class", "", f"WITH {_SCORES} SELECT vec_id, CAST(label AS BIGINT) AS label, prediction FROM cs")
def _(v: Views) -> DataFrame:
    return _class_scores(v)


@query("classification_metrics", "", f"WITH {_SCORES}, x AS (SELECT * FROM cs), {_WEIGHTED}")
def _(v: Views) -> DataFrame:
    return rounded(evaluation.classification_metrics(_class_scores(v), "label", "prediction"), *_SCORE_NAMES, places=6)


@query("binary_metrics", "doc_target", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (label = 1 AND n_chars > 2000) AS tp, count(*) FILTER (label <> 1 AND n_chars > 2000) AS fp,
  count(*) FILTER (label = 1 AND n_chars <= 2000) AS fn FROM doc_target)
SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(v: Views) -> DataFrame:
    scored = v.doc_target.withColumn("score", F.col("n_chars") / (F.col("n_chars") + 2000))
    return rounded(evaluation.binary_metrics(scored, "label", "score"), *_SCORE_NAMES, places=6)


@query("regression_metrics", "", """
WITH x AS (SELECT o_totalprice / 1000 AS y, o_totalprice / 1000 - c_acctbal / 20 AS e FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
  round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM x""")
def _(v: Views) -> DataFrame:
    data = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("o_totalprice") / 1000).alias("y"), (F.col("c_acctbal") / 20).alias("prediction")
    )
    return rounded(rounded(evaluation.regression_metrics(data, "y", "prediction"), "mse", "rmse", "mae"), "r2", places=6)


@query("metric_log", "calls", """
SELECT model, provider AS name, arg_max(latency_ms, call_id) AS value FROM calls GROUP BY model, provider""")
def _(v: Views) -> DataFrame:
    log = v.calls.select("model", F.col("provider").alias("name"), F.col("latency_ms").alias("value"), *BY_TIME)
    return evaluation.latest_metrics(log, ["model"], BY_TIME)


# Pipelines ------------------------------------------------------------------------------------


def _load(views: Views) -> DataFrame:
    return views.features.withColumn("price", F.col("price") / 1e5)


def _prepare(load: DataFrame) -> DataFrame:
    whole = features.impute_mean(load, ["price"])
    return features.preprocess(whole, numeric=["balance"], categorical=["priority", "segment"], scaling="standard")[0]


def _fit(prepare: DataFrame) -> models.Trained:
    return models.train_model(prepare, ["balance"], "price", "linear_regression")


def _score(fit: models.Trained, prepare: DataFrame) -> DataFrame:
    return models.score_batch(fit, prepare, ["row_id", "price"])


def _evaluate(score: DataFrame) -> DataFrame:
    return evaluation.regression_metrics(score, "price", "prediction")


_FLOWS = {"price": ["load", "prepare", "fit", "score", "evaluate"]}
_FUNCTIONS = {"load": _load, "prepare": _prepare, "fit": _fit, "score": _score, "evaluate": _evaluate}


@query("evaluate_steps", "features", f"""
WITH {_STATS},
d AS (SELECT coalesce(price, pm) / 1e5 AS y, balance AS x FROM features, st),
w AS (SELECT covar_pop(y, x) / var_pop(x) AS b, avg(y) AS my, avg(x) AS mx FROM d),
e AS (SELECT y, y - (my + b * (x - mx)) AS e FROM d, w)
SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
  round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e""")
def _(v: Views) -> DataFrame:
    """A declared pipeline: load, preprocess, fit, score, evaluate."""
    flow = declared_pipeline("price", _FLOWS, _FUNCTIONS)
    return rounded(flow.run({"views": v})["evaluate"], "mse", "rmse", "mae", "r2", places=6)


@query("pipeline_manifest", "", """
SELECT 'price' AS name, ['load', 'prepare', 'fit', 'score', 'evaluate'] AS steps, 5.0::DOUBLE AS steps_count, count(*) AS scored FROM orders""")
def _(v: Views) -> DataFrame:
    """What a run leaves behind: its name, steps and their number, beside the rows it scored."""
    flow = declared_pipeline("price", _FLOWS, _FUNCTIONS)
    scored = flow.run({"views": v})["score"].agg(F.count("*").alias("scored"))
    return with_total(flow.manifest(v.spark).select("name", "steps", F.col("metrics")["steps_count"].alias("steps_count")), scored)


@query("feature_state", "features", f"""
WITH {_STATS}
SELECT 0 AS step, 'impute_mean' AS kind, 'price' AS column, round(pm, 4) AS value, []::VARCHAR[] AS categories FROM st
UNION ALL SELECT 1, 'impute_mode', 'segment', NULL, [mode] FROM mo
UNION ALL SELECT 2, 'one_hot', 'segment', NULL, list(segment ORDER BY segment) FROM (SELECT DISTINCT segment FROM features WHERE segment IS NOT NULL)""")
def _(v: Views) -> DataFrame:
    """Fitted steps as the table in which they are stored."""
    steps = features.fit(v.features, ["price"], ["segment"], scaling=None)
    table = features.state_table(v.spark, steps)
    return table.select("step", "kind", "column", F.round(F.col("params")["value"], 4).alias("value"), "categories")
