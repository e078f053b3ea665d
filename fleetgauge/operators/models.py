"""Training, scoring and storing models, on MLlib."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, plan_chunks, prefix
from fleetgauge.operators import evaluation

_FOREST = {"numTrees": 100, "maxDepth": 10}
_BOOST = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "subsamplingRate": 0.8}

# name -> (task, estimator, default parameters)
ESTIMATORS = {
    "random_forest_classifier": ("classification", RandomForestClassifier, _FOREST),
    "random_forest_regressor": ("regression", RandomForestRegressor, _FOREST),
    "gradient_boosting_classifier": ("classification", GBTClassifier, _BOOST),
    "gradient_boosting_regressor": ("regression", GBTRegressor, _BOOST),
    "logistic_regression": ("classification", LogisticRegression, {}),
    "linear_regression": ("regression", LinearRegression, {}),
    "mlp_classifier": ("classification", MultilayerPerceptronClassifier, {}),
}


@dataclass
class Trained:
    """A fitted pipeline with its metadata."""

    name: str
    kind: str
    features: list[str]
    label: str
    model: PipelineModel
    params: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    created_at: str = ""

    @property
    def task(self) -> str:
        return ESTIMATORS[self.kind][0]


def _estimator(kind: str, features: list[str], label: str, params: dict, seed: int):
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model type: {kind}")
    _, cls, defaults = ESTIMATORS[kind]
    options = {**defaults, **params}
    est = cls(featuresCol="features", labelCol=label, predictionCol="prediction", **options)
    if est.hasParam("seed"):
        est = est.setParams(seed=seed) if "seed" not in options else est
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), est])


def evaluate(df: DataFrame, task: str, label: str) -> dict[str, float]:
    """Metrics of a scored frame as a dict; one small aggregate reaches the driver."""
    fn = evaluation.classification_metrics if task == "classification" else evaluation.regression_metrics
    row = fn(df.withColumn(label, F.col(label).cast("double")), label, "prediction").first()
    return row.asDict()


def train_model(
    df: DataFrame, features: list[str], label: str, kind: str = "random_forest_classifier", name: str = "model",
    eval_data: DataFrame | None = None, params: dict | None = None, cv: int | None = None, key: str | None = None, seed: int = 42,
    test_data: DataFrame | None = None,
) -> Trained:
    """Fit and evaluate: train_* metrics, val_* on `eval_data`, test_* on `test_data`, cv_* with `cv` folds (needs a row `key`)."""
    task = ESTIMATORS[kind][0] if kind in ESTIMATORS else None
    pipeline = _estimator(kind, features, label, params or {}, seed)
    started = time.monotonic()
    # The learner and the metrics read the training columns many times.
    data = df.select(*features, label).persist()
    model = pipeline.fit(data)
    metrics = {"train_time_seconds": time.monotonic() - started}
    metrics |= {f"train_{k}": v for k, v in evaluate(model.transform(data), task, label).items()}
    data.unpersist()
    if eval_data is not None:
        metrics |= {f"val_{k}": v for k, v in evaluate(model.transform(eval_data), task, label).items()}
    if test_data is not None:
        metrics |= {f"test_{k}": v for k, v in evaluate(model.transform(test_data), task, label).items()}
    if cv:
        scores = cross_validate(df, features, label, kind, key, cv, params, seed)
        metrics |= {f"cv_{k}": v for k, v in scores.items()}
    return Trained(
        name, kind, features, label, model, {k: str(v) for k, v in (params or {}).items()}, metrics,
        datetime.now(timezone.utc).isoformat(),
    )


def train_mlp(
    df: DataFrame, features: list[str], label: str, classes: int, hidden: tuple[int, ...] = (64, 32),
    max_iter: int = 100, seed: int = 42, **options,
) -> Trained:
    """Multilayer perceptron classifier with sigmoid layers and a softmax output.

    A regression output, dropout and the choice of activation have no counterpart
    in MLlib and are not offered.
    """
    params = {"layers": [len(features), *hidden, classes], "maxIter": max_iter, "blockSize": 128}
    return train_model(df, features, label, "mlp_classifier", params=params, seed=seed, **options)


FOLDS_AT_A_TIME = 4


def fold_column(df: DataFrame, label: str, key: str, folds: int, chunks: Chunks | None = None) -> DataFrame:
    """Add `fold`: rows of each label take turns in the order of the key."""
    ranked = prefix(df, [label], [key], chunks or plan_chunks(df, key), {"__rank": ("sum", F.lit(1).cast("bigint"))})
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")).drop("__rank")


def cross_validate(
    df: DataFrame, features: list[str], label: str, kind: str, key: str, folds: int = 5, params: dict | None = None, seed: int = 42
) -> dict[str, float]:
    """Mean and population standard deviation of the fold scores (accuracy or r2)."""
    task = ESTIMATORS[kind][0]
    df = df.select(key, *features, label)
    if task == "classification":
        folded = fold_column(df, label, key, folds)
    else:
        folded = df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))
    pipeline = _estimator(kind, features, label, params or {}, seed)
    folded = folded.drop(key).persist()

    def score(i: int) -> float:
        model = pipeline.fit(folded.where(F.col("fold") != i))
        held_out = evaluate(model.transform(folded.where(F.col("fold") == i)), task, label)
        return held_out["accuracy" if task == "classification" else "r2"]

    # Folds don't depend on one another: a few run side by side over the same persisted rows.
    with ThreadPoolExecutor(min(folds, FOLDS_AT_A_TIME)) as pool:
        scores = list(pool.map(inheritable_thread_target(df.sparkSession)(score), range(folds)))
    folded.unpersist()
    return {"mean": statistics.fmean(scores), "std": statistics.pstdev(scores)}


def score_batch(trained: Trained, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions beside the kept columns, one row per input row."""
    return trained.model.transform(df).select(*keep, "prediction")


def score_proba(trained: Trained, df: DataFrame, keep: list[str]) -> DataFrame:
    """Class probabilities as an array; an error for models without them."""
    scored = trained.model.transform(df)
    if "probability" not in scored.columns:
        raise ValueError(f"{trained.kind} gives no probabilities")
    return scored.select(*keep, "prediction", vector_to_array("probability").alias("probability"))


def score_custom(df: DataFrame, load: Callable[[], object], predict: Callable[[object, pd.DataFrame], pd.Series], keep: list[str], features: list[str]) -> DataFrame:
    """Score with any Python model, loaded once per task and called once per Arrow batch."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", prediction double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch[keep].assign(prediction=predict(model, batch[features]))

    return df.select(*dict.fromkeys([*keep, *features])).mapInPandas(run, schema)


METADATA_SCHEMA = (
    "name string, kind string, features array<string>, label string, created_at string, "
    "params map<string,string>, metrics map<string,double>"
)


def save_model(trained: Trained, path: str) -> None:
    """Write the pipeline and a one-row metadata table below `path`."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    row = (trained.name, trained.kind, trained.features, trained.label, trained.created_at, trained.params, trained.metrics)
    spark.createDataFrame([row], METADATA_SCHEMA).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> Trained:
    """Read a stored model; a missing one is an error."""
    row = spark.read.schema(METADATA_SCHEMA).json(f"{path}/metadata").first()
    model = PipelineModel.load(f"{path}/pipeline")
    return Trained(
        row["name"], row["kind"], list(row["features"]), row["label"], model, dict(row["params"]), dict(row["metrics"]), row["created_at"]
    )
