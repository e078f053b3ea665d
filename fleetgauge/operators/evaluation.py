"""Scores of predictions and the log of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.common import count_if, ratio

MAX_CLASSES = 10


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """One row: distinct whole values and the task (binary, multiclass or regression).

    A classifier needs fewer than ten distinct values, all whole numbers. Only
    whole values are counted, so a continuous target shuffles next to nothing.
    """
    y = F.col(target).cast("double")
    whole = y == F.floor(y)
    out = df.agg(F.count_distinct(F.when(whole, y)).alias("classes"), count_if(~whole).alias("fractions"))
    few = (F.col("fractions") == 0) & (F.col("classes") < MAX_CLASSES)
    task = F.when(few & (F.col("classes") == 2), "binary").when(few, "multiclass").otherwise("regression")
    return out.select("classes", "fractions", task.alias("task"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support, predictions and hits per class; classes are those seen as label or prediction."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.inline(F.array(
        F.struct(F.col("l").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero).alias("hits")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    ))
    return pairs.select(sides).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0/0 counts as 0."""
    precision, recall = ratio("hits", "predicted"), ratio("hits", "support")
    f1 = ratio(2 * precision * recall, precision + recall)
    weighted = [F.sum(m * F.col("support")).alias(n) for n, m in (("p", precision), ("r", recall), ("f", f1))]
    total = class_report(df, label, prediction).agg(F.sum("hits").alias("h"), F.sum("support").alias("n"), *weighted)
    return total.select(
        ratio("h", "n").alias("accuracy"), ratio("p", "n").alias("precision"), ratio("r", "n").alias("recall"), ratio("f", "n").alias("f1")
    )


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 with `score > threshold` as the prediction."""
    y, hit = F.col(label) == 1, F.col(score) > threshold
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), count_if(y & hit).alias("tp"), count_if(~y & hit).alias("fp"),
        count_if(y & ~hit).alias("fn"), count_if(~y & ~hit).alias("tn"),
    )
    return counts.select(
        ratio(F.col("tp") + F.col("tn"), "n").alias("accuracy"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def argmax_class(scores: str | Column) -> Column:
    """Zero-based index of the largest score, the first on ties."""
    v = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean squared error, its root, mean absolute error and r2 from one aggregate."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    sums = df.agg(F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), (F.var_pop(y) * F.count(y)).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst"))).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    mse = ratio("sse", "n")
    return sums.select(mse.alias("mse"), F.sqrt(mse).alias("rmse"), ratio("sae", "n").alias("mae"), r2.alias("r2"))


def latest_metrics(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last logged value of each metric name from an append-only log (name, value)."""
    return log.groupBy(*keys, "name").agg(F.max_by("value", F.struct(*order)).alias("value"))
