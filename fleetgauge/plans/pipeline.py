"""Pipelines of user steps over lazy DataFrames."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fleetgauge.sources import sinks

StepFunction = Callable[..., Any]


class PipelineError(RuntimeError):
    """A step failed; the message names it."""


class Pipeline:
    """Steps run in order; each sees what its signature asks for from the results so far."""

    def __init__(self, name: str):
        self.name = name
        self.created_at = datetime.now(timezone.utc)
        self.steps: list[tuple[str, StepFunction, dict[str, Any]]] = []
        self.metrics: dict[str, float] = {}
        self.results: dict[str, Any] = {}

    def add_step(self, name: str, fn: StepFunction, **kwargs: Any) -> Pipeline:
        self.steps.append((name, fn, kwargs))
        return self

    def run(self, inputs: dict[str, Any] | None = None) -> dict[str, Any]:
        """Run all steps. A dict result is merged, any other result is stored under the step name.

        Steps only build plans, so nothing but fits and writes inside a step takes time here.
        """
        context = dict(inputs or {})
        started = time.monotonic()
        for name, fn, kwargs in self.steps:
            step_started = time.monotonic()
            try:
                result = fn(**_arguments(fn, {**context, **kwargs}))
            except Exception as e:
                raise PipelineError(f"step {name} failed: {e}") from e
            context.update(result if isinstance(result, dict) else {name: result})
            self.metrics[f"{name}_time"] = time.monotonic() - step_started
        self.metrics["total_time"] = time.monotonic() - started
        self.metrics["steps_count"] = float(len(self.steps))
        self.results = context
        return context

    def manifest(self, spark: SparkSession) -> DataFrame:
        """One row: name, creation time, steps and metrics."""
        row = (self.name, self.created_at.isoformat(), [s[0] for s in self.steps], self.metrics)
        return spark.createDataFrame([row], "name string, created_at string, steps array<string>, metrics map<string,double>")

    def save_results(self, spark: SparkSession, folder: str) -> None:
        """Frames to parquet, arrays to npy, scalars into the manifest, a type name for the rest."""
        entries: dict[str, str] = {}
        for name, value in self.results.items():
            if isinstance(value, DataFrame):
                sinks.write_parquet(value, f"{folder}/{name}.parquet")
                entries[name] = f"{name}.parquet"
            elif isinstance(value, np.ndarray):
                sinks.write_npy(value, f"{folder}/{name}.npy")
                entries[name] = f"{name}.npy"
            elif value is None or isinstance(value, (str, int, float, bool)):
                entries[name] = str(value)
            else:
                entries[name] = type(value).__name__
        rows = [(self.name, self.created_at.isoformat(), [s[0] for s in self.steps], self.metrics, entries)]
        schema = "name string, created_at string, steps array<string>, metrics map<string,double>, results map<string,string>"
        spark.createDataFrame(rows, schema).write.mode("overwrite").json(f"{folder}/manifest.json")


def _arguments(fn: StepFunction, known: dict[str, Any]) -> dict[str, Any]:
    params = inspect.signature(fn).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in params.values()):
        return known
    return {k: v for k, v in known.items() if k in params}


def declared_pipeline(name: str, config: dict[str, list[str]], registry: dict[str, StepFunction]) -> Pipeline:
    """Build a pipeline from a list of step names; an unknown pipeline or step is an error."""
    if name not in config:
        raise KeyError(f"unknown pipeline: {name}")
    out = Pipeline(name)
    for step in config[name]:
        if step not in registry:
            raise KeyError(f"unknown step: {step}")
        out.add_step(step, registry[step])
    return out
