"""Small neural networks for regression and classification, trained by gradients summed over tasks.

The network lives on the driver and goes to the tasks with each step. A task adds up loss and gradient over its
rows, batch by batch; the tasks' sums are added in two levels, so neither the driver nor a task holds more
than the square root of the number of tasks of them. Steps are Adam on the gradient of all rows.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.operators.models import evaluate

ACTIVATIONS = ("relu", "tanh", "sigmoid")
#: Rows of a batch; bounds the memory of a task's layers.
BATCH_ROWS = 4096


def _active(z: np.ndarray, kind: str) -> np.ndarray:
    return np.maximum(z, 0) if kind == "relu" else np.tanh(z) if kind == "tanh" else 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _slope(a: np.ndarray, kind: str) -> np.ndarray:
    """Derivative of the activation by its value."""
    return (a > 0).astype(float) if kind == "relu" else 1 - a * a if kind == "tanh" else a * (1 - a)


@dataclass(frozen=True)
class Network:
    """Layers as (weights, offsets); hidden ones are followed by the activation, the last by nothing (regression) or softmax."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    activation: str = "relu"
    classes: int = 0  # 0: regression

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for layer in self.layers for p in layer])

    def with_flat(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for w, b in self.layers:
            out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(tuple(out), self.activation, self.classes)

    def outputs(self, x: np.ndarray, dropout: float = 0.0, draw: np.random.Generator | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Outputs, the inputs of each layer, and the masks of hidden layers, scaled so that means stay."""
        inputs, masks = [x], []
        for i, (w, b) in enumerate(self.layers):
            z = inputs[-1] @ w + b
            if i == len(self.layers) - 1:
                return z, inputs, masks
            a = _active(z, self.activation)
            masks.append(np.ones(1) if not dropout else (draw.random(a.shape) >= dropout) / (1 - dropout))
            inputs.append(a * masks[-1])
        raise ValueError("a network needs a layer")

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss(self, x: np.ndarray, y: np.ndarray, dropout: float = 0.0, draw: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Sum of half squared errors, or of cross entropies, over the rows, and its gradient in the order of `flat`."""
        z, inputs, masks = self.outputs(x, dropout, draw)
        if self.classes:
            p = self.probabilities(z)
            rows = np.arange(len(y))
            loss = -np.log(np.maximum(p[rows, y.astype(int)], 1e-300)).sum()
            error = p
            error[rows, y.astype(int)] -= 1
        else:
            error = z - y[:, None]
            loss = 0.5 * (error**2).sum()
        parts: list[np.ndarray] = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts = [(inputs[i].T @ error).reshape(-1), error.sum(axis=0), *parts]
            if i:
                # inputs[i] is the activation times its mask, so the mask comes off for the slope.
                mask = masks[i - 1]
                a = np.divide(inputs[i], mask, out=np.zeros_like(inputs[i]), where=mask > 0)
                error = (error @ self.layers[i][0].T) * mask * _slope(a, self.activation)
        return float(loss), np.concatenate(parts)


@dataclass
class TrainedNetwork:
    """A network, the scaling of its inputs and output, and the metrics of its training rows."""

    network: Network
    features: list[str]
    shift: np.ndarray
    scale: np.ndarray
    label_shift: float = 0.0
    label_scale: float = 1.0
    metrics: dict[str, float] = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        own = self.network
        return json.dumps({
            "layers": [[w.tolist(), b.tolist()] for w, b in own.layers], "activation": own.activation, "classes": own.classes, "features": self.features,
            "shift": self.shift.tolist(), "scale": self.scale.tolist(), "label_shift": self.label_shift, "label_scale": self.label_scale, "metrics": self.metrics,
        })

    @staticmethod
    def from_json(text: str) -> TrainedNetwork:
        d = json.loads(text)
        layers = tuple((np.array(w, float), np.array(b, float)) for w, b in d["layers"])
        return TrainedNetwork(
            Network(layers, d["activation"], d["classes"]), d["features"], np.array(d["shift"]), np.array(d["scale"]), d["label_shift"], d["label_scale"], d["metrics"]
        )


def initial(sizes: list[int], activation: str, classes: int, seed: int) -> Network:
    draw = np.random.default_rng(seed)
    gain = 2.0 if activation == "relu" else 1.0
    return Network(tuple((draw.normal(0, math.sqrt(gain / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])), activation, classes)


def _matrix(batch: pa.RecordBatch, count: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(count)]) if count else np.zeros((batch.num_rows, 0))


def gradient_sums(data: DataFrame, network: Network, width: int, dropout: float = 0.0, seed: int = 0) -> tuple[float, int, np.ndarray]:
    """Loss, rows and gradient over all rows of `data` (the inputs, then the label, all doubles)."""
    sent = data.sparkSession.sparkContext.broadcast(network)
    schema = "slot int, task int, loss double, n bigint, gradient binary"
    groups = max(1, math.isqrt(data.rdd.getNumPartitions()))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = sent.value, TaskContext.get().partitionId()
        draw = np.random.default_rng([seed, task])
        loss, n, total = 0.0, 0, np.zeros(own.flat().size)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                one, gradient = own.loss(_matrix(part, width), part.column(width).to_numpy(zero_copy_only=False), dropout, draw)
                loss, n, total = loss + one, n + part.num_rows, total + gradient
        yield row(task % groups, task, loss, n, total)

    def row(slot: int, task: int, loss: float, n: int, total: np.ndarray) -> pa.RecordBatch:
        values = [pa.array([slot], pa.int32()), pa.array([task], pa.int32()), pa.array([loss]), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["slot", "task", "loss", "n", "gradient"])

    def added(rows: list[dict]) -> tuple[float, int, np.ndarray]:
        rows = sorted(rows, key=lambda r: r["task"])  # sums don't depend on the order of arrival
        return sum(r["loss"] for r in rows), sum(r["n"] for r in rows), np.sum([np.frombuffer(r["gradient"]) for r in rows], axis=0)

    def per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        by_slot: dict[int, list[dict]] = {}
        for r in rows:
            by_slot.setdefault(r["slot"], []).append(r)
        for slot, own in by_slot.items():
            yield row(slot, slot, *added(own))

    sums = data.mapInArrow(per_task, schema)
    if groups > 1:
        sums = sums.repartition(groups, "slot").mapInArrow(per_group, schema)
    loss, n, total = added([r.asDict() for r in sums.collect()])
    sent.unpersist()
    return loss, n, total


def train_network(
    df: DataFrame, features: list[str], label: str, classes: int = 0, hidden: tuple[int, ...] = (64, 32), activation: str = "relu",
    dropout: float = 0.2, learning_rate: float = 0.01, max_iter: int = 100, tolerance: float = 0.0, seed: int = 42,
    eval_data: DataFrame | None = None,
) -> TrainedNetwork:
    """Fit a network: regression with classes=0, else a softmax over labels 0 to classes - 1.

    Inputs (and the label of a regression) are standardised with the mean and deviation of the rows. `dropout` leaves out that
    share of the hidden values while training. Training stops after `max_iter` passes, or when the mean loss changes by less than
    `tolerance`. Rows with a null in a feature or the label are left out; without any row it is an error.
    """
    if activation not in ACTIVATIONS:
        raise ValueError(f"activation must be one of {', '.join(ACTIVATIONS)}")
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    started = time.monotonic()
    names = [*[F.col(f"`{f}`") for f in features], F.col(f"`{label}`")]
    plain = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(names)]).na.drop()
    stats = plain.agg(*[fn(f"x{i}").alias(f"{k}{i}") for i in range(len(names)) for k, fn in (("mean", F.avg), ("std", F.stddev_pop))], F.count("*").alias("n")).first()
    if not stats["n"]:
        raise ValueError("there are no rows to train on")
    width = len(features)
    shift = np.array([stats[f"mean{i}"] for i in range(width)])
    scale = np.array([stats[f"std{i}"] or 1.0 for i in range(width)])
    mean, spread = (0.0, 1.0) if classes else (stats[f"mean{width}"], stats[f"std{width}"] or 1.0)
    scaled = [(F.col(f"x{i}") - float(shift[i])) / float(scale[i]) for i in range(width)] + [(F.col(f"x{width}") - mean) / spread]
    data = plain.select(*[c.alias(f"x{i}") for i, c in enumerate(scaled)]).persist()
    network = initial([width, *hidden, classes or 1], activation, classes, seed)
    at, first, second, losses = network.flat(), 0.0, 0.0, []
    for step in range(1, max_iter + 1):
        loss, n, gradient = gradient_sums(data, network.with_flat(at), width, dropout, seed * 1_000_003 + step)
        losses.append(loss / n)
        gradient = gradient / n
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        rate = learning_rate * (1 - (step - 1) / max_iter)  # smaller towards the end, to come to rest
        at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step > 1 and abs(losses[-1] - losses[-2]) < tolerance:
            break
    data.unpersist()
    out = TrainedNetwork(network.with_flat(at), list(features), shift, scale, mean, spread, losses=losses)
    out.metrics["train_time_seconds"] = time.monotonic() - started
    task = "classification" if classes else "regression"
    for prefix, rows in (("train", df), ("val", eval_data)):
        if rows is not None:
            scored = predict(out, rows.where(F.col(f"`{label}`").isNotNull()), [label]).where("prediction is not null")
            out.metrics |= {f"{prefix}_{k}": v for k, v in evaluate(scored, task, label).items()}
    return out


def predict(trained: TrainedNetwork, df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and prediction of every row; with classes also their probabilities. A null feature gives a null prediction."""
    width, own = len(trained.features), trained.network
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{f}`").cast("double") for f in trained.features])
    added = T.StructType().add("prediction", T.DoubleType())
    if own.classes:
        added.add("probability", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*source.schema.fields[: len(keep)], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                x = np.column_stack([part.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(width)]) if width else np.zeros((part.num_rows, 0))
                known = ~np.isnan(x).any(axis=1)
                z = own.outputs((np.where(known[:, None], x, trained.shift) - trained.shift) / trained.scale)[0]
                if own.classes:
                    p = own.probabilities(z)
                    made = [pa.array(p.argmax(axis=1).astype(float), mask=~known), pa.array([r if k else None for r, k in zip(p.tolist(), known, strict=True)], pa.list_(pa.float64()))]
                else:
                    made = [pa.array(z[:, 0] * trained.label_scale + trained.label_shift, mask=~known)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=schema.names)

    return source.toDF(*[f"c{i}" for i in range(len(source.columns))]).mapInArrow(run, schema)
