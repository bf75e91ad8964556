"""Training of dense networks on labelled vectors, and what their size is.

The rows are dealt once into steps, a folder each, beside the validation rows.  A step is one job: tasks add up the gradient of the
rows they read, a number for each parameter, these are summed by a shuffle with sums ahead of it, and the driver holds nothing but
parameters, whose number is bounded by ``MOST``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.evaluation import shuffle_key
from quillspark.state import shared_folder

#: Parameters that driver and tasks may hold.
MOST = 4_000_000
HISTORY = "epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, rate double, since int"
Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Settings:
    """How to train.  ``optimiser``: adam, adamw or sgd; ``schedule``: plateau, step, cosine or none."""

    hidden: tuple[int, ...] = ()
    epochs: int = 100
    steps: int = 1
    rate: float = 0.001
    optimiser: str = "adam"
    decay: float = 1e-4
    momentum: float = 0.9
    schedule: str = "plateau"
    schedule_patience: int = 10
    factor: float = 0.5
    patience: int = 15
    seed: int = 42


@dataclass
class Fitted:
    """Parameters of the best epoch, the history's rows, and the labels in the order of the outputs."""

    layers: Layers
    labels: list[str]
    epochs: list[tuple] = field(default_factory=list)

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.epochs, HISTORY)


def initial(sizes: list[int], seed: int) -> Layers:
    draw = np.random.default_rng(seed)
    return [(draw.uniform(-1, 1, (a, b)) / math.sqrt(a), draw.uniform(-1, 1, b) / math.sqrt(a)) for a, b in zip(sizes, sizes[1:])]


def outputs(layers: Layers, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What goes into each layer, and the last one's softmax."""
    into = []
    for k, (w, b) in enumerate(layers):
        into.append(x)
        x = x @ w + b
        x = np.maximum(x, 0) if k + 1 < len(layers) else x
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return into, e / e.sum(axis=1, keepdims=True)


def sums(layers: Layers, x: np.ndarray, target: np.ndarray, gradient: bool = True) -> np.ndarray:
    """Rows, their loss, how many are told rightly, and the gradient of the loss, all summed over the rows."""
    into, p = outputs(layers, x)
    own = np.arange(len(x))
    loss = -np.log(np.maximum(p[own, target], 1e-300)).sum()
    head = [np.array([len(x), loss, (p.argmax(axis=1) == target).sum()], float)]
    if not gradient:
        return head[0]
    back = p.copy()
    back[own, target] -= 1
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts[:0] = [(into[k].T @ back).ravel(), back.sum(axis=0)]
        if k:
            back = (back @ layers[k][0].T) * (into[k] > 0)
    return np.concatenate(head + parts)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def summed(rows: DataFrame, layers: Layers, gradient: bool) -> np.ndarray:
    """``sums`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = sums(layers, matrix(batch, "x"), batch.column("code").to_numpy(), gradient)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])

    found = rows.select("x", "code").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(3 + (sum(w.size + b.size for w, b in layers) if gradient else 0))
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out


class Optimiser:
    """Moves parameters, held as one vector, against the mean gradient."""

    def __init__(self, kind: str, size: int, decay: float, momentum: float):
        if kind not in ("adam", "adamw", "sgd"):
            raise ValueError(f"Unknown optimizer: {kind}")
        self.kind, self.decay, self.momentum, self.step = kind, decay, momentum, 0
        self.first, self.second = np.zeros(size), np.zeros(size)

    def moved(self, at: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        if self.kind == "adamw":
            at = at * (1 - rate * self.decay)
        else:
            gradient = gradient + self.decay * at
        if self.kind == "sgd":
            self.first = gradient if self.step == 1 else self.momentum * self.first + gradient
            return at - rate * self.first
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        mean, size = self.first / (1 - 0.9**self.step), self.second / (1 - 0.999**self.step)
        return at - rate * mean / (np.sqrt(size) + 1e-8)


class Schedule:
    """The rate after each epoch; ``plateau`` lowers it when the score has not risen for more than its patience."""

    def __init__(self, settings: Settings):
        if settings.schedule not in ("plateau", "step", "cosine", "none"):
            raise ValueError(f"Unknown scheduler: {settings.schedule}")
        self.settings, self.rate, self.best, self.bad = settings, settings.rate, -math.inf, 0

    def after(self, epoch: int, score: float) -> float:
        s = self.settings
        if s.schedule == "step":
            self.rate = s.rate * s.factor ** (epoch // max(1, s.schedule_patience))
        elif s.schedule == "cosine":
            self.rate = s.rate * (1 + math.cos(math.pi * epoch / s.epochs)) / 2
        elif s.schedule == "plateau":
            better = score > self.best * (1 + 1e-4) if self.best > 0 else score > self.best
            self.best, self.bad = (score, 0) if better else (self.best, self.bad + 1)
            if self.bad > s.schedule_patience:
                self.rate, self.bad = self.rate * s.factor, 0
        return self.rate


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def shaped(vector: np.ndarray, sizes: list[int]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def counted(sizes: list[int]) -> int:
    return sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))


def whole_vector(features: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    broken = F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double")))
    return F.col(features).isNotNull() & ~F.coalesce(broken, F.lit(False))


def fitted(rows: DataFrame, features: str = "features", label: str = "label", settings: Settings | None = None) -> Fitted:
    """A network fitted to the rows (id, features, label, part): those of part ``train`` teach, those of ``validation`` choose.

    Training ends after the last epoch, or when the validation accuracy has not risen above its best for ``patience`` epochs; the
    parameters of the best epoch stay.  Rows without label, vector or part, and vectors with a component that is null or no number, take no part; vectors of different lengths, no rows
    to train on, and more parameters than ``MOST`` are errors.  With no validation rows its figures are null and the last epoch stays.
    """
    s = settings or Settings()
    spark = rows.sparkSession
    use = rows.where(F.col(label).isNotNull() & whole_vector(features) & F.col("part").isin("train", "validation"))
    train = F.col("part") == "train"
    seen = use.agg(F.min(F.size(features)).alias("low"), F.max(F.size(features)).alias("width"), F.count_if(train).alias("n"), F.count_if(~train).alias("checks"), F.approx_count_distinct(label).alias("classes")).first()
    if not seen["n"]:
        raise ValueError("no rows to train on")
    if seen["low"] != seen["width"]:
        raise ValueError("vectors of different lengths")
    if counted([seen["width"], *s.hidden, seen["classes"]]) > 2 * MOST:  # before labels come to the driver
        raise ValueError(f"more than {MOST} parameters")
    labels = sorted(r[0] for r in use.select(F.col(label).cast("string")).distinct().collect())
    sizes = [seen["width"], *s.hidden, len(labels)]
    if counted(sizes) > MOST:
        raise ValueError(f"more than {MOST} parameters")

    codes = spark.createDataFrame([Row(name=name, code=k) for k, name in enumerate(labels)], "name string, code long")
    step = F.when(~train, -1).otherwise(F.conv(F.substring(shuffle_key("id", s.seed), 1, 8), 16, 10).cast("long") % s.steps).cast("int")
    x = F.transform(features, lambda v: v.cast("double"))
    path = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    use.withColumn("name", F.col(label).cast("string")).join(F.broadcast(codes), "name").select(x.alias("x"), "code", step.alias("step")).write.partitionBy("step").parquet(path)
    held = spark.read.parquet(path)

    at = flat(initial(sizes, s.seed))
    optimiser, schedule = Optimiser(s.optimiser, len(at), s.decay, s.momentum), Schedule(s)
    rate, best, since, kept, epochs = s.rate, -1.0, 0, at, []
    for epoch in range(1, s.epochs + 1):
        total = np.zeros(3)
        for k in range(s.steps):
            one = summed(held.where(F.col("step") == k), shaped(at, sizes), True)
            total += one[:3]
            if one[0]:
                at = optimiser.moved(at, one[3:] / one[0], rate)
        check = summed(held.where("step = -1"), shaped(at, sizes), False) if seen["checks"] else None
        figures = (float(check[1] / check[0]), float(check[2] / check[0])) if seen["checks"] else (None, None)
        score = figures[1] if seen["checks"] else float(epoch)
        since = 0 if score > best else since + 1
        if not since:
            best, kept = score, at
        epochs.append((epoch, float(total[1] / total[0]), float(total[2] / total[0]), *figures, float(rate), since))
        if since >= s.patience:
            break
        rate = schedule.after(epoch, score)
    return Fitted(shaped(kept, sizes), labels, epochs)


def predicted(rows: DataFrame, model: Fitted, features: str = "features", label: str = "label") -> DataFrame:
    """``id, target, p, predicted``: codes of the labels (null for one that training did not meet) and the network's answer.
    Rows without a vector, or with a component that is null or no number, have no answer."""
    kind = dict(rows.dtypes)["id"]
    codes = F.create_map(*(F.lit(v) for pair in zip(model.labels, range(len(model.labels))) for v in pair))
    own = rows.where(whole_vector(features)).select("id", F.try_element_at(codes, F.col(label).cast("string")).alias("target"), F.transform(features, lambda v: v.cast("double")).alias("x"))
    layers = model.layers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = outputs(layers, matrix(batch, "x"))[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("target"), lists, pa.array(p.argmax(axis=1), pa.int32())], names=["id", "target", "p", "predicted"])

    return own.mapInArrow(run, f"id {kind}, target int, p array<double>, predicted int")


def layers_of(rows: DataFrame, features: str, label: str, hidden: tuple[int, ...] = ()) -> DataFrame:
    """``layer, inputs, outputs, parameters, megabytes`` (four bytes each) of the network that ``fitted`` would build for rows."""
    ends = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).agg(F.max(F.size(features)).alias("width"), F.count_distinct(label).alias("classes"))
    sizes = F.array(F.col("width").cast("long"), *(F.lit(h).cast("long") for h in hidden), F.col("classes"))
    pairs = F.arrays_zip(F.slice(sizes, 1, len(hidden) + 1).alias("inputs"), F.slice(sizes, 2, len(hidden) + 1).alias("outputs"))
    parameters = (F.col("inputs") + 1) * F.col("outputs")
    found = ends.where("width is not null").select(F.posexplode(pairs).alias("layer", "pair")).select("layer", F.col("pair.inputs").alias("inputs"), F.col("pair.outputs").alias("outputs"))
    return found.withColumns({"parameters": parameters, "megabytes": parameters * 4 / 1048576})
