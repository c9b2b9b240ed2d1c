"""A small network of rectified units, trained data-parallel with dropout and early stopping.

Training rows are packed into matrices of some thousand rows, dealt to batches by the digest of their key, and
written once. A step is one job over one batch, whose matrices stay with the executors (lost ones are read again): every task
computes the gradient of its matrices, the gradients are summed in a tree on the executors, and one number per
weight comes to the driver, which takes the step. A fifth of the rows, drawn by digest, is never learned from; its
loss decides when to stop and which weights to keep.

Dropout masks come from the row's digest, the step and the unit, so they depend neither on the partitioning nor
on which attempt of a task computed them. Sums are integers, whose order does not matter.
"""
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.hashing import digest_number
from storelens.operators.durable import durable
from storelens.operators.workers import find_package

#: The batch number of rows that are never learned from.
VALIDATION = -1
#: Rows of a packed matrix.
PACKED = 4096


@dataclass(frozen=True)
class Training:
    """``hidden`` layers of rectified units, ``dropout`` after the first. At most ``epochs`` of ``steps`` batches each;
    training stops after ``patience`` epochs without a smaller validation loss. ``rate`` is Adam's.
    """
    hidden: tuple[int, ...] = (32, 16)
    dropout: float = 0.2
    epochs: int = 100
    patience: int = 10
    steps: int = 4
    rate: float = 0.01
    held_out: float = 0.2
    seed: int = 42


def matrices(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights in x out, biases) of each layer, as views of the flat weights."""
    found, at = [], 0
    for wide, narrow in zip(layers, layers[1:]):
        end = at + wide * narrow
        found.append((weights[at:end].reshape(wide, narrow), weights[end:end + narrow]))
        at = end + narrow
    return found


def size_of(layers: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(layers, layers[1:]))


def initial(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights within the square root of 6 over the sum of a layer's ends, no biases."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(size_of(layers))
    for w, _ in matrices(weights, layers):
        limit = np.sqrt(6 / sum(w.shape))
        w[:] = rng.uniform(-limit, limit, w.shape)
    return weights


def kept_units(keys: np.ndarray, step: int, units: int, rate: float, seed: int) -> np.ndarray:
    """Factor of each unit for each row: 0 for a dropped one, else 1 / (1 - rate)."""
    with np.errstate(over="ignore"):
        place = np.uint64(step * units + seed) + np.arange(units, dtype=np.uint64)
        mixed = keys.astype(np.uint64)[:, None] ^ (place * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(11)) * 2.0**-53 >= rate) / (1 - rate)


def margins(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, mask: np.ndarray | None = None) -> list[np.ndarray]:
    """The inputs of each layer, and what the last one puts out."""
    parts = matrices(weights, layers)
    found = [x]
    for k, (w, b) in enumerate(parts):
        out = found[-1] @ w + b
        if k < len(parts) - 1:
            out = np.maximum(out, 0)
            if k == 0 and mask is not None:
                out = out * mask
        found.append(out)
    return found


def loss_and_gradient(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray,
                      mask: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Sum of the cross-entropy over the rows, and its gradient. ``mask`` scales the first hidden layer."""
    parts = matrices(weights, layers)
    *inputs, out = margins(weights, layers, x, mask)
    margin = out[:, 0]
    loss = float((np.maximum(margin, 0) - y * margin + np.log1p(np.exp(-np.abs(margin)))).sum())
    gradient = np.zeros_like(weights)
    slots = matrices(gradient, layers)
    back = (1 / (1 + np.exp(-margin)) - y)[:, None]
    for k in range(len(parts) - 1, -1, -1):
        slots[k][0][:], slots[k][1][:] = inputs[k].T @ back, back.sum(axis=0)
        if k:
            back = (back @ parts[k][0].T) * (inputs[k] > 0)
            if k == 1 and mask is not None:
                back = back * mask
    return loss, gradient


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, key, y, x) as matrices of one batch each."""
    held: dict[int, list] = {}

    def flush(batch: int) -> pa.RecordBatch:
        keys, y, x = map(np.concatenate, zip(*held.pop(batch)))
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int32()), pa.array([len(y)], pa.int32()),
                                           *(pa.array([a.tobytes()], pa.binary()) for a in (keys, y, x))],
                                          names=["batch", "n", "keys", "y", "x"])

    for rows in batches:
        if not rows.num_rows:
            continue
        x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        keys, y = rows.column("key").to_numpy(), rows.column("y").to_numpy()
        slots = rows.column("batch").to_numpy()
        for slot in np.unique(slots):
            own = slots == slot
            held.setdefault(int(slot), []).append((keys[own], y[own], x[own]))
            if sum(len(k) for k, _, _ in held[int(slot)]) >= PACKED:
                yield flush(int(slot))
    for slot in list(held):
        yield flush(slot)


class NetworkModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted network. Adds ``probability``, [1 - p, p]."""

    layers = Param(Params._dummy(), "layers", "units of each layer", TypeConverters.toListInt)
    flat = Param(Params._dummy(), "flat", "all weights", TypeConverters.toListFloat)
    losses = Param(Params._dummy(), "losses", "validation loss per epoch", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, layers=None, flat=None, losses=None):
        super().__init__()
        if layers is not None:
            self._set(layers=layers, flat=flat, losses=losses)

    @property
    def weights(self) -> np.ndarray:
        return np.array(self.getOrDefault(self.flat))

    @property
    def best_epoch(self) -> int:
        """The epoch (from 1) whose weights were kept."""
        return int(np.argmin(self.getOrDefault(self.losses))) + 1

    def _transform(self, dataset: DataFrame) -> DataFrame:
        find_package(dataset.sparkSession)
        layers, weights = self.getOrDefault(self.layers), self.weights

        @F.pandas_udf("array<double>")
        def probability(features: pd.Series) -> pd.Series:
            p = 1 / (1 + np.exp(-margins(weights, layers, np.stack(features))[-1][:, 0])) if len(features) else np.zeros(0)
            return pd.Series(list(np.stack([1 - p, p], axis=1)))

        # Not deterministic, so that filters on the result do not compute it twice.
        return dataset.withColumn("probability", probability.asNondeterministic()(vector_to_array("features")))


class ReluNetwork(Estimator):
    """Learns a network from ``features`` and a 0/1 label. ``key`` tells rows apart for every draw."""

    def __init__(self, label: str, key: str, plan: Training = Training()):
        super().__init__()
        self.label, self.key, self.plan = label, key, plan

    def _packed(self, dataset: DataFrame) -> DataFrame:
        p, key = self.plan, F.coalesce(F.col(self.key).cast("string"), F.lit(""))
        held_out = digest_number(key, p.seed + 7) < int(p.held_out * 2**32)
        batch = F.when(held_out, VALIDATION).otherwise((digest_number(key, p.seed + 8) % p.steps).cast("int"))
        rows = dataset.select(batch.cast("int").alias("batch"), F.xxhash64(key).alias("key"),
                              F.col(self.label).cast("double").alias("y"), vector_to_array("features").alias("x"))
        return durable(rows.mapInArrow(_pack, "batch int, n int, keys binary, y binary, x binary"))

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        p = self.plan
        find_package(dataset.sparkSession)
        packed = self._packed(dataset)
        head = packed.select(F.length("x").alias("x"), "n").first()
        layers = [head["x"] // 8 // head["n"] if head else 0, *p.hidden, 1]
        counts = {r["batch"]: r["n"] for r in packed.groupBy("batch").agg(F.sum("n").alias("n")).collect()}
        rows = {b: packed.where(F.col("batch") == b).select("n", "keys", "y", "x").rdd.map(tuple)
                .persist(StorageLevel.MEMORY_AND_DISK) for b in counts}
        batches = sorted(b for b in counts if b != VALIDATION)
        # Without a row to validate on, the training loss decides.
        judged = [VALIDATION] if VALIDATION in counts else batches
        weights = initial(layers, p.seed)
        best, kept, losses = None, weights, []
        first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
        for _ in range(p.epochs if batches else 0):
            for b in batches:
                gradient = _summed(rows[b], Gradient(weights, layers, p, step))[:-1] / counts[b]
                step += 1
                first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
                weights = weights - p.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
            loss = sum(_summed(rows[b], Gradient(weights, layers, p, None))[-1] for b in judged)
            losses.append(loss / sum(counts[b] for b in judged))
            if best is None or losses[-1] < best:
                best, kept = losses[-1], weights
            if len(losses) - (int(np.argmin(losses)) + 1) >= p.patience:
                break
        for held in rows.values():
            held.unpersist()
        return NetworkModel(layers=layers, flat=kept.tolist(), losses=losses)


#: Sums are carried as multiples of 2 ** -FRACTION.
FRACTION = 60


@dataclass(frozen=True)
class Gradient:
    """What a task adds to a step: the gradient over its rows, and at the end their loss. Without a step, the loss only."""
    weights: np.ndarray
    layers: list[int]
    plan: Training
    step: int | None

    def __call__(self, rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros(len(self.weights) + 1)
        for n, keys, y, x in rows:
            mask = None if self.step is None else kept_units(
                np.frombuffer(keys, np.int64), self.step, self.layers[1], self.plan.dropout, self.plan.seed)
            loss, gradient = loss_and_gradient(self.weights, self.layers, np.frombuffer(x).reshape(n, -1), np.frombuffer(y), mask)
            total[-1] += loss
            total[:-1] += 0 if self.step is None else gradient
        yield np.array([int(v * 2.0**FRACTION) for v in total], object)


def _summed(rows: RDD, task: Gradient) -> np.ndarray:
    return (rows.mapPartitions(task).treeReduce(np.add) / 2**FRACTION).astype(np.float64)
