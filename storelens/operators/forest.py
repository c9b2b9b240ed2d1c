"""A random forest of trees that are grown by tasks and kept in a table.

Features are cut into 32 bins of about equal numbers of rows, from the counts of all their values. Rows travel as one
byte per feature, to every task that grows some of the trees. A tree is grown level by level on all rows, each as often
as a Poisson number of mean 1 says; a node looks at a random subset of the features. Siblings that predict the same are
joined, as Spark's forest does.

A tree is one row of a table, which neither the driver nor a scoring task holds as a whole: rows meet the trees in
parts, the chances are summed by part, then over the parts. Draws come from the number of a tree and the order of the
rows' own bytes, so they don't depend on the partitioning.

A task that grows trees holds a byte per feature and row, and about 50 bytes a row for the tree at work: a gigabyte
for some 15 million rows.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.operators.durable import durable, release
from storelens.operators.workers import find_package

#: The feature of a node that has none.
LEAF = 65_535
#: Rows of a packed block, and nodes whose counts are taken at once.
PACKED, AT_ONCE = 16_384, 8_192
#: Tasks that share the trees, when they are grown and when they score.
GROWING, SCORING = 60, 30
#: A row counts this much, and one more if it is positive: both sums in one.
_ONE = 2.0**26

_TREES = "tree int, nodes bigint, feature binary, split binary, below binary, chance binary"


@dataclass(frozen=True)
class Growth:
    """At least ``leaf`` rows in a leaf, at most ``depth`` splits above it; ``bins`` per feature."""
    trees: int = 300
    leaf: int = 5
    depth: int = 30
    bins: int = 32
    seed: int = 42


def cuts(dataset: DataFrame, bins: int) -> list[list[float]]:
    """Ascending bounds of the bins of every feature: halfway between neighbouring values, all of them where the values
    are no more than the bins, else those nearest to equal numbers of rows."""
    counts = dataset.select(F.posexplode(vector_to_array("features")).alias("feature", "value")) \
        .groupBy("feature", "value").agg(F.count("*").alias("n"))
    # Values are ordered within ranges; what lies before a range is one row of it and feature.
    ordered = durable(counts.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()))
    ends = ordered.groupBy("feature", "part").agg(
        F.sum("n").alias("n"), F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"))
    own, along = Window.partitionBy("feature"), Window.partitionBy("feature").orderBy("part")
    ends = ends.select("feature", "part", (F.sum("n").over(along) - F.col("n")).alias("_offset"),
                       F.sum("n").over(own).alias("_all"), F.sum("values").over(own).alias("_values"),
                       F.lag("high").over(along).alias("_lower"), F.lead("low").over(along).alias("_higher"))
    inside = Window.partitionBy("feature", "part").orderBy("value")
    placed = ordered.select("*", F.sum("n").over(inside).alias("_to"), F.lag("value").over(inside).alias("_lag"),
                            F.lead("value").over(inside).alias("_lead")).join(ends, ["feature", "part"])
    up_to = F.col("_offset") + F.col("_to")
    # Which of the ranks that cut the rows into equal numbers lie before a value's end.
    passed = [F.floor(end * bins / F.col("_all")) for end in (up_to - F.col("n"), up_to)]
    met = (placed.where((F.col("_values") <= bins) | (passed[0] < passed[1]))
           .select("feature", "value", (up_to - F.col("n")).alias("before"), up_to.alias("to"), "_all", "_values",
                   F.coalesce("_lag", "_lower").alias("lower"), F.coalesce("_lead", "_higher").alias("higher")).collect())
    size = dataset.select(F.size(vector_to_array("features"))).first()
    found: list[set[float]] = [set() for _ in range(size[0] if size else 0)]
    for r in met:
        below = None if r["lower"] is None else (r["lower"] + r["value"]) / 2
        above = None if r["higher"] is None else (r["value"] + r["higher"]) / 2
        if r["_values"] <= bins:
            chosen = {above}
        else:
            ranks = [k * r["_all"] / bins for k in range(1, bins)]
            chosen = {below if below is not None and (above is None or t - r["before"] < r["to"] - t) else above
                      for t in ranks if r["before"] < t <= r["to"]}
        found[r["feature"]] |= chosen - {None}
    release(ordered)
    return [sorted(f) for f in found]


def _binned(rows: pa.RecordBatch, bounds: list[list[float]]) -> np.ndarray:
    x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], axis=1).astype(np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch], bounds: list[list[float]], kind: type) -> Iterator[pa.RecordBatch]:
    """Rows (key, x) as blocks of keys, of the given type, and bins."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, x = map(np.concatenate, zip(*held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                                          names=["keys", "x"])

    for rows in batches:
        for first in range(0, rows.num_rows, PACKED):
            part = rows.slice(first, PACKED)
            held.append((part.column("key").to_numpy().astype(kind), _binned(part, bounds)))
            if sum(len(k) for k, _ in held) >= PACKED:
                yield flush()
    if held:
        yield flush()


def _in_order(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their bytes: however they were dealt out, a row's place is the same."""
    wide = -(-(x.shape[1] + 1) // 8) * 8
    words = np.zeros((len(y), wide), np.uint8)
    words[:, :x.shape[1]], words[:, -1] = x, y
    order = np.lexsort(words.view(np.uint64).T)
    return np.ascontiguousarray(x[order]), y[order]


def _best_splits(x: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray, tried: np.ndarray,
                 p: Growth) -> tuple[np.ndarray, ...]:
    """(feature, last bin on the left, sum on the left) for each node; LEAF where no split helps."""
    n = len(tried)
    whole = np.bincount(node, value, n)
    size = np.floor(whole / _ONE)
    positive = whole - size * _ONE
    least = positive**2 / size + 1e-9 * size
    feature, split, left = np.full(n, LEAF, np.uint16), np.zeros(n, np.uint8), np.zeros(n)
    for f in tried.T:
        sums = np.bincount(node * p.bins + x[rows, f[node]], value, n * p.bins).reshape(n, p.bins).cumsum(axis=1)[:, :-1]
        small = np.floor(sums / _ONE)
        hits = sums - small * _ONE
        rest = size[:, None] - small
        with np.errstate(divide="ignore", invalid="ignore"):
            # The larger, the smaller the Gini impurity of both sides.
            gain = np.where((small >= p.leaf) & (rest >= p.leaf),
                            hits**2 / small + (positive[:, None] - hits)**2 / rest, -1.0)
        at = gain.argmax(axis=1)
        top = gain[np.arange(n), at]
        better = top > least
        least[better], feature[better], split[better] = top[better], f[better], at[better]
        left[better] = sums[np.arange(n), at][better]
    return feature, split, left


def grow(x: np.ndarray, y: np.ndarray, tree: int, p: Growth) -> tuple[np.ndarray, ...]:
    """A tree on the rows: feature, split, first child and chance of each node. A row goes to the second child if its bin is
    beyond the split."""
    rng = np.random.default_rng([p.seed, tree])
    weight = rng.poisson(1.0, len(y))
    rows = np.flatnonzero(weight)
    value = weight[rows] * (_ONE + y[rows])
    width = max(1, x.shape[1])
    subset = int(np.ceil(np.sqrt(width)))
    node, sums = np.zeros(len(rows), np.int64), np.array([value.sum()])
    levels = []
    for depth in range(p.depth + 1):
        n = len(sums)
        feature, split, left = np.full(n, LEAF, np.uint16), np.zeros(n, np.uint8), np.zeros(n)
        if depth < p.depth and len(rows) and x.shape[1]:
            tried = rng.random((n, width)).argpartition(subset - 1, axis=1)[:, :subset] if subset < width else \
                np.tile(np.arange(width), (n, 1))
            starts = np.searchsorted(node, np.arange(0, n + AT_ONCE, AT_ONCE))
            for k, first in enumerate(range(0, n, AT_ONCE)):
                own = slice(starts[k], starts[k + 1])
                to = slice(first, first + AT_ONCE)
                feature[to], split[to], left[to] = _best_splits(x, rows[own], node[own] - first, value[own], tried[to], p)
        levels.append((feature, split, sums))
        inner = np.flatnonzero(feature != LEAF)
        if not len(inner):
            break
        number = np.full(n, -1)
        number[inner] = np.arange(len(inner))
        sums = np.stack([left[inner], sums[inner] - left[inner]], axis=1).ravel()
        own = number[node] >= 0
        rows, value, node = rows[own], value[own], node[own]
        node = 2 * number[node] + (x[rows, feature[node]] > split[node])
        order = np.argsort(node, kind="stable")
        rows, value, node = rows[order], value[order], node[order]
    return _pruned(levels)


def _pruned(levels: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The levels as one tree, in which siblings that predict the same are joined."""
    feature, split, sums = (np.concatenate(part) for part in zip(*levels))
    size = np.floor(sums / _ONE)
    positive = sums - size * _ONE
    chance = np.divide(positive, size, out=np.zeros(len(size)), where=size > 0)
    below, at, bounds = np.zeros(len(feature), np.int32), 0, []
    for own, _, _ in levels:
        bounds.append((at, at + len(own)))
        inner = at + np.flatnonzero(own != LEAF)
        below[inner] = at + len(own) + 2 * np.arange(len(inner))
        at += len(own)
    for first, end in reversed(bounds):
        inner = first + np.flatnonzero(feature[first:end] != LEAF)
        a, b = below[inner], below[inner] + 1
        same = (feature[a] == LEAF) & (feature[b] == LEAF) & ((chance[a] > 0.5) == (chance[b] > 0.5))
        feature[inner[same]] = LEAF
    kept = np.zeros(len(feature), bool)
    kept[:1] = True
    for first, end in bounds:
        inner = first + np.flatnonzero((feature[first:end] != LEAF) & kept[first:end])
        kept[below[inner]] = kept[below[inner] + 1] = True
    place = (np.cumsum(kept) - 1).astype(np.int32)
    below = np.where(feature != LEAF, place[np.where(feature != LEAF, below, 0)], 0).astype(np.int32)
    return feature[kept], split[kept], below[kept], chance[kept]


def chances(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, split, below, chance = tree
    found = np.zeros(len(x))
    open_, at = np.arange(len(x)), np.zeros(len(x), np.int32)
    while len(open_):
        f = feature[at]
        end = f == LEAF
        found[open_[end]] = chance[at[end]]
        open_, at, f = open_[~end], at[~end], f[~end]
        at = below[at] + (x[open_, f] > split[at])
    return found


class ForestModel(Model, MLWritable, MLReadable):
    """A grown forest. Adds ``probability``, [1 - p, p], the mean of the trees' chances."""

    def __init__(self, trees: DataFrame | None = None, bounds: list[list[float]] = (), count: int = 0):
        super().__init__()
        self.trees, self.bounds, self.count = trees, bounds, count

    @property
    def totalNumNodes(self) -> int:
        return self.trees.agg(F.sum("nodes")).first()[0] or 0

    def _transform(self, dataset: DataFrame) -> DataFrame:
        find_package(dataset.sparkSession)
        bounds, count, parts = self.bounds, self.count, max(1, min(SCORING, self.count))
        rows = durable(dataset.withColumn("_row", F.monotonically_increasing_id()))
        blocks = durable(rows.select(F.col("_row").alias("key"), vector_to_array("features").alias("x"))
                         .mapInArrow(lambda batches: _blocks(batches, bounds, np.int64), "keys binary, x binary")
                         .withColumn("block", F.monotonically_increasing_id()))
        nothing = F.lit(None).cast("binary")
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        mixed = self.trees.select(
            (F.col("tree") % parts).alias("part"), F.lit(0).alias("kind"), F.col("tree").cast("bigint").alias("key"),
            F.col("feature").alias("a"), F.col("split").alias("b"), F.col("below").alias("c"), F.col("chance").alias("d")
        ).unionAll(blocks.select(every.alias("part"), F.lit(1).alias("kind"), F.col("block").alias("key"),
                                 F.col("keys").alias("a"), F.col("x").alias("b"), nothing.alias("c"), nothing.alias("d")))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = []
            for batch in batches:
                for r in batch.to_pylist():
                    if r["kind"] == 0:
                        trees.append(tuple(np.frombuffer(r[c], t) for c, t in zip("abcd", (np.uint16, np.uint8, np.int32, np.float64))))
                        continue
                    x = np.frombuffer(r["b"], np.uint8).reshape(-1, len(bounds))
                    total = sum((chances(t, x) for t in trees), np.zeros(len(x)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["key"]]), pa.array([r["part"]], pa.int32()),
                         pa.array([r["a"] if r["part"] == 0 else b""], pa.binary()), pa.array([total.tobytes()], pa.binary())],
                        names=["block", "part", "keys", "total"])

        def summed(table: pa.Table) -> pa.Table:
            own = sorted(table.to_pylist(), key=lambda r: r["part"])
            p = sum(np.frombuffer(r["total"]) for r in own) / count
            return pa.table({"_row": np.frombuffer(own[0]["keys"], np.int64), "_p": p})

        scores = durable(mixed.repartitionById(parts, F.col("part")).sortWithinPartitions("kind", "key")
                         .mapInArrow(score, "block bigint, part int, keys binary, total binary")
                         .groupBy("block").applyInArrow(summed, "_row bigint, _p double"))
        release(blocks)
        return rows.join(scores, "_row").withColumn("probability", F.array(1 - F.col("_p"), F.col("_p"))).drop("_row", "_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.model.trees.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark, {"bounds": model.bounds, "count": model.count})
        model.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(self.sparkSession.read.parquet(f"{path}/trees"), metadata["bounds"], metadata["count"])
        model._resetUid(metadata["uid"])
        return model


class Forest(Estimator):
    """Learns a forest from ``features`` and a 0/1 label."""

    def __init__(self, label: str, growth: Growth = Growth()):
        super().__init__()
        self.label, self.growth = label, growth

    def _fit(self, dataset: DataFrame) -> ForestModel:
        find_package(dataset.sparkSession)
        p, bounds = self.growth, cuts(dataset, self.growth.bins)
        tasks = max(1, min(GROWING, p.trees))
        label = F.coalesce((F.col(self.label) == 1).cast("bigint"), F.lit(0).cast("bigint"))
        blocks = durable(dataset.select(label.alias("key"), vector_to_array("features").alias("x"))
                         .mapInArrow(lambda batches: _blocks(batches, bounds, np.uint8), "keys binary, x binary"))

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, task = [], [], None
            for batch in batches:
                for r in batch.to_pylist():
                    task = r["task"]
                    y.append(np.frombuffer(r["keys"], np.uint8))
                    x.append(np.frombuffer(r["x"], np.uint8).reshape(len(y[-1]), len(bounds)))
            if task is None:
                return
            x, y = _in_order(np.concatenate(x), np.concatenate(y))
            for tree in range(task, p.trees, tasks):
                parts = grow(x, y, tree, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int32()), pa.array([len(parts[0])], pa.int64()),
                     *(pa.array([a.tobytes()], pa.binary()) for a in parts)],
                    names=["tree", "nodes", "feature", "split", "below", "chance"])

        every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
        trees = durable(blocks.select(every.alias("task"), "keys", "x").repartitionById(tasks, F.col("task"))
                        .mapInArrow(grown, _TREES))
        release(blocks)
        return ForestModel(trees, bounds, p.trees)
