"""Exact search for the highest inner products by MaxScore.

The dimensions of a vector are terms, its integers floor(scale * x) their weights. Vectors are packed into shards of bounded bytes; a
shard has a posting list per dimension (rows with a weight other than zero, and the weights) with its largest
and smallest weight. For a query a term can add at most its weight times the larger of these.

Against a shard, a query's terms are sorted by that bound. Those whose bounds together stay below the query's fifth
best score so far are non-essential: a row that occurs in no other posting list cannot be among the best.
The essential posting lists are traversed; rows found there are probed in the remaining dimensions, the largest bound
first, as long as score and remaining bounds together can still compete.

Queries are packed into blocks, and every block meets every shard in some task, which carries the best scores from
shard to shard. The lists of all tasks are merged by score.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storelens.llm.integers import LONG, as_long, by_size, finite, floors, matrix
from storelens.operators.durable import durable

#: Integers below this in size: inner products of up to 2**19 dimensions fit 64 bits.
NARROW = 2.0**21
#: Order of scores beyond a long: more than the square of the largest double at any number of dimensions.
FAR = 1 << 2200


@dataclass(frozen=True)
class SearchParameters:
    """``k`` best per query. ``shard_bytes``, ``block_bytes``: about the size of a shard of vectors and a block of
    queries, in doubles. ``tasks``: about as many tasks share the work of all blocks."""
    k: int = 5
    scale: int = 256
    shard_bytes: int = 2 << 20
    block_bytes: int = 1 << 20
    tasks: int = 512


def _packed(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, vec_id, q, v) of one size packed to one row of at most so many bytes."""
    held: dict[int, list] = {}

    def flush(size: int) -> pa.RecordBatch:
        rows, ids, asked, values = map(np.concatenate, zip(*held.pop(size)))
        return pa.RecordBatch.from_arrays(
            [pa.array([size], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows, ids, asked, values))],
            names=["size", "rows", "ids", "asked", "v"])

    for batch in batches:
        for size, at in by_size(batch, "v"):
            most = max(1, most_bytes // (8 * max(1, size)))
            own = batch.take(pa.array(at))
            columns = (own.column("row").to_numpy(), own.column("vec_id").to_numpy(),
                       own.column("q").to_numpy(zero_copy_only=False).astype(np.uint8), matrix(own.column("v")))
            for first in range(0, len(at), most):
                held.setdefault(size, []).append([x[first:first + most] for x in columns])
                if sum(len(x[0]) for x in held[size]) >= most:
                    yield flush(size)
    for size in list(held):
        yield flush(size)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries among packed rows, one row each."""
    for batch in batches:
        for packed in batch.to_pylist():
            rows, ids, asked, values = _arrays(packed, "rows", "ids", "asked", "v")
            at = np.flatnonzero(asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at]), pa.array(ids[at]), pa.array(asked[at] == 1),
                 pa.array(list(values[at]), pa.list_(pa.float64()))], names=["row", "vec_id", "q", "v"])


def _arrays(packed: dict, rows: str, ids: str, asked: str, values: str) -> tuple[np.ndarray, ...]:
    found = np.frombuffer(packed[rows], np.int64)
    return (found, np.frombuffer(packed[ids], np.int64), np.frombuffer(packed[asked], np.uint8),
            np.frombuffer(packed[values], np.float64).reshape(len(found), packed["size"]))


class Shard:
    """Posting lists of some vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.rows, self.ids = rows, ids
        self.columns = np.ascontiguousarray(weights.T)
        self.postings = []
        for column in self.columns:
            at = np.flatnonzero(column)
            self.postings.append((slice(None) if len(at) == len(column) else at, column[at]))
        if len(ids) and len(self.columns):
            zeros = np.zeros(1, weights.dtype)[0]
            self.most = np.array([max(c.max(), zeros) for c in self.columns], weights.dtype)
            self.least = np.array([min(c.min(), zeros) for c in self.columns], weights.dtype)
        else:
            self.most = self.least = np.zeros(len(self.columns), weights.dtype)

    def competing(self, query: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores): every vector whose score reaches ``floor`` (all, if None), with its exact score."""
        bounds = np.maximum(query * self.most, query * self.least)
        terms = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[terms])
        # Vectors in no essential list score ``reach`` of the non-essential terms at most.
        cut = 0 if floor is None or floor <= 0 else int(np.searchsorted(reach, floor, "left"))
        scores = np.zeros(len(self.ids), query.dtype)
        seen = np.zeros(len(self.ids), bool)
        for term in terms[cut:]:
            if query[term]:
                docs, weights = self.postings[term]
                scores[docs] += query[term] * weights
                seen[docs] = True
        if floor is None:
            return np.arange(len(scores)), scores
        if floor <= 0:
            at = np.flatnonzero(scores >= floor)
            return at, scores[at]
        at = np.flatnonzero(seen & (scores + (reach[cut - 1] if cut else 0) >= floor))
        scores = scores[at]
        for place in range(cut - 1, -1, -1):
            if not len(at):
                break
            term = terms[place]
            scores = scores + query[term] * self.columns[term][at]
            keep = scores + (reach[place - 1] if place else 0) >= floor
            at, scores = at[keep], scores[keep]
        return at, scores


class Best:
    """The best scores so far of the queries of a block."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int):
        self.rows, self.ids, self.weights, self.k = rows, ids, weights, k
        empty = np.zeros(0, np.int64)
        self.scores, self.found = [empty] * len(ids), [empty] * len(ids)

    def meet(self, shard: Shard) -> None:
        for q, query in enumerate(self.weights):
            full = len(self.found[q]) == self.k
            at, scores = shard.competing(query, self.scores[q][-1] if full else None)
            other = shard.rows[at] != self.rows[q]
            at, scores = at[other], scores[other]
            if not len(at):
                continue
            if len(at) > self.k:
                # Of the new ones, those that tie with the k-th or beat it.
                enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k] \
                    if scores.dtype != object else np.ones(len(scores), bool)
                at, scores = at[enough], scores[enough]
            scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], shard.ids[at]])
            order = np.lexsort((ids, -scores)) if scores.dtype != object else \
                np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])))
            self.scores[q], self.found[q] = scores[order[:self.k]], ids[order[:self.k]]

    def listed(self) -> pa.RecordBatch:
        lengths = [len(x) for x in self.found]
        exact = [int(s) for x in self.scores for s in x]
        # Scores that do not fit a long are told apart by a second column.
        beyond = [(s + FAR).to_bytes(276) if not -LONG <= s < LONG else b"" for s in exact]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.rows, lengths)), pa.array(np.repeat(self.ids, lengths)),
             pa.array([int(i) for x in self.found for i in x], pa.int64()),
             pa.array([as_long(s) for s in exact], pa.int64()), pa.array(beyond, pa.binary())],
            names=["query_row", "query_id", "vec_id", "score", "beyond"])


def highest(vectors: DataFrame, is_query: Column, p: SearchParameters = SearchParameters(), id_column: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds the ``k`` other rows of highest inner
    product, all if there are fewer. Ties go to the smaller id.

    Rows whose vector is null or has a null or non-finite component take no part, nor do rows without an id. Vectors
    meet only vectors of their own size. Rows that repeat an id are vectors of their own: as queries each has its own
    list, as candidates each is found. Scores are exact; one beyond a long is shown as the largest or smallest
    and still ranked by its value. An empty table, or one without queries, gives no rows. Other columns are not read.
    """
    valid = (vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("q"),
                            F.col(vector).cast("array<double>").alias("v"))
             .where(F.col("vec_id").isNotNull() & finite("v")).withColumn("row", F.monotonically_increasing_id())
             .select("row", "vec_id", "q", "v"))
    packed = "size int, rows binary, ids binary, asked binary, v binary"
    shards = durable(valid.mapInArrow(lambda batches: _packed(batches, p.shard_bytes), packed)
                     .withColumn("shard", F.monotonically_increasing_id()))
    asked = durable(shards.mapInArrow(_unpacked, "row bigint, vec_id bigint, q boolean, v array<double>"))
    total = asked.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(1)).cast("bigint"))).first()[0]
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = -(-total // p.block_bytes)
    salts = max(1, -(-p.tasks // blocks))
    queries = durable(asked.repartition(blocks).mapInArrow(lambda batches: _packed(batches, 2 * p.block_bytes), packed)
                      .select("size", F.spark_partition_id().cast("bigint").alias("block"),
                              *(F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "asked", "v"))))
    # Blocks and shards meet by key: a shard goes to each block, a block to each of the tasks that share its shards. Their
    # files look small for what they are multiplied to, so Spark would send all of one side through the driver.
    left = (shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))))
    right = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    keys = ["size", "block", "salt"]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for batch in batches:
            for pair in batch.to_pylist():
                if best is None or key != (now := tuple(pair[k] for k in keys) + (pair["q_rows"],)):
                    if best is not None:
                        yield best.listed()
                    key = tuple(pair[k] for k in keys) + (pair["q_rows"],)
                    rows, ids, _, values = _arrays(pair, "q_rows", "q_ids", "q_asked", "q_v")
                    best = Best(rows, ids, floors(values, p.scale, NARROW), p.k)
                rows, ids, _, values = _arrays(pair, "rows", "ids", "asked", "v")
                weights = floors(values, p.scale, NARROW)
                if weights.dtype != best.weights.dtype:
                    weights, best.weights = weights.astype(object), best.weights.astype(object)
                best.meet(Shard(rows, ids, weights))
        if best is not None:
            yield best.listed()

    found = (left.join(right.hint("merge"), keys).sortWithinPartitions(*keys, "q_rows")
             .mapInArrow(per_task, "query_row bigint, query_id bigint, vec_id bigint, score bigint, beyond binary"))
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= p.k)
            .select("query_id", "rank", "vec_id", "score"))
