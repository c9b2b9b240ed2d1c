"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

1. Rotations are learned on a bounded sample: from the principal axes, alternate between the signs of the
   rotated sample and the rotation that brings it closest to them. Each rotation gives one bit per
   dimension; several, from different starts, make the code as long as the tables need.
2. The code is cut into chunks of about log2(rows) bits, one hash table each. Two vectors meet in a table if
   their chunks differ in at most one bit. For a cosine at the threshold every bit differs with probability
   angle / pi, which gives the number of tables for a chosen miss probability.
3. Pairs that meet are compared by their whole codes, then by cosine of the original vectors in doubles.

Equal vectors are one row from the start, so copies cost nothing and lose no link.
"""
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.components import components
from storelens.operators.durable import durable


@dataclass(frozen=True)
class EmbeddingParameters:
    """``sample``: about so many distinct vectors to learn from. ``miss``: chance that the tables miss a pair at the
    threshold. ``slack``: standard deviations of differing bits above their mean that a pair may have.
    """
    cosine: float = 0.95
    sample: int = 4096
    rounds: int = 40
    miss: float = 0.002
    slack: float = 5.0
    least_chunk: int = 12
    most_chunk: int = 32
    seed: int = 3

    def flip(self) -> float:
        return acos(self.cosine) / pi

    def tables(self, chunk: int) -> int:
        f = self.flip()
        meet = (1 - f) ** chunk + chunk * f * (1 - f) ** (chunk - 1)
        return ceil(log(self.miss) / log(1 - meet))


def rotation(sample: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Principal axes turned so that the signs of the sample are as close to it as can be."""
    axes = np.linalg.eigh(sample.T @ sample)[1]
    turned = sample @ axes
    d = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        signs = np.where(turned @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ turned)
        turn = (left @ right).T
    return axes @ turn


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _valid(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, size, key, v): rows that can have links; key is a digest of the components."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, key = [], []
            for i, v in enumerate(batch.column("v")):
                values = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.empty(0)
                with np.errstate(over="ignore"):
                    length = values @ values
                if len(values) and np.isfinite(length) and length > 0:
                    keep.append(i)
                    key.append(blake2b((values + 0.0).tobytes(), digest_size=16).digest())
            own = batch.take(pa.array(keep, pa.int64()))
            size = pa.array([len(v) for v in own.column("v")], pa.int32())
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), size, pa.array(key, pa.binary()), own.column("v")],
                                             names=["vec_id", "size", "key", "v"])

    picked = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"),
                            F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    return picked.mapInArrow(per_batch, "vec_id bigint, size int, key binary, v array<double>")


def near_vectors(vectors: DataFrame, p: EmbeddingParameters = EmbeddingParameters(), id_column: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Pairs that the tables bring together are linked from ``cosine`` on. A vector that is null, empty or zero,
    or has a null or non-finite component or a length beyond doubles, has no links. Nor have vectors of
    another size than the most frequent one, except with equal ones. A row with a null id has no links, a
    null component and is not kept. Ids should be unique: rows that repeat an id count as vectors of their
    own, and all rows of an id show its links together. Other columns are not read.
    """
    rows = durable(_valid(vectors, id_column, vector))
    classes = durable(rows.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"),
                                              F.min("size").alias("size")))
    sizes = classes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    own = rows.select("key", F.col("vec_id")).join(classes, "key")
    if sizes is None:
        links = classes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    else:
        one = (rows.where(F.col("size") == sizes["size"])
               .join(classes.select("key", F.col("node").alias("vec_id")), ["key", "vec_id"], "left_semi")
               .dropDuplicates(["key", "vec_id"]).select("key", "v"))
        one = durable(one)
        links = durable(_links(one, sizes["count"], sizes["size"], p)
                        .join(classes.select(F.col("key").alias("x"), F.col("node").alias("a"),
                                             F.col("copies").alias("na")), "x")
                        .join(classes.select(F.col("key").alias("y"), F.col("node").alias("b"),
                                             F.col("copies").alias("nb")), "y"))
    near = (links.select(F.col("x").alias("key"), F.col("nb").alias("n"))
            .unionByName(links.select(F.col("y").alias("key"), F.col("na").alias("n")))
            .groupBy("key").agg(F.sum("n").alias("near"))) if sizes is not None else \
        classes.select("key", F.lit(0).cast("bigint").alias("near"))
    # An id that stands for several classes joins them.
    same = own.where("vec_id <> node").select(F.col("node").alias("a"), F.col("vec_id").alias("b"))
    repeated = own.groupBy("vec_id").agg(F.countDistinct("key").alias("k")).where("k > 1").isEmpty()
    found = components(links.select("a", "b") if repeated else links.select("a", "b").unionByName(same))
    per_id = (own.join(near, "key", "left")
              .withColumn("n_links", F.col("copies") - 1 + F.coalesce("near", F.lit(0)))
              .groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("node").alias("node"))
              .join(found, "node", "left"))
    return (vectors.select(F.col(id_column).cast("bigint").alias("vec_id")).join(
        per_id.select("vec_id", "n_links", F.coalesce("component", "node").alias("component_id")), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _links(one: DataFrame, n: int, size: int, p: EmbeddingParameters) -> DataFrame:
    """(x, y) keys of distinct vectors at the threshold, as far as the tables bring them together."""
    share = min(1.0, p.sample / n)
    drawn = one.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").toArrow()
    sample = _unit(drawn.column("v").combine_chunks()) if len(drawn) else np.eye(size)
    chunk = min(max(round(log2(max(2, n))), p.least_chunk), p.most_chunk)
    tables = p.tables(chunk)
    bits = tables * chunk
    held = one.sparkSession.sparkContext.broadcast(np.concatenate(
        [rotation(sample, p.rounds, p.seed + k) for k in range(ceil(bits / size))], axis=1)[:, :bits])
    words = ceil(bits / 64)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(chunk, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                signs = _unit(part.column("v")) @ held.value >= 0
                chunks = signs.reshape(len(signs), tables, chunk) @ place
                packed = np.packbits(np.pad(signs, ((0, 0), (0, words * 64 - bits))), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.FixedSizeListArray.from_arrays(chunks.ravel(), tables).cast(pa.list_(pa.int64())),
                     pa.FixedSizeListArray.from_arrays(packed.view(np.int64).ravel(), words).cast(pa.list_(pa.int64()))],
                    names=["key", "chunks", "code"])

    codes = durable(one.mapInArrow(per_batch, "key binary, chunks array<bigint>, code array<bigint>"))
    index = codes.select("key", "code", F.posexplode("chunks").alias("t", "chunk"))
    probes = index.select(F.col("key").alias("x"), F.col("code").alias("cx"), "t", F.explode(F.transform(
        F.sequence(F.lit(-1), F.lit(chunk - 1)),
        lambda j: F.col("chunk").bitwiseXOR(F.when(j < 0, F.lit(0).cast("bigint")).otherwise(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), j))))).alias("chunk"))
    f = p.flip()
    most = bits * f + p.slack * sqrt(bits * f * (1 - f))
    apart = F.aggregate(F.zip_with("cx", "code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0),
                        lambda total, k: total + k)
    pairs = (probes.join(index, ["t", "chunk"]).where((F.col("x") < F.col("key")) & (apart <= most))
             .select("x", F.col("key").alias("y")).distinct())

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = (_unit(batch.column("vx")) * _unit(batch.column("vy"))).sum(axis=1)
                yield batch.select(["x", "y"]).filter(pa.array(cosine >= p.cosine))

    return (pairs.join(one.select(F.col("key").alias("x"), F.col("v").alias("vx")), "x")
            .join(one.select(F.col("key").alias("y"), F.col("v").alias("vy")), "y")
            .select("x", "y", "vx", "vy").mapInArrow(close, "x binary, y binary"))
