"""A uniform shuffle of a table too large for memory, written as shards: two passes.

1. Scatter: a seeded hash of a row's id and text sends it to one of many buckets, each a fraction of memory.
2. Shuffle: each bucket is put in a fixed order, Fisher-Yates shuffled with a generator seeded by the bucket, and
   written. The buckets one after the other are the shuffled table, which is cut into shards whose row
   counts differ by one at most.

A lost task repeats its bucket and gets the same order.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Sharding:
    """``bucket_bytes``: what a task shuffles in memory, in bytes of text. ``overhead``: bytes of a row besides."""
    shards: int = 40
    bucket_bytes: int = 16 << 20
    overhead: int = 16
    seed: int = 11


def row_size(p: Sharding, text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + p.overhead


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: from the last place down, each swaps with a place at or before it."""
    order = np.arange(n)
    picks = np.random.default_rng(seed).integers(0, np.arange(1, n + 1))
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, p: Sharding = Sharding(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: rows in uniformly random order, cut into shards of equal counts.

    Shards 0 to ``shards`` - 1 differ by one row at most; slots of a shard run from 0 without a gap. Null ids
    and texts are values like others, rows that repeat are rows of their own (they share a bucket, so a
    single row repeated without bound would fill one). An empty table stays empty. Columns named shard or
    slot are replaced; all others pass.
    """
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.count("*").alias("n"), F.sum(row_size(p, text)).alias("bytes")).first()
    n, buckets = total["n"], max(1, -(-(total["bytes"] or 0) // p.bucket_bytes))
    key = F.xxhash64(F.lit(p.seed), F.col(id_column).cast("string"), F.col(text))
    scattered = docs.select(*rest).withColumn("__key", key).withColumn("__bucket", F.pmod("__key", F.lit(buckets)))
    sizes = scattered.groupBy("__bucket").agg(F.count("*").alias("__n"))
    # One row per bucket, a thousand buckets to a task.
    group = F.floor(F.col("__bucket") / 1024)
    groups = sizes.groupBy(group.alias("__group")).agg(F.sum("__n").alias("__n"))
    before_group = groups.select("__group", (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__base"))
    within = F.sum("__n").over(Window.partitionBy("__group").orderBy("__bucket")) - F.col("__n")
    offsets = (sizes.withColumn("__group", group).withColumn("__within", within).join(before_group, "__group")
               .select("__bucket", (F.col("__base") + F.col("__within")).alias("__first")))
    starts = np.array([s * n // p.shards for s in range(p.shards)], np.int64)

    def per_bucket(table: pa.Table) -> pa.Table:
        bucket, first = table.column("__bucket")[0].as_py(), table.column("__first")[0].as_py()
        fixed = table.sort_by([("__key", "ascending"), (id_column, "ascending")]).select(rest)
        place = first + np.arange(len(fixed))
        shard = np.searchsorted(starts, place, "right") - 1
        return (fixed.take(pa.array(fisher_yates(len(fixed), [p.seed, bucket])))
                .append_column("shard", pa.array(shard.astype(np.int32)))
                .append_column("slot", pa.array(place - starts[shard])))

    schema = docs.select(*rest).limit(0).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("bigint")).schema
    return scattered.join(offsets, "__bucket").groupBy("__bucket").applyInArrow(per_bucket, schema)


def write_shards(docs: DataFrame, path: str, p: Sharding = Sharding(), id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Writes the shuffled rows as Parquet under ``path``/shard=..., and returns a reader of them.

    Within a shard ``slot`` gives the order; a file holds a run of slots.
    """
    rows = shuffled(docs, p, id_column, text)
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
