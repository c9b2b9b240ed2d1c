"""Connected components of a link table as DataFrame rounds."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.durable import durable, release

ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    Alternates two steps until nothing changes: every node points its larger neighbours at its smallest
    neighbour, then points itself and its smaller neighbours at the smallest. A step is one aggregation
    (combined before the shuffle) and one join on the node, which adaptive execution splits when a node
    has very many links. Rows with a null or with a = b add nothing. Each round is written, so a lost
    executor costs one round.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct())
    before = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(smallest, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        old = edges
        edges = durable(small.select("u", F.col("m").alias("v"))
                        .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                        .where("u <> v").distinct())
        release(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
