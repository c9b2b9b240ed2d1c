"""Several counts over one table in one pass, returned as rows."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def count_where(condition: Column) -> Column:
    """Rows that satisfy the condition; null does not, and no rows count as zero."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def as_rows(totals: DataFrame, labels: list[dict[str, object]], keep: list[str], value: str) -> DataFrame:
    """Turn the columns ``v0, v1, …`` of a one-row frame into rows.

    Row i carries the constants of ``labels[i]``, the ``keep`` columns and ``vi`` as ``value``.
    """
    entries = [F.struct(*[F.lit(v).alias(k) for k, v in label.items()], F.col(f"v{i}").alias(value))
               for i, label in enumerate(labels)]
    return (totals.select(*keep, F.explode(F.array(*entries)).alias("_e"))
            .select("_e.*", *keep))


#: Columns whose nulls share a word.
_BITS = 62


def profile(df: DataFrame, name: str, key: str) -> DataFrame:
    """Rows, columns, nulls per column, repeated rows and repeated keys, a row per column.

    What is shuffled of a row is its key, 128 bits of digest and a bit for each null. Copies of one row,
    and rows of one key, are merged before each shuffle.
    """
    columns = df.columns
    nulls = [f"v{i}" for i in range(len(columns))]
    words = [F.lit(0).cast("bigint") for _ in range(0, len(columns), _BITS)]
    for i, c in enumerate(columns):
        bit = F.when(F.col(c).isNull(), F.lit(1 << i % _BITS).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        words[i // _BITS] = words[i // _BITS] + bit
    compared = df.select(F.col(key).alias("_key"), *[w.alias(f"_nulls{i}") for i, w in enumerate(words)],
                         F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("_b"))
    by_row = compared.groupBy(*compared.columns).agg(F.count("*").alias("_n"))
    by_key = by_row.groupBy("_key").agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_distinct"),
        *[F.sum(F.when(F.getbit(f"_nulls{i // _BITS}", F.lit(i % _BITS)) == 1, F.col("_n")).otherwise(0)).alias(v)
          for i, v in enumerate(nulls)])
    zero = F.lit(0)
    totals = by_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("rows"),
        F.coalesce(F.sum("_n") - F.sum("_distinct"), zero).alias("duplicate_rows"),
        F.coalesce(F.sum("_n") - F.count("*"), zero).alias("duplicate_ids"),
        *[F.coalesce(F.sum(v), zero).alias(v) for v in nulls])
    labels = [{"table": name, "columns": len(columns), "column": c} for c in columns]
    return as_rows(totals, labels, ["rows", "duplicate_rows", "duplicate_ids"], "nulls")
