"""Reproducible pseudo-random numbers from keys.

A split or a fold must not depend on partition order, so it is drawn from a
digest of the row's key and not from a generator's state.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def digest_number(key: Column, seed: int = 42) -> Column:
    """First 32 bits of the digest as a number from 0 to 4294967295."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("bigint")


def drawn(rows: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """About ``most`` rows, drawn by the digest of their key; all of them if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(digest_number(F.col(key), seed) < int(most / n * 2**32))
