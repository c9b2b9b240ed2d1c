"""Running totals and top rows over data of any size.

``row_number() over (order by x)`` brings a whole group into one task. The operators here cut the rows into ordered
ranges first, of equal numbers of rows: totals per range are few and are accumulated in one window, rows are ordered
only inside their range, and the two add up. Every row is kept and every answer is exact.
"""
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.operators.selection import select

#: Bounds of ranges are this much closer to equal numbers of rows than the ranges are many.
_ACCURACY = 20
#: Ranges at most, so that the summary they are taken from stays small; beyond that ranges grow.
MOST_RANGES = 4096


def ranges(df: DataFrame, key: str, count: int) -> list[float]:
    """Inner bounds of about ``count`` ranges with equally many rows, from a mergeable summary of bounded size."""
    count = max(1, min(count, MOST_RANGES))
    points = [k / count for k in range(1, count)]
    if not points:
        return []
    row = df.agg(F.percentile_approx(key, points, _ACCURACY * count).alias("bounds")).first()
    return sorted(set(row["bounds"] or []))


def running_totals(df: DataFrame, key: str, totals: list[str], count: int | None = None) -> DataFrame:
    """Add ``<t>_before`` and ``<t>_all`` for each column in ``totals``.

    ``<t>_before`` sums the rows whose ``key`` is smaller, ``<t>_all`` sums all. ``key`` is a double, unique and not
    null. The bounds of the ranges come from the keys themselves, so keys in a narrow band spread like any others.
    ``df`` is read three times; give a written table. ``count``: ranges, as many as shuffle partitions unless given.
    """
    spark = df.sparkSession
    bounds = ranges(df, key, count or int(spark.conf.get("spark.sql.shuffle.partitions")))
    inner = [b for b in bounds if float("-inf") < b < float("inf")]
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol=key, outputCol="_range", handleInvalid="keep")
    slotted = cut.transform(df) if inner else df.withColumn("_range", F.lit(0.0))
    per_range = slotted.groupBy("_range").agg(*[F.sum(t).alias(t) for t in totals])
    whole = Window.partitionBy()
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range",
        *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_{t}_offset") for t in totals],
        *[F.sum(t).over(whole).alias(f"{t}_all") for t in totals])
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = slotted.select(
        "*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_{t}_inside") for t in totals])
    joined = ranked.join(offsets, "_range")
    return joined.select(
        *df.columns,
        *[(F.col(f"_{t}_offset") + F.col(f"_{t}_inside")).alias(f"{t}_before") for t in totals],
        *[f"{t}_all" for t in totals])


def numbered(df: DataFrame, digest: str) -> DataFrame:
    """Add ``position`` (1, 2, … by ``digest``), a unique text of hex digits, and ``group_size``, all rows.

    Digests are spread evenly, so their first digits are ranges of equal size.
    """
    slotted = df.withColumn("_range", F.substring(digest, 1, 4))
    counts = slotted.groupBy("_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()
    offsets = counts.select("_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_offset"),
                            F.sum("_n").over(whole).alias("group_size"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(digest))
    return (slotted.withColumn("_inside", inside).join(offsets, "_range")
            .select(*df.columns, (F.col("_offset") + F.col("_inside")).cast("bigint").alias("position"), "group_size"))


def largest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest value, the smaller key first among equals.

    The n-th largest value is selected; rows above it all belong, and rows that share it are taken by key. Only the
    latter are ordered, and only as many of a task as are asked for. ``df`` is read several times; give a
    written table.
    """
    if n <= 0:
        return df.limit(0)
    numbers = df.select(F.col(value).cast("double").alias("_value"))
    last = select(numbers, "_value", lambda size: [size - n])
    if not last:
        # No more than n values, null ones last: all rows, as far as n goes.
        known = df.where(F.col(value).isNotNull())
        return known.unionByName(df.where(F.col(value).isNull()).orderBy(key).limit(max(0, n - known.count())))
    least = F.lit(last[0].value)
    above = df.where(F.col(value).cast("double") > least)
    return above.unionByName(df.where(F.col(value).cast("double") == least).orderBy(F.desc(value), key).limit(n - above.count()))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``.

    Spark turns a ``row_number`` compared with a constant into a partial top-k on
    the map side (WindowGroupLimit), so a hot group sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
