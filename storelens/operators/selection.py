"""Order statistics by refinement: no value is shuffled or sorted.

The k-th value of a group is found from counts. The values are cut into ordered slots; a slot's count, smallest and
largest value are all that is exchanged, combined map-side. The slot that holds the rank is cut anew, between its own
smallest and largest value, until a slot holds one value or few enough to be fetched. A narrow band costs a pass more,
not a larger task: each pass divides what is left by a thousand.

What comes to the driver is one row per group and rank, and at the end up to ``FETCHED`` values around each,
so groups are few: features, classes. A table without groups is one of them.
"""
import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a refinement.
SLOTS = 1024
#: A slot of at most so many values is fetched whole.
FETCHED = 1024
# 128 slots per factor of two; a double spans fewer than 2,200 factors of two, so no
# column can produce more than about 560,000 slots, and real columns produce a few thousand.
_SLOTS_PER_OCTAVE = 128
_SLOT_SHIFT = 200_000


def value_slot(value: Column) -> Column:
    """Slot number that never decreases as ``value`` grows; infinities and NaN, which sorts last, have slots of their own."""
    size = F.floor(F.least(F.log2(F.abs(value)) * _SLOTS_PER_OCTAVE, F.lit(1e6))) + F.lit(_SLOT_SHIFT)
    return (F.when(F.isnan(value), F.lit(1 << 40))
            .when(value > 0, size)
            .when(value < 0, -size)
            .otherwise(F.lit(0)).cast("bigint"))


def _between(value: Column, low: Column, high: Column, depth: int) -> Column:
    """Slots of equal width between two values, which fall into the first and the last of them.

    Their difference is finite: a slot of the first pass is less than a factor of two wide.
    """
    return F.least(F.floor((value - low) / (high - low) * SLOTS), F.lit(SLOTS - 1)).cast("bigint")


def _next_digits(digest: Column, low: Column, high: Column, depth: int) -> Column:
    """Hex digits that no pass has looked at: all digests left agree in those before."""
    return F.substring(digest, 3 * depth + 1, 3)


@dataclass(frozen=True)
class Kind:
    """How values are cut into ordered slots: at first, and between two values (passes so far given)."""
    first: Callable[[Column], Column]
    refine: Callable[[Column, Column, Column, int], Column]


NUMBERS = Kind(value_slot, _between)
DIGESTS = Kind(lambda digest: F.substring(digest, 1, 3), _next_digits)


@dataclass(frozen=True)
class Picked:
    """The value at one rank (from 0) of a group of ``size`` values."""
    group: tuple
    rank: int
    size: int
    value: object


@dataclass(frozen=True)
class _Span:
    """Values of a group between two of them; ``before`` values of the group are smaller."""
    group: tuple
    before: int
    count: int
    low: object
    high: object

    def single(self) -> bool:
        return self.low == self.high or self.low != self.low


def _same_group(names: Sequence[str], group: tuple) -> Column:
    found = F.lit(True)
    for name, value in zip(names, group):
        found = found & F.col(name).eqNullSafe(F.lit(value))
    return found


def _cells(slotted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Slots with the values before and up to them, and their smallest and largest value."""
    cells = slotted.groupBy(*by, "_slot").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    group = Window.partitionBy(*by)
    up_to = F.sum("_n").over(group.orderBy("_slot"))
    return cells.select(*by, (up_to - F.col("_n")).alias("_from"), up_to.alias("_to"), "_low", "_high",
                        F.sum("_n").over(group).alias("_all"))


def select(values: DataFrame, value: str, ranks: Callable[[Column], Sequence[Column]], within: Sequence[str] = (),
           kind: Kind = NUMBERS) -> list[Picked]:
    """The values at ``ranks(size)`` (from 0) of every group; ranks outside a group are left out.

    Nulls are no values. ``values`` is read once per pass, twice or three times as a rule; give a written table.
    """
    known = values.where(F.col(value).isNotNull()).select(*within, F.col(value).alias("_v"))
    wanted = F.explode(F.array_distinct(F.array(*[r.cast("bigint") for r in ranks(F.col("_all"))]))).alias("_rank")
    first = (_cells(known.withColumn("_slot", kind.first(F.col("_v"))), within).select("*", wanted)
             .where(F.col("_rank").between(F.col("_from"), F.col("_to") - 1)))
    searched = [(r["_rank"], r["_all"], _Span(tuple(r[c] for c in within), r["_from"], r["_to"] - r["_from"], r["_low"], r["_high"]))
                for r in first.collect()]
    found, depth = [], 0
    while searched:
        found += [Picked(s.group, rank, size, s.low) for rank, size, s in searched if s.single()]
        searched = [x for x in searched if not x[2].single()]
        few = [x for x in searched if x[2].count <= FETCHED]
        found += _fetched(known, within, few)
        searched = [x for x in searched if x[2].count > FETCHED]
        depth += 1
        if searched:
            searched = _narrowed(known, within, searched, kind, depth)
    return found


def _fetched(known: DataFrame, within: Sequence[str], searched: list[tuple[int, int, _Span]]) -> list[Picked]:
    """Ranks within spans of few values, which are counted and sorted here."""
    if not searched:
        return []
    spans = list(dict.fromkeys(s for *_, s in searched))
    span = F
    for k, s in enumerate(spans):
        span = span.when(_same_group(within, s.group) & F.col("_v").between(F.lit(s.low), F.lit(s.high)), k)
    counts = (known.select(span.alias("_span"), "_v").where(F.col("_span").isNotNull())
              .groupBy("_span", "_v").agg(F.count("*").alias("_n")).collect())
    found = []
    for k, s in enumerate(spans):
        own = sorted((r["_v"], r["_n"]) for r in counts if r["_span"] == k)
        ends = list(accumulate((n for _, n in own), initial=s.before))[1:]
        found += [Picked(s.group, rank, size, own[bisect_right(ends, rank)][0]) for rank, size, t in searched if t == s]
    return found


def _narrowed(known: DataFrame, within: Sequence[str], searched: list[tuple[int, int, _Span]], kind: Kind,
              depth: int) -> list[tuple[int, int, _Span]]:
    """One more pass: the slot of its span that each rank lies in. Spans of a group do not overlap."""
    spans = list(dict.fromkeys(s for *_, s in searched))
    at = {s: k for k, s in enumerate(spans)}
    span, low, high, hit = F, F, F, F.lit(False)
    for s, k in at.items():
        span = span.when(_same_group(within, s.group) & F.col("_v").between(F.lit(s.low), F.lit(s.high)), k)
        low, high = low.when(F.col("_span") == k, F.lit(s.low)), high.when(F.col("_span") == k, F.lit(s.high))
    for rank, _, s in searched:
        inside = F.lit(rank - s.before)
        hit = hit | ((F.col("_span") == at[s]) & (F.col("_from") <= inside) & (F.col("_to") > inside))
    slotted = (known.withColumn("_span", span).where(F.col("_span").isNotNull())
               .withColumn("_slot", kind.refine(F.col("_v"), low, high, depth)).select("_span", "_slot", "_v"))
    cells = _cells(slotted, ["_span"]).where(hit).collect()
    return [(rank, size, _Span(s.group, s.before + c["_from"], c["_to"] - c["_from"], c["_low"], c["_high"]))
            for rank, size, s in searched for c in cells
            if c["_span"] == at[s] and c["_from"] <= rank - s.before < c["_to"]]


def exact_quantiles(df: DataFrame, value: str, points: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, one row per group. Nulls are ignored.

    ``df`` is read once per pass; give a written table.
    """
    def ranks(n: Column) -> list[Column]:
        return [side((n - 1) * F.lit(float(point))) for point in points.values() for side in (F.floor, F.ceil)]

    numbers = df.select(*within, F.col(value).cast("double").alias("_value"))
    values: dict[tuple, dict[int, float]] = {}
    sizes: dict[tuple, int] = {}
    for p in select(numbers, "_value", ranks, within):
        values.setdefault(p.group, {})[p.rank] = p.value
        sizes[p.group] = p.size
    rows = []
    for group, own in values.items():
        row = []
        for point in points.values():
            place = (sizes[group] - 1) * float(point)
            low, high = own[math.floor(place)], own[math.ceil(place)]
            row.append(low + (high - low) * (place - math.floor(place)))
        rows.append((*group, *row))
    if not within and not rows:
        rows = [(None,) * len(points)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in within] + [f"{name} double" for name in points])
    return df.sparkSession.createDataFrame(rows, schema)


def thresholds(df: DataFrame, key: Column, within: Sequence[str], ranks: Callable[[Column], Sequence[Column]]) -> dict[tuple, list[str]]:
    """Per group the digests at the given ranks (from 0), ascending. ``key`` is a digest in hex."""
    found: dict[tuple, list[str]] = {}
    for p in sorted(select(df.select(*within, key.alias("_key")), "_key", ranks, within, DIGESTS), key=lambda p: p.rank):
        found.setdefault(p.group, []).append(p.value)
    return found
