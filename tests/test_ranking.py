import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows
from storelens.operators import ranking, selection


def test_value_slot_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-12, -1e-12, 1.0, 1.0000001, 2, 3.5, -2, -3.5, 1e12, -1e12, 7e300, 5e-300]
                    + [random.Random(1).uniform(-1e6, 1e6) for _ in range(2000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    slots = [r[0] for r in df.select(selection.value_slot(F.col("v")), "v").orderBy("v").collect()]
    assert slots == sorted(slots)


@pytest.mark.parametrize("values", [
    [1, 2, 3, 4, None], [5.0], [1, 1, 1, 1, 9], [-3, -1, 0, 2, 8, 13.5],
    [random.Random(3).choice([7, random.Random(i).gauss(0, 1e4)]) for i in range(999)]])
@pytest.mark.parametrize("point", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_exact_quantiles(spark, values, point):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    known = [v for v in values if v is not None]
    found = selection.exact_quantiles(df, "v", {"q": point}).first().q
    assert found == pytest.approx(np.quantile(known, point), rel=1e-12, abs=1e-12)


def test_quantiles_per_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 7.0), ("c", None)], "g string, v double")
    assert {r.g: r.m for r in selection.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {"a": 2.5, "b": 7.0}


def passes_of(monkeypatch):
    """Counts the passes of selections from now on."""
    seen = []
    inner = selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda *args: seen.append(args[-1]) or inner(*args))
    return seen


def test_quantiles_of_a_narrow_band(spark, monkeypatch):
    """Values closer than one slot of the first pass: a pass or two more, and no pass exchanges more than its slots."""
    seen = passes_of(monkeypatch)
    n = 200_000
    df = spark.range(n).select((F.lit(100.0) + F.pmod(F.xxhash64("id"), F.lit(1 << 40)) * 2.0**-42).alias("v"))
    values = np.sort([r.v for r in df.collect()])
    assert values[-1] / values[0] < 1.005
    found = selection.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert list(found) == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-15)
    assert 0 < len(seen) <= 3
    cells = selection._cells(df.select(F.col("v").alias("_v"), selection._between(
        F.col("v"), F.lit(float(values[0])), F.lit(float(values[-1])), 1).alias("_slot")), [])
    assert cells.count() <= selection.SLOTS and cells.agg(F.max(F.col("_to") - F.col("_from"))).first()[0] < n / 500


@pytest.mark.parametrize("fetched", [None, 0, 3])
def test_selection_of_every_rank(spark, monkeypatch, fetched):
    rng = random.Random(11)
    data = [(g, rng.choice([None, 0.0, -0.0, 1.5, rng.gauss(0, 1), rng.gauss(0, 1e300), -5e-324, rng.uniform(7, 7 + 1e-12)]))
            for g in ("a", "b", None) for _ in range(60)] + [("i", float("inf")), ("i", float("-inf")), ("i", 3.0), ("n", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    if fetched is not None:
        monkeypatch.setattr(selection, "FETCHED", fetched)
    picked = selection.select(df, "v", lambda n: [F.lit(k) for k in range(-1, 61)], ["g"])
    by_group = {}
    for g, v in data:
        if v is not None:
            by_group.setdefault(g, []).append(v)
    assert {p.group[0] for p in picked} == set(by_group)
    for g, values in by_group.items():
        own = sorted((p for p in picked if p.group[0] == g), key=lambda p: p.rank)
        assert [p.rank for p in own] == list(range(len(values))) and {p.size for p in own} == {len(values)}
        assert g == "n" or [p.value for p in own] == sorted(values)
    assert selection.select(df.limit(0), "v", lambda n: [F.lit(0)]) == []


def test_thresholds_are_digests_at_ranks(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    ends = selection.thresholds(df, F.col("d"), ["g"], lambda n: [F.floor(n * 1 / 3), n - 1, n])
    for g in (0, 1):
        own = sorted(r.d for r in df.where(F.col("g") == g).collect())
        assert ends[(g,)] == [own[500], own[1499]]
    monkeypatch.setattr(selection, "FETCHED", 0)
    seen = passes_of(monkeypatch)
    same = spark.createDataFrame([(1, "ab" * 15 + f"{k:02x}") for k in range(200)], "g int, d string")
    assert selection.thresholds(same, F.col("d"), ["g"], lambda n: [F.lit(77)]) == {(1,): ["ab" * 15 + "4d"]}
    assert len(seen) == 10  # digests that share 30 digits: three more are looked at per pass


def test_running_totals_match_brute_force(spark):
    rng = random.Random(5)
    data = [(float(v), rng.randint(1, 9)) for v in rng.sample(range(-500, 5000), 300)] + [(float("inf"), 2), (float("-inf"), 3)]
    df = spark.createDataFrame(data, "v double, n int")
    for count in (1, 7, 500):
        result = ranking.running_totals(df, "v", ["n"], count)
        for r in result.collect():
            assert r.n_before == sum(n for v, n in data if v < r.v)
            assert r.n_all == sum(n for _, n in data)
        assert result.count() == len(data)
    assert ranking.running_totals(df.limit(0), "v", ["n"]).count() == 0


def test_a_million_scores_in_a_narrow_band_spread_evenly(spark):
    df = spark.range(1_000_000).select((F.lit(0.5) + F.col("id") * 2.0**-50).alias("s"), F.lit(1).alias("n"))
    bounds = ranking.ranges(df, "s", 64)
    assert len(bounds) == 63 and bounds[-1] - bounds[0] < 1e-9
    sizes = np.histogram([r.s for r in df.select("s").sample(0.05, seed=1).collect()], [0.5, *bounds, 1.0])[0]
    assert sizes.max() < 1.3 * sizes.mean()
    spot = ranking.running_totals(df, "s", ["n"], 64).where((F.col("s") - 0.5) / 2.0**-50 != F.col("n_before"))
    assert spot.count() == 0


def test_numbered_is_a_permutation_in_key_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("d"))
    out = ranking.numbered(df, "d").orderBy("d").collect()
    assert [r.position for r in out] == list(range(1, 501)) and {r.group_size for r in out} == {500}


@pytest.mark.parametrize("n", [0, 1, 40, 299, 300, 500])
def test_largest(spark, n):
    rng = random.Random(7)
    data = [(i, rng.choice([1.0, 2.5, -3.0, rng.uniform(0, 1e6), rng.uniform(100, 100.1)])) for i in range(300)]
    df = spark.createDataFrame(data, "k int, v double")
    wanted = sorted(data, key=lambda r: (-r[1], r[0]))[:n]
    assert sorted(rows(ranking.largest(df, "v", "k", n))) == sorted(wanted)


def test_largest_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 1.0)], "k int, v double")
    for n, wanted in ((1, [2]), (2, [2, 4]), (3, [2, 4, 1]), (9, [2, 4, 1, 3])):
        assert {r.k for r in ranking.largest(df, "v", "k", n).collect()} == set(wanted)


def test_first_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, v int")
    kept = ranking.first_per_group(df, ["g"], [F.desc("v")], 2)
    assert sorted(rows(kept)) == [("a", 7, 2), ("a", 8, 1), ("b", 1, 1)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_one_value_in_a_third_of_the_rows(spark):
    data = [5.0] * 1000 + [float(i) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    out = by_key(selection.exact_quantiles(df, "v", {"m": 0.5}).withColumn("k", F.lit(1)), "k")
    assert out[1]["m"] == statistics.median(data)
