import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelens.functions import dates, labels, money, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, expected", [
    ("o'brien-al x2y", "O'Brien-Al X2Y"), ("  LAHORE ", "Lahore"), ("\tmultan\n", "Multan"),
    (" new york ", "New York"), ("", ""), (None, None), ("ÉCOLE normale", "École Normale"),
])
def test_standard_text(spark, raw, expected):
    assert one(spark, raw, text.standard_text) == expected


@pytest.mark.parametrize("raw, expected", [
    ("Lahore", False), ("LAHORE", True), ("lahore", True), (" Lahore", True), ("\tLahore", False), (None, None)])
def test_looks_messy(spark, raw, expected):
    assert one(spark, raw, text.looks_messy) is expected


@pytest.mark.parametrize("raw, expected", [
    ("2026-01-05", dt.date(2026, 1, 5)), ("2026-1-5", dt.date(2026, 1, 5)), ("2026-02-30", None),
    ("2026-13-01", None), ("2026-01-05 10:00", None), (" 2026-01-05", None), ("2026", None), ("", None), (None, None)])
def test_parse_date(spark, raw, expected):
    assert one(spark, raw, dates.parse_date) == expected


def test_year_earlier(spark):
    assert one(spark, "2024-02", dates.year_earlier) == "2023-02"


@pytest.mark.parametrize("raw, expected", [
    ("Not good!! Would NOT buy again... 0/10", ["not", "good", "would", "not", "buy", "again"]),
    ("don't a I", ["don"]), ("naïve café ok", ["ok"]), ("abc_def x1 ab2 cd", ["cd"]), ("", []), (None, None)])
def test_words(spark, raw, expected):
    assert one(spark, raw, text.words) == expected


@pytest.mark.parametrize("raw, expected", [
    (["not", "so", "good"], ["not", "so", "good", "not so", "so good"]), (["one"], ["one"]), ([], [])])
def test_words_and_pairs(spark, raw, expected):
    assert one(spark, raw, text.words_and_pairs, "array<string>") == expected


@pytest.mark.parametrize("raw, expected", [
    ("quality bohat kharab thi", True), ("BOHAT", True), ("third thing", False), ("thi, yes", True), ("thié", False)])
def test_mentions(spark, raw, expected):
    assert one(spark, raw, lambda c: text.mentions(c, ["hai", "thi", "bohat"])) is expected


@pytest.mark.parametrize("raw, first, letters", [
    ("Sara Bibi Khan", "Sara", "SB"), ("madonna", "madonna", "M"), ("  ali  raza ", "ali", "AR")])
def test_names(spark, raw, first, letters):
    assert one(spark, raw, text.first_word) == first
    assert one(spark, raw, text.initials) == letters


def test_template_keeps_unknown_names_and_never_expands_values(spark):
    df = spark.createDataFrame([("{city} Khan", "Lahore")], "name string, city string")
    filled = text.fill_template("Hi {name}, {{x}} {nobody} from {city}{", {"name": F.col("name"), "city": F.col("city")})
    assert df.select(filled).first()[0] == "Hi {city} Khan, {x} {nobody} from Lahore{"


@pytest.mark.parametrize("p, band, choice", [
    (0.7, "High risk", "Likely to churn"), (0.69999, "Medium risk", "Likely to churn"),
    (0.5, "Medium risk", "Likely to churn"), (0.49999, "Low risk", "Likely to stay")])
def test_bands(spark, p, band, choice):
    assert one(spark, p, labels.risk_band, "double") == band
    assert one(spark, p, labels.decision, "double") == choice


@pytest.mark.parametrize("rating, label", [(1, "Negative"), (2, "Negative"), (3, "Neutral"), (4, "Positive"), (5, "Positive")])
def test_sentiment(spark, rating, label):
    assert one(spark, rating, labels.sentiment_of, "int") == label


@pytest.mark.parametrize("value, shown", [
    (2.5e9, "PKR 2.50B"), (1234567.0, "PKR 1.2M"), (45600.0, "PKR 46K"), (999.4, "PKR 999")])
def test_magnitude(spark, value, shown):
    assert one(spark, value, money.magnitude, "double") == shown


def test_ratios_survive_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    row = df.select(money.ratio(F.col("a"), F.col("b")), money.percent(F.col("a"), F.col("b")),
                    money.change_percent(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (None, None, None)


def test_total_is_exact_for_large_small_and_negative_amounts(spark):
    values = ["0.0001", "-0.0001", "99999999999.9999", "-7.25", "123456.7891", "0.5"]
    df = spark.createDataFrame([(Decimal(v),) for v in values] * 1000 + [(None,)], "x decimal(29,4)")
    assert df.select(money.total(F.col("x"))).first()[0] == sum(Decimal(v) for v in values) * 1000
    assert df.where("x is null").select(money.total(F.col("x"))).first()[0] is None


def test_total_outgrows_a_bigint_of_ten_thousandths(spark):
    line = Decimal("800000000000000.1234")
    df = spark.range(100000).select(F.lit(line).cast("decimal(29,4)").alias("x"))
    assert df.select(money.total(F.col("x"))).first()[0] == line * 100000
