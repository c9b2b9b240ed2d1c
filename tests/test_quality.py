import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows
from fixtures import dirty_store, store
from storelens.operators.cleaning import clean_store
from storelens.plans import quality


@pytest.fixture(scope="module")
def dirty(spark):
    return dirty_store(spark)


def test_checks(dirty):
    found = {(r.table, r.issue): r.bad_rows for r in quality.quality_checks(dirty).collect()}
    assert found == {
        ("customers", "Missing age"): 1,
        ("customers", "Inconsistent city text"): 4,  # padded, upper, all lower twice; a tab is not a space
        ("customers", "Email shared by customers"): 2,
        ("products", "Missing brand"): 1, ("products", "Inconsistent category text"): 2,
        ("orders", "Negative unit_price"): 1, ("orders", "Quantity <= 0"): 3,
        ("orders", "Invalid order_date"): 4, ("orders", "Missing payment_method"): 1,
        ("orders", "Missing delivery_days"): 1,
        ("reviews", "Empty review_text"): 3, ("reviews", "Rating outside 1-5"): 3,
        ("reviews", "Invalid review_date"): 1}


def test_checks_of_an_empty_store(spark):
    found = rows(quality.quality_checks(store(spark, raw=True)).select("bad_rows", "pct_of_table"))
    assert found == [(0, None)] * 13


def test_cleaning_log_counts_removals_in_sequence(dirty):
    log = {(r.table, r.action): r.rows_affected for r in quality.cleaning_log(dirty).collect()}
    assert log == {
        ("customers", "Standardize city text"): 6,  # the missing city counts, 'Lahore' alone is right
        ("products", "Standardize category text"): 2, ("products", "Fill missing brand with 'Unknown'"): 1,
        ("orders", "Fix negative unit_price (abs)"): 1, ("orders", "Fill missing payment_method with 'Unknown'"): 1,
        ("orders", "Remove quantity <= 0"): 3,  # a null quantity goes unlogged
        ("orders", "Remove invalid order_date"): 3,  # the fourth bad date left with its bad quantity
        ("reviews", "Remove empty review_text"): 3, ("reviews", "Remove rating outside 1-5"): 3}


def test_clean_tables(dirty):
    clean = clean_store(dirty)
    cities = {r.customer_id: r.city for r in clean.customers.collect()}
    assert cities == {1: "Karachi", 2: "Lahore", 3: "O'Brien-Al X2Y", 4: "Multan", 5: None, 6: "Lahore", 7: "Lahore"}
    assert by_key(clean.customers, "customer_id")[5]["signup_date"] is None
    assert rows(clean.products.select("category", "brand")) == [
        ("Fashion", "Unknown"), ("Beauty", "Acme"), ("Home Decor", "Acme")]
    orders = by_key(clean.orders, "order_id")
    assert sorted(orders) == [1, 7, 10]
    assert float(orders[1]["unit_price"]) == 5.0
    assert orders[7]["order_date"] == dt.date(2026, 1, 5) and orders[7]["payment_method"] == "Unknown"
    assert rows(clean.reviews.select("review_id", "review_text", "review_date")) == [
        (7, "fine", None), (8, "poor", dt.date(2026, 1, 2))]


def test_unlisted_columns_pass_through(dirty, spark):
    from storelens.operators.cleaning import clean_orders
    extra = dirty.orders.withColumn("note", F.lit("kept"))
    assert {r.note for r in clean_orders(extra).collect()} == {"kept"}


def test_comparison_resolves_every_fix(dirty):
    after = quality.quality_comparison(dirty)
    statuses = {(r.issue): (r.after, r.status) for r in after.collect()}
    for side, checks in (("before", quality.quality_checks(dirty)), ("after", quality.quality_checks(clean_store(dirty)))):
        assert {r.issue: r[side] for r in after.collect()} == {r.issue: r.bad_rows for r in checks.collect()}
    assert "CHECK" not in {s for _, s in statuses.values()}
    assert statuses["Missing age"] == (1, "Kept on purpose")
    assert statuses["Negative unit_price"] == (0, "Resolved")


def test_row_summary(dirty):
    out = by_key(quality.row_summary(dirty), "table")
    assert {k: v["rows_after"] for k, v in out.items()} == {k: df.count() for k, df in clean_store(dirty).tables().items()}
    assert (out["orders"]["rows_before"], out["orders"]["rows_after"], out["orders"]["removed_pct"]) == (10, 3, 70.0)
    assert out["customers"]["removed"] == 0


def test_profile_counts_copies(spark, dirty):
    doubled = dirty.products.unionByName(dirty.products.where("product_id = 1"))
    from storelens.operators.profiling import profile
    out = by_key(profile(doubled.unionByName(dirty.products.where("product_id = 2").withColumn("brand", F.lit("x"))),
                         "products", "product_id"), "column")
    assert out["brand"]["rows"] == 5 and out["brand"]["nulls"] == 2
    assert out["brand"]["duplicate_rows"] == 1 and out["brand"]["duplicate_ids"] == 2


def test_examples(dirty):
    assert sorted(rows(quality.invalid_date_examples(dirty.orders))) == [
        ("2026-01-05 10:00", 1), ("2026-02-30", 1), ("2026-13-01", 2)]
    assert rows(quality.city_spelling_variants(dirty.customers)) == [("lahore", "[LAHORE],[Lahore],[lahore]")]
    assert [r.order_id for r in quality.bad_quantity_rows(dirty).collect()] == [2, 3, 9]
    assert [tuple(map(float, r)) for r in quality.negative_price_vs_list(dirty).collect()] == [(1.0, -5.0, 25.5)]
    assert rows(quality.category_spellings(dirty.products)) == [("[ Beauty]", 1), ("[FASHION]", 1), ("[Home Decor]", 1)]
    assert rows(quality.empty_review_rows(dirty))[0] == (1, 5, "[NULL]")


def test_profile_of_a_wide_table(spark):
    """More columns than a word has bits."""
    from storelens.operators.profiling import profile
    columns = [f"c{i}" for i in range(150)]
    data = [tuple(None if (i * 7 + k) % 5 == 0 else i for i in range(150)) for k in (1, 2, 2, 3)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(data)] + [(0, *data[0])], ", ".join(["id int"] + [f"{c} int" for c in columns]))
    found = {r.column: r for r in profile(df, "wide", "id").collect()}
    rows_ = data + [data[0]]
    assert all(found[c].nulls == sum(row[i] is None for row in rows_) for i, c in enumerate(columns))
    assert found["id"].rows == 5 and found["id"].duplicate_rows == 1 and found["id"].duplicate_ids == 1 and len(found) == 151
