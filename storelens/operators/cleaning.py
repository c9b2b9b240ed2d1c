"""Cleaning of the four raw tables, and the log of what it changes.

Columns that a rule does not name pass through unchanged.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import parse_date
from storelens.functions.text import standard_text, strip
from storelens.sources.store import Store


def cleaned_columns() -> dict[str, dict[str, Column]]:
    """What cleaning makes of the columns of each raw table."""
    return {
        "customers": {"city": standard_text(F.col("city")), "signup_date": parse_date(F.col("signup_date"))},
        "products": {"category": standard_text(F.col("category")), "brand": F.coalesce("brand", F.lit("Unknown"))},
        "orders": {"order_date": parse_date(F.col("order_date")), "unit_price": F.abs("unit_price"),
                   "payment_method": F.coalesce("payment_method", F.lit("Unknown"))},
        "reviews": {"review_text": strip(F.col("review_text")), "review_date": parse_date(F.col("review_date"))},
    }


def kept_rows() -> dict[str, Column]:
    """Which raw rows cleaning keeps: orders with a positive quantity and a real date, reviews with some text and a
    rating from 1 to 5. A null quantity or rating is outside.
    """
    return {
        "customers": F.lit(True), "products": F.lit(True),
        "orders": (F.col("quantity") > 0) & parse_date(F.col("order_date")).isNotNull(),
        "reviews": (strip(F.col("review_text")) != "") & F.col("rating").between(1, 5),
    }


def _clean(raw: DataFrame, table: str) -> DataFrame:
    return raw.where(kept_rows()[table]).withColumns(cleaned_columns()[table])


def clean_customers(raw: DataFrame) -> DataFrame:
    return _clean(raw, "customers")


def clean_products(raw: DataFrame) -> DataFrame:
    return _clean(raw, "products")


def clean_orders(raw: DataFrame) -> DataFrame:
    return _clean(raw, "orders")


def clean_reviews(raw: DataFrame) -> DataFrame:
    return _clean(raw, "reviews")


def clean_store(raw: Store) -> Store:
    return Store(raw.spark,
                 customers=lambda: clean_customers(raw.customers), products=lambda: clean_products(raw.products),
                 orders=lambda: clean_orders(raw.orders), reviews=lambda: clean_reviews(raw.reviews))


def _is(condition: Column) -> Column:
    """Condition with null read as false."""
    return F.coalesce(condition, F.lit(False))


def _changed(column: str) -> Column:
    """Null text counts as changed."""
    return F.coalesce(F.col(column) != standard_text(F.col(column)), F.lit(True))


# The names of the actions. (action, rows it affects). A row that an earlier removal took is not counted by a later one.
def cleaning_actions() -> dict[str, list[tuple[str, Column]]]:
    kept_quantity = _is(F.col("quantity") > 0)
    no_text = _is(strip(F.col("review_text")) == "") | F.col("review_text").isNull()
    return {
        "customers": [("Standardize city text", _changed("city"))],
        "products": [("Standardize category text", _changed("category")),
                     ("Fill missing brand with 'Unknown'", F.col("brand").isNull())],
        "orders": [("Fix negative unit_price (abs)", _is(F.col("unit_price") < 0)),
                   ("Fill missing payment_method with 'Unknown'", F.col("payment_method").isNull()),
                   ("Remove quantity <= 0", _is(F.col("quantity") <= 0)),
                   ("Remove invalid order_date",
                    kept_quantity & parse_date(F.col("order_date")).isNull())],
        "reviews": [("Remove empty review_text", no_text),
                    ("Remove rating outside 1-5", ~no_text & ~_is(F.col("rating").between(1, 5)))],
    }
