"""Declared schemas of the store's four tables."""
from pyspark.sql import types as T


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_ID, _TEXT, _INT, _DATE = T.LongType(), T.StringType(), T.IntegerType(), T.DateType()
_PRICE, _FRACTION = T.DecimalType(12, 2), T.DecimalType(4, 2)

CUSTOMERS = _table(
    ("customer_id", _ID, False), ("customer_name", _TEXT, True), ("gender", _TEXT, True),
    ("age", _INT, True), ("city", _TEXT, True), ("email", _TEXT, True), ("phone", _TEXT, True),
    ("membership_type", _TEXT, True), ("signup_date", _DATE, True))

PRODUCTS = _table(
    ("product_id", _ID, False), ("product_name", _TEXT, True), ("category", _TEXT, True),
    ("brand", _TEXT, True), ("unit_price", _PRICE, True))

ORDERS = _table(
    ("order_id", _ID, True), ("customer_id", _ID, True), ("product_id", _ID, True),
    ("order_date", _DATE, True), ("quantity", _INT, True), ("unit_price", _PRICE, True),
    ("discount", _FRACTION, True), ("returned", _INT, True), ("payment_method", _TEXT, True),
    ("delivery_days", _INT, True))

REVIEWS = _table(
    ("review_id", _ID, True), ("product_id", _ID, True), ("rating", _INT, True),
    ("review_text", _TEXT, True), ("review_date", _DATE, True))

CLEAN = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS, "reviews": REVIEWS}


def _dates_as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _TEXT if f.dataType == _DATE else f.dataType, True)
                         for f in schema.fields])


# Raw tables hold their dates as unchecked text.
RAW = {name: _dates_as_text(schema) for name, schema in CLEAN.items()}
