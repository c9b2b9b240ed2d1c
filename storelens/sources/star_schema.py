"""The store over the test star schema (customer, nation, part, orders, lineitem, documents, labels).

Those tables lack several of the store's columns. The stand-ins below are fixed rules
on keys: they have no business meaning, they make every job computable and repeatable.
The raw store adds faults by rule as well, so that checks and cleaning have work to do.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.store import Store


# The columns that the store needs, so that opening a table reads no file footer.
_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


class _Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


_LINE_COLUMNS = [
    "l_orderkey AS order_id",
    "l_partkey AS product_id",
    "CAST(l_quantity AS int) AS quantity",
    "CAST(l_extendedprice AS decimal(12,2)) AS unit_price",
    "CAST(l_discount AS decimal(4,2)) AS discount",
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned",
]
_ORDER_COLUMNS = ["order_id", "customer_id", "product_id", "order_date", "quantity", "unit_price",
                  "discount", "returned", "payment_method", "delivery_days"]


def _orders(t: _Tables) -> DataFrame:
    """One row per order line. Every line has its header and every header is unique by key."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        *_LINE_COLUMNS,
        "o_custkey AS customer_id",
        "CAST(o_orderdate AS date) AS order_date",
        "nullif(o_orderpriority, '4-NOT SPECIFIED') AS payment_method",
        """CASE WHEN l_linenumber <> 7 THEN
             abs(datediff(CAST(l_shipdate AS date), CAST(o_orderdate AS date))) % 10 + 1 END AS delivery_days""",
        "l_linenumber")


def _customers(t: _Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey AS customer_id",
        "c_name AS customer_name",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender",
        "CASE WHEN c_custkey % 20 <> 0 THEN CAST(18 + c_custkey % 63 AS int) END AS age",
        "concat(left(n_name, 1), lower(substr(n_name, 2))) AS city",
        "concat('c', c_custkey % 1400, '@example.com') AS email",
        "concat('+000', c_custkey) AS phone",
        "c_mktsegment AS membership_type",
        "date_add(DATE '1994-01-01', CAST(c_custkey % 365 AS int)) AS signup_date")


def _products(t: _Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        "concat(left(p_type, 1), lower(substr(p_type, 2))) AS category",
        "CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS brand",
        "CAST(p_retailprice AS decimal(12,2)) AS unit_price")


def _reviews(t: _Tables) -> DataFrame:
    """Every document is a review; one without a label has no rating."""
    products = t.part.agg(F.count("*")).scalar()
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % products).alias("product_id"),
        F.expr("""CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 5
                       WHEN quality IS NOT NULL THEN 3 END""").alias("rating"),
        F.col("text").alias("review_text"),
        F.expr("date_add(DATE '2001-01-01', CAST(doc_id % 200 AS int))").alias("review_date"))


def open_store(spark: SparkSession, folder: str) -> Store:
    """The store without faults: what cleaning would leave of it."""
    t = _Tables(spark, folder)

    def filled(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, F.coalesce(column, F.lit("Unknown")))

    return Store(
        spark,
        customers=lambda: _customers(t),
        products=lambda: filled(_products(t), "brand"),
        orders=lambda: filled(_orders(t), "payment_method").select(*_ORDER_COLUMNS),
        reviews=lambda: _reviews(t),
        lines=lambda: t.lineitem.selectExpr(*_LINE_COLUMNS))


def open_raw_store(spark: SparkSession, folder: str) -> Store:
    """The store with faults put in by rule, dates as text."""
    t = _Tables(spark, folder)
    return Store(spark, customers=lambda: _raw_customers(t), products=lambda: _raw_products(t),
                 orders=lambda: _raw_orders(t), reviews=lambda: _raw_reviews(t))


def _replaced(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def _raw_customers(t: _Tables) -> DataFrame:
    return _replaced(
        _customers(t),
        city="""CASE WHEN customer_id % 101 = 0 THEN NULL
                     WHEN customer_id % 11 = 0 THEN upper(city)
                     WHEN customer_id % 13 = 0 THEN concat('  ', city, ' ')
                     WHEN customer_id % 17 = 0 THEN concat(chr(9), city)
                     WHEN customer_id % 19 = 0 THEN lower(city) ELSE city END""",
        email="""CASE WHEN customer_id % 37 = 0 THEN NULL
                      WHEN customer_id % 3 = 0 THEN upper(email) ELSE email END""",
        signup_date="""CASE WHEN customer_id % 41 = 0 THEN '2001-13-45'
                            ELSE CAST(signup_date AS string) END""")


def _raw_products(t: _Tables) -> DataFrame:
    return _replaced(
        _products(t),
        category="""CASE WHEN product_id % 7 = 0 THEN upper(category)
                         WHEN product_id % 9 = 0 THEN concat(' ', category) ELSE category END""")


def _raw_orders(t: _Tables) -> DataFrame:
    return _replaced(
        _orders(t).withColumn("k", F.expr("order_id * 7 + l_linenumber")),
        quantity="""CASE WHEN k % 97 = 0 THEN 0 WHEN k % 103 = 0 THEN -quantity
                         WHEN k % 211 = 0 THEN NULL ELSE quantity END""",
        unit_price="CASE WHEN k % 53 = 0 THEN CAST(-unit_price AS decimal(12,2)) ELSE unit_price END",
        order_date="""CASE WHEN k % 83 = 0 THEN '2001-13-45' WHEN k % 131 = 0 THEN '2001-02-30'
                           WHEN k % 137 = 0 THEN 'unknown' ELSE CAST(order_date AS string) END""",
    ).select(*_ORDER_COLUMNS)


def _raw_reviews(t: _Tables) -> DataFrame:
    return _replaced(
        _reviews(t),
        rating="CASE WHEN review_id % 43 = 0 THEN 9 WHEN review_id % 47 = 0 THEN 0 ELSE rating END",
        review_text="""CASE WHEN review_id % 29 = 0 THEN '   ' WHEN review_id % 31 = 0 THEN NULL
                            WHEN review_id % 23 = 0 THEN concat(' ', chr(9), review_text, chr(10), ' ')
                            ELSE review_text END""",
        review_date="""CASE WHEN review_id % 37 = 0 THEN '2001-13-45'
                            ELSE CAST(review_date AS string) END""")
