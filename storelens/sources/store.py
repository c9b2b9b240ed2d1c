"""The store: four tables as lazy DataFrames, read from files, a catalog or a database."""
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources import folders, schemas

TABLES = ["customers", "products", "orders", "reviews"]
Table = DataFrame | Callable[[], DataFrame]


class Store:
    """Customers, products, orders and reviews.

    Each table is a DataFrame, or a function that opens it on first use, so that a job
    opens only the tables it reads. ``lines`` is the part of ``orders`` that needs no order
    header (order_id, product_id, quantity, unit_price, discount, returned). A source that
    keeps headers and lines in two tables can supply it without their join; elsewhere it is
    ``orders`` itself.
    """

    def __init__(self, spark: SparkSession, customers: Table, products: Table, orders: Table,
                 reviews: Table, lines: Table | None = None):
        self.spark = spark
        self._sources = {"customers": customers, "products": products, "orders": orders,
                         "reviews": reviews, "lines": lines}

    def _table(self, name: str) -> DataFrame:
        source = self._sources[name]
        if callable(source):
            source = self._sources[name] = source()
        return source

    @property
    def customers(self) -> DataFrame:
        return self._table("customers")

    @property
    def products(self) -> DataFrame:
        return self._table("products")

    @property
    def orders(self) -> DataFrame:
        return self._table("orders")

    @property
    def reviews(self) -> DataFrame:
        return self._table("reviews")

    @property
    def lines(self) -> DataFrame:
        return self.orders if self._sources["lines"] is None else self._table("lines")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def register(self, prefix: str = "") -> None:
        """Make the tables visible to SQL text as temporary views."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


def read_parquet(spark: SparkSession, folder: str, raw: bool = False) -> Store:
    """A saved store under its declared schemas: the newest complete version of what ``write_parquet`` wrote, or plainly
    one Parquet folder per table."""
    declared = schemas.RAW if raw else schemas.CLEAN
    version = stored_version(spark, folder)
    at = f"{folder}/{version}" if version else folder
    return Store(spark, **{name: spark.read.schema(declared[name]).parquet(f"{at}/{name}") for name in TABLES})


def read_tables(spark: SparkSession, database: str) -> Store:
    """A store saved in the catalog, all tables of one version."""
    version = catalog_version(spark, database)
    suffix = _version_suffix(version) if version else ""
    return Store(spark, **{name: spark.table(f"{database}.{name}{suffix}") for name in TABLES})


def read_jdbc(spark: SparkSession, url: str, partitions: int = 64,
              bounds: dict[str, tuple[str, int, int]] | None = None, **options: str) -> Store:
    """A store in a relational database whose JDBC driver is on the class path.

    ``bounds`` maps a table to (integer key, lowest, highest); its read is then split into
    ``partitions`` key ranges instead of passing through one task.
    """
    def table(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
        if bounds and name in bounds:
            key, low, high = bounds[name]
            reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high,
                                    numPartitions=partitions)
        return reader.load()

    return Store(spark, **{name: table(name) for name in TABLES})


_VERSION = re.compile(r"version=(\d+)")


def stored_version(spark: SparkSession, folder: str) -> str | None:
    """The folder of the newest version of a saved store, if there is any."""
    found = [n for n in folders.names_in(spark, folder) if _VERSION.fullmatch(n)]
    return max(found, key=lambda n: int(_VERSION.fullmatch(n)[1]), default=None)


def write_parquet(store: Store, folder: str, keep: int = 2) -> None:
    """Replace the saved copy of all four tables together.

    The tables are written aside, as the next version, whose folder gets its name when the last one is complete: a
    reader finds the old four or the new four, also if the write fails half way. ``keep`` versions stay, so
    that readers of the one before can end.
    """
    spark = store.spark
    now = stored_version(spark, folder)
    number = int(_VERSION.fullmatch(now)[1]) + 1 if now else 1

    def write(aside: str) -> None:
        for name, df in store.tables().items():
            df.write.parquet(f"{aside}/{name}")

    if not folders.appear(spark, f"{folder}/version={number}", write):
        raise RuntimeError(f"another writer has replaced {folder} meanwhile")
    for name in folders.names_in(spark, folder):
        version = _VERSION.fullmatch(name)
        if version and int(version[1]) <= number - keep:
            folders.delete(spark, f"{folder}/{name}")


_PROPERTY = "storelens.version"


def catalog_version(spark: SparkSession, database: str) -> int:
    """The version of the store that a database holds, 0 for plain tables."""
    described = spark.sql(f"DESCRIBE DATABASE EXTENDED {database}").where("info_name = 'Properties'").first()
    found = re.search(rf"\({re.escape(_PROPERTY)},\s*(\d+)\)", described["info_value"] if described else "")
    return int(found[1]) if found else 0


def _version_suffix(version: int) -> str:
    return f"__v{version}"


def write_tables(store: Store, database: str, buckets: int | None = None, keep: int = 2) -> None:
    """Replace the four catalog tables together.

    Each version has tables of its own. A property of the database names the current one and is set, in one step,
    when all four are written; ``read_tables`` goes by it. Views under the plain names follow, for SQL. Versions older
    than the last ``keep`` are dropped.

    With ``buckets``, orders and customers are both bucketed by customer, so the feature
    aggregation and the joins on the customer key read them without a shuffle. Choose a
    count that leaves a bucket of orders at a few hundred megabytes.
    """
    spark = store.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    version = catalog_version(spark, database) + 1
    for name, df in store.tables().items():
        # A table of this version is what a failed write left.
        writer = df.write.mode("overwrite").format("parquet")
        if buckets and name in ("orders", "customers"):
            writer = writer.bucketBy(buckets, "customer_id").sortBy("customer_id")
        writer.saveAsTable(f"{database}.{name}{_version_suffix(version)}")
    spark.sql(f"ALTER DATABASE {database} SET DBPROPERTIES ('{_PROPERTY}' = '{version}')")
    plain = {t.name: t.tableType for t in spark.catalog.listTables(database)}
    for name in TABLES:
        if plain.get(name, "VIEW") != "VIEW":
            spark.sql(f"DROP TABLE {database}.{name}")
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {database}.{name}{_version_suffix(version)}")
        if version > keep:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}{_version_suffix(version - keep)}")


def run_sql(spark: SparkSession, query: str, **values) -> DataFrame:
    """SQL over the registered views, with ``:name`` parameters bound as values."""
    return spark.sql(query, args=values) if values else spark.sql(query)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df
