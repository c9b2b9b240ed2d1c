"""Data quality: profile, checks, cleaning log and before/after comparison."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import parse_date
from storelens.functions.money import percent
from storelens.functions.text import bracketed, is_blank, looks_messy
from storelens.operators.cleaning import cleaned_columns, cleaning_actions, kept_rows
from storelens.operators.profiling import as_rows, count_where, profile, stack_all
from storelens.sources.store import TABLES, Store

KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "reviews": "review_id"}

# The issue names and planned actions of the thirteen checks.
CHECKS = [
    ("customers", "Missing age", "Keep: impute in ML pipeline"),
    ("customers", "Inconsistent city text", "Fix: trim + Title Case"),
    ("customers", "Email shared by customers", "Keep: IDs differ, likely typo"),
    ("products", "Missing brand", "Fix: fill 'Unknown'"),
    ("products", "Inconsistent category text", "Fix: trim + Title Case"),
    ("orders", "Negative unit_price", "Fix: absolute value"),
    ("orders", "Quantity <= 0", "Remove"),
    ("orders", "Invalid order_date", "Remove"),
    ("orders", "Missing payment_method", "Fix: fill 'Unknown'"),
    ("orders", "Missing delivery_days", "Keep: impute in ML pipeline"),
    ("reviews", "Empty review_text", "Remove"),
    ("reviews", "Rating outside 1-5", "Remove"),
    ("reviews", "Invalid review_date", "Keep: date not used"),
]
ACTIONS = {(table, issue): action for table, issue, action in CHECKS}


def _bad_date(table: DataFrame, column: str) -> Column:
    """Raw dates are text and may not parse; in a cleaned table only null is left as invalid."""
    if dict(table.dtypes)[column] == "string":
        return parse_date(F.col(column)).isNull()
    return F.col(column).isNull()


Columns = Callable[[str], Column]


def quality_profile(store: Store) -> DataFrame:
    return stack_all([profile(df, name, KEYS[name]) for name, df in store.tables().items()])


def _simple_checks(table: str, column: Columns, bad_date: Columns) -> list[Column]:
    """The checks of a table in their order, over the columns that ``column`` gives."""
    return {
        "products": lambda: [column("brand").isNull(), looks_messy(column("category"))],
        "orders": lambda: [column("unit_price") < 0, column("quantity") <= 0, bad_date("order_date"),
                           column("payment_method").isNull(), column("delivery_days").isNull()],
        "reviews": lambda: [is_blank(column("review_text")), ~column("rating").between(1, 5), bad_date("review_date")],
    }[table]()


def _customer_checks(customers: DataFrame, cities: dict[str, Column]) -> DataFrame:
    """All customer checks in one pass: rows are first merged by e-mail, case ignored.

    Everyone behind an e-mail that occurs more than once is a bad row; customers without
    one never are. Each entry of ``cities`` gives the checks under its name, for that column as the city.
    """
    by_email = customers.groupBy(F.lower("email").alias("_email")).agg(
        F.count("*").alias("_n"),
        F.sum(F.when(F.col("age").isNull(), 1).otherwise(0)).alias("_no_age"),
        *[F.sum(F.when(looks_messy(city), 1).otherwise(0)).alias(f"_messy_{v}") for v, city in cities.items()])
    shared = F.col("_email").isNotNull() & (F.col("_n") > 1)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return by_email.agg(total(F.col("_n")).alias("_total"), *[c for v in cities for c in (
        total(F.col("_no_age")).alias(f"{v}0"), total(F.col(f"_messy_{v}")).alias(f"{v}1"),
        total(F.when(shared, F.col("_n"))).alias(f"{v}2"))])


def _issues(table: str) -> list[dict[str, str]]:
    return [{"table": table, "issue": issue, "action": action} for name, issue, action in CHECKS if name == table]


def quality_checks(store: Store) -> DataFrame:
    """Bad rows per check and their share of the table. Each table is read once."""
    frames = []
    for table in TABLES:
        df = getattr(store, table)
        if table == "customers":
            totals = _customer_checks(df, {"v": F.col("city")})
        else:
            checks = _simple_checks(table, F.col, lambda c, df=df: _bad_date(df, c))
            totals = df.agg(F.count("*").alias("_total"),
                            *[count_where(check).alias(f"v{n}") for n, check in enumerate(checks)])
        frames.append(as_rows(totals, _issues(table), ["_total"], "bad_rows"))
    return stack_all(frames).select(
        "table", "issue", "bad_rows",
        percent(F.col("bad_rows"), F.col("_total")).alias("pct_of_table"), "action")


def invalid_date_examples(orders: DataFrame) -> DataFrame:
    return (orders.where(_bad_date(orders, "order_date"))
            .groupBy("order_date").agg(F.count("*").alias("n_orders")))


def bad_row_samples(table: DataFrame, condition: Column, columns: list[str | Column], n: int = 5) -> DataFrame:
    """``n`` rows that satisfy a problem condition; the order by every column makes them repeatable."""
    found = table.where(condition).select(*columns)
    return found.orderBy(*found.columns).limit(n)


def bad_quantity_rows(store: Store, n: int = 5) -> DataFrame:
    return bad_row_samples(store.orders, F.col("quantity") <= 0,
                           ["order_id", "customer_id", "product_id", "order_date", "quantity", "unit_price"], n)


def missing_age_rows(store: Store, n: int = 5) -> DataFrame:
    return bad_row_samples(store.customers, F.col("age").isNull(),
                           ["customer_id", "customer_name", "age", "city"], n)


def missing_brand_rows(store: Store, n: int = 5) -> DataFrame:
    return bad_row_samples(store.products, F.col("brand").isNull(),
                           ["product_id", "product_name", "category", "brand"], n)


def missing_payment_or_delivery_rows(store: Store, n: int = 5) -> DataFrame:
    return bad_row_samples(store.orders, F.col("payment_method").isNull() | F.col("delivery_days").isNull(),
                           ["order_id", "order_date", "payment_method", "delivery_days"], n)


def empty_review_rows(store: Store, n: int = 5) -> DataFrame:
    shown = bracketed(F.coalesce("review_text", F.lit("NULL"))).alias("review_text")
    return bad_row_samples(store.reviews, is_blank(F.col("review_text")), ["review_id", "rating", shown], n)


def city_spelling_variants(customers: DataFrame, n: int = 5) -> DataFrame:
    """Cities written in more than one way, the first ``n`` by name.

    Spellings are made distinct first; only those of the cities shown are listed.
    """
    spellings = (customers.where(F.col("city").isNotNull())
                 .groupBy(F.lower(F.trim("city")).alias("real_city"), "city").agg(F.count("*").alias("_n")))
    shown = (spellings.groupBy("real_city").agg(F.count("*").alias("_spellings"))
             .where(F.col("_spellings") > 1).select("real_city").orderBy("real_city").limit(n))
    return (spellings.join(shown, "real_city", "left_semi").groupBy("real_city")
            .agg(F.array_join(F.sort_array(F.collect_set(bracketed(F.col("city")))), ",").alias("spellings_found"))
            .orderBy("real_city"))


def negative_price_vs_list(store: Store, n: int = 5) -> DataFrame:
    """Orders with a negative price beside the list price of their product."""
    wrong = store.orders.where(F.col("unit_price") < 0).select(
        "order_id", "product_id", F.col("unit_price").alias("order_price"))
    listed = store.products.select("product_id", F.col("unit_price").alias("list_price"))
    return (wrong.join(listed, "product_id").select("order_id", "order_price", "list_price")
            .orderBy("order_id", "order_price", "list_price").limit(n))


def category_spellings(products: DataFrame) -> DataFrame:
    return (products.groupBy("category").agg(F.count("*").alias("products"))
            .orderBy(F.lower(F.trim("category")), "category")
            .select(bracketed(F.col("category")).alias("category"), "products"))


def cleaning_log(store: Store) -> DataFrame:
    """Rows that each cleaning action affects, in one pass per table."""
    frames = []
    for table, actions in cleaning_actions().items():
        totals = getattr(store, table).agg(
            *[count_where(condition).alias(f"v{n}") for n, (_, condition) in enumerate(actions)])
        labels = [{"table": table, "action": action} for action, _ in actions]
        frames.append(as_rows(totals, labels, [], "rows_affected"))
    return stack_all(frames)


def row_summary(raw: Store) -> DataFrame:
    """Rows before and after cleaning. Each raw table is read once."""
    kept = kept_rows()
    counts = stack_all([
        df.agg(F.count("*").alias("rows_before"), count_where(kept[name]).alias("rows_after"))
        .select(F.lit(name).alias("table"), "rows_before", "rows_after") for name, df in raw.tables().items()])
    removed = F.col("rows_before") - F.col("rows_after")
    return counts.select("table", "rows_before", "rows_after", removed.alias("removed"),
                         percent(removed, F.col("rows_before")).alias("removed_pct"))


def quality_comparison(raw: Store) -> DataFrame:
    """Checks of the raw store beside the checks of what cleaning makes of it. Each raw table is read once."""
    frames = []
    for table in TABLES:
        df, kept, cleaned = getattr(raw, table), kept_rows()[table], cleaned_columns()[table]
        if table == "customers":
            totals = _customer_checks(df, {"v": F.col("city"), "w": cleaned["city"]})
        else:
            before = _simple_checks(table, F.col, lambda c, df=df: _bad_date(df, c))
            after = _simple_checks(table, lambda c, own=cleaned: own.get(c, F.col(c)),
                                   lambda c, own=cleaned: own[c].isNull())
            totals = df.agg(*[count_where(check).alias(f"v{n}") for n, check in enumerate(before)],
                            *[count_where(kept & check).alias(f"w{n}") for n, check in enumerate(after)])
        entries = [F.struct(*[F.lit(v).alias(k) for k, v in label.items()], F.col(f"v{n}").alias("before"),
                            F.col(f"w{n}").alias("after")) for n, label in enumerate(_issues(table))]
        frames.append(totals.select(F.inline(F.array(*entries))))
    status = (F.when(F.col("action").startswith("Keep"), "Kept on purpose")
              .when(F.col("after") == 0, "Resolved")
              .otherwise("CHECK"))
    return stack_all(frames).withColumn("status", status)
