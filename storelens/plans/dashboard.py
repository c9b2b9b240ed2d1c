"""Dashboard figures. They cover every order: a returned one stays in the counts with no revenue."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import month_of
from storelens.functions.money import as_double, change_percent, kept_amount, magnitude, percent, ratio, total
from storelens.plans.business import named_top, overall
from storelens.sources.store import Store


def store_kpis(store: Store) -> DataFrame:
    """One row of headline figures.

    Orders are summed per customer first, so the distinct buyers are the rows that are left
    and no distinct aggregation is needed next to the sums.
    """
    by_customer = store.orders.groupBy("customer_id").agg(
        total(kept_amount()).alias("_net"), F.count("order_id").alias("_orders"),
        F.sum(1 - F.col("returned")).alias("_kept"), F.sum("returned").alias("_back"),
        F.count("returned").alias("_known"), F.max("order_date").alias("_last"))
    totals = by_customer.agg(
        F.sum("_net").alias("_net"), F.sum("_orders").alias("total_orders"),
        F.sum("_kept").alias("completed_orders"), F.count("customer_id").alias("buying_customers"),
        F.sum("_back").alias("_back"), F.sum("_known").alias("_known"), F.max("_last").alias("data_until"))
    net = as_double(F.col("_net"), 2)
    return totals.select(
        net.alias("net_revenue"), "total_orders", "completed_orders",
        store.customers.agg(F.count("*")).scalar().alias("total_customers"), "buying_customers",
        percent(F.col("_back"), F.col("_known")).alias("return_rate_pct"), "data_until",
        F.round(ratio(net, F.col("completed_orders")), 2).alias("avg_order_value"))


def monthly_dashboard(store: Store) -> DataFrame:
    daily = store.orders.groupBy("order_date").agg(
        total(kept_amount()).alias("_net"), F.count("order_id").alias("_orders"))
    return (daily.groupBy(month_of(F.col("order_date")).alias("month"))
            .agg(as_double(F.sum("_net"), 2).alias("net_revenue"), F.sum("_orders").alias("orders"))
            .orderBy("month"))


def last_vs_previous_month(months: DataFrame) -> DataFrame:
    in_order = overall().orderBy("month")
    changes = months.select(
        "month",
        change_percent(F.col("net_revenue"), F.lag("net_revenue").over(in_order)).alias("net_change_pct"),
        change_percent(F.col("orders"), F.lag("orders").over(in_order)).alias("orders_change_pct"))
    return changes.orderBy(F.desc("month")).limit(1)


def category_dashboard(store: Store) -> DataFrame:
    sold = store.lines.groupBy("product_id").agg(
        total(kept_amount()).alias("_net"), F.count("order_id").alias("_orders"),
        F.sum("quantity").alias("_units"), F.sum("returned").alias("_back"))
    by_category = sold.join(store.products.select("product_id", "category"), "product_id").groupBy("category").agg(
        F.sum("_net").alias("_net"), F.sum("_orders").alias("orders"),
        F.sum("_units").alias("units"), F.sum("_back").alias("_back"))
    return by_category.select(
        "category", as_double(F.col("_net"), 2).alias("net_revenue"), "orders", "units",
        percent(F.col("_back"), F.col("orders")).alias("return_rate_pct")
    ).orderBy(F.desc("net_revenue"), "category")


def top_category_share(categories: DataFrame) -> DataFrame:
    """Share of the strongest category in the sum of all."""
    everything = F.sum(F.col("net_revenue").cast("decimal(28,2)")).over(overall())
    return (categories.select("category", "net_revenue", F.round(ratio(F.col("net_revenue"), everything), 6).alias("share"))
            .orderBy(F.desc("net_revenue"), "category").limit(1).select("category", "share"))


def category_return_alert(categories: DataFrame, kpis: DataFrame) -> DataFrame:
    """Categories that return more than the store does, highest first."""
    return (categories.select("category", "return_rate_pct",
                              kpis.select("return_rate_pct").scalar().alias("store_rate_pct"))
            .where(F.col("return_rate_pct") > F.col("store_rate_pct"))
            .orderBy(F.desc("return_rate_pct"), "category"))


def store_return_rate(store: Store) -> DataFrame:
    """The one figure of the headline row that the return alert needs, without its joins."""
    return store.lines.agg(percent(F.sum("returned"), F.count("returned")).alias("return_rate_pct"))


def city_dashboard(store: Store) -> DataFrame:
    """Net revenue and customers per city; customers whose orders all came back are included."""
    spent = store.orders.groupBy("customer_id").agg(total(kept_amount()).alias("_net"))
    return (spent.join(store.customers.select("customer_id", "city"), "customer_id").groupBy("city")
            .agg(as_double(F.sum("_net"), 2).alias("net_revenue"),
                 F.count_distinct("customer_id").alias("customers"))
            .orderBy(F.desc("net_revenue"), "city"))


def best_selling_products(store: Store, k: int = 5) -> DataFrame:
    sold = store.lines.groupBy("product_id").agg(
        F.sum(F.col("quantity") * (1 - F.col("returned"))).alias("units_sold"),
        total(kept_amount()).alias("_net"))
    named = sold.join(store.products.select("product_id", "product_name", "category"), "product_id")
    return (named.select("product_id", "product_name", "category", "units_sold",
                         as_double(F.col("_net"), 2).alias("net_revenue"))
            .orderBy(F.desc("net_revenue"), "product_id").limit(k))


def top_customers_dashboard(store: Store, k: int = 5) -> DataFrame:
    spent = store.orders.groupBy("customer_id").agg(
        F.sum(1 - F.col("returned")).alias("orders"), total(kept_amount()).alias("_net"))
    return named_top(store, spent.select("customer_id", "orders", as_double(F.col("_net"), 2).alias("total_spending")), k)


def review_mood(store: Store) -> DataFrame:
    """Share of negative, neutral and positive ratings per category; a review without a rating does not count."""
    rating = F.col("rating")
    bands = {"negative": rating <= 2, "neutral": rating == 3, "positive": rating >= 4}
    rated = store.reviews.where(rating.isNotNull()).groupBy("product_id").agg(
        F.count("*").alias("_n"),
        *[F.sum(F.when(test, 1).otherwise(0)).alias(f"_{name}") for name, test in bands.items()])
    by_category = rated.join(store.products.select("product_id", "category"), "product_id").groupBy("category").agg(
        F.sum("_n").alias("reviews"), *[F.sum(f"_{name}").alias(f"_{name}") for name in bands])
    return by_category.select(
        "category", *[percent(F.col(f"_{name}"), F.col("reviews")).alias(f"{name}_pct") for name in bands],
        "reviews").orderBy(F.desc("negative_pct"), "category")


def money_labels(categories: DataFrame) -> DataFrame:
    """Category revenue as the short text that a tile shows."""
    return categories.select("category", magnitude(F.col("net_revenue")).alias("net_revenue_text"))
