"""Business questions on completed (non-returned) orders, and the figures behind the findings.

Facts are summed by their foreign key before a dimension is joined. The join then moves one
row per product or customer, a hot product is already one row, and Spark may broadcast
whichever side it measures to be small.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.dates import month_of, year_earlier
from storelens.functions.money import (as_double, change_percent, gross_amount, kept_amount, net_amount,
                                       percent, ratio, returned_amount, total)
from storelens.sources.store import Store


def overall():
    """All rows as one window, for rows that are already aggregated (categories, cities, months)."""
    return Window.partitionBy(F.lit(0))


def total_net_revenue(store: Store) -> DataFrame:
    gross = gross_amount()
    return store.lines.agg(
        as_double(total(gross), 2).alias("gross_revenue"),
        as_double(total(gross * F.col("discount")), 2).alias("discount_amount"),
        as_double(total(returned_amount()), 2).alias("returned_amount"),
        as_double(total(kept_amount()), 2).alias("net_revenue"))


def _completed(orders: DataFrame, key: str) -> DataFrame:
    return orders.where(F.col("returned") == 0).groupBy(key).agg(
        total(net_amount()).alias("_net"), F.count("order_id").alias("_orders"),
        F.sum("quantity").alias("_units"))


def named_top(store: Store, spent: DataFrame, k: int) -> DataFrame:
    """The ``k`` known customers who spent most, with name and city.

    Names are fetched for the ``k`` rows that are left; before, only ids are joined.
    """
    known = store.customers.select("customer_id")
    top = (spent.join(known, "customer_id", "left_semi")
           .orderBy(F.desc("total_spending"), "customer_id").limit(k))
    people = store.customers.select("customer_id", "customer_name", "city")
    return (people.join(top, "customer_id")
            .select("customer_id", "customer_name", "city", *spent.columns[1:])
            .orderBy(F.desc("total_spending"), "customer_id"))


def top_customers(store: Store, k: int = 10) -> DataFrame:
    spent = _completed(store.orders, "customer_id").select(
        "customer_id", F.col("_orders").alias("number_of_orders"), as_double(F.col("_net"), 2).alias("total_spending"))
    return named_top(store, spent, k)


def category_revenue(store: Store) -> DataFrame:
    """Net revenue, orders, units and revenue share; the share is taken on unrounded sums."""
    sold = _completed(store.lines, "product_id").join(
        store.products.select("product_id", "category"), "product_id")
    by_category = sold.groupBy("category").agg(
        F.sum("_net").alias("_net"), F.sum("_orders").alias("order_count"),
        F.sum("_units").alias("quantity_sold"))
    return by_category.select(
        "category", as_double(F.col("_net"), 2).alias("net_revenue"), "order_count", "quantity_sold",
        percent(F.col("_net"), F.sum("_net").over(overall())).alias("revenue_share_pct")
    ).orderBy(F.desc("net_revenue"), "category")


def _by_month(orders: DataFrame, amount: Column) -> DataFrame:
    """Daily totals first: a day is a bounded key and cheaper to hash than month text."""
    daily = orders.groupBy("order_date").agg(total(amount).alias("_net"), F.count("order_id").alias("_orders"))
    return daily.groupBy(month_of(F.col("order_date")).alias("month")).agg(
        as_double(F.sum("_net"), 2).alias("net_revenue"), F.sum("_orders").alias("order_count"))


def monthly_revenue(store: Store) -> DataFrame:
    """Net revenue per month and its growth, computed on the rounded monthly amounts."""
    monthly = _by_month(store.orders.where(F.col("returned") == 0), net_amount())
    before = F.lag("net_revenue").over(overall().orderBy("month"))
    return (monthly.withColumn("mom_growth_pct", change_percent(F.col("net_revenue"), before))
            .orderBy("month"))


def top_products(store: Store, k: int = 5) -> DataFrame:
    sold = _completed(store.lines, "product_id").join(
        store.products.select("product_id", "product_name", "category", "brand"), "product_id")
    return (sold.select("product_id", "product_name", "category", "brand",
                        F.col("_units").alias("units_sold"), as_double(F.col("_net"), 2).alias("net_revenue"))
            .orderBy(F.desc("net_revenue"), "product_id").limit(k))


def city_revenue(store: Store) -> DataFrame:
    """Net revenue per city and per buying customer; the share is taken on rounded amounts."""
    spent = _completed(store.orders, "customer_id").join(
        store.customers.select("customer_id", "city"), "customer_id")
    by_city = spent.groupBy("city").agg(
        F.sum("_net").alias("_net"), F.count_distinct("customer_id").alias("customers"),
        F.sum("_orders").alias("orders"))
    net = as_double(F.col("_net"), 2)
    return by_city.select(
        "city", net.alias("net_revenue"), "customers", "orders",
        F.round(ratio(F.col("_net"), F.col("customers")), 0).alias("revenue_per_customer"),
        percent(net, F.sum(F.round("_net", 2)).over(overall())).alias("revenue_share_pct")
    ).orderBy(F.desc("net_revenue"), "city")


def city_value_top5(cities: DataFrame, k: int = 5) -> DataFrame:
    return (cities.select("city", "customers", "revenue_per_customer")
            .orderBy(F.desc("revenue_per_customer"), "city").limit(k))


def return_rate_by_category(store: Store) -> DataFrame:
    """Over all orders: how many came back, and what they were worth."""
    sold = store.lines.groupBy("product_id").agg(
        F.count("order_id").alias("_orders"), F.sum("returned").alias("_back"),
        total(returned_amount()).alias("_value"))
    by_category = sold.join(store.products.select("product_id", "category"), "product_id").groupBy("category").agg(
        F.sum("_orders").alias("total_orders"), F.sum("_back").alias("returned_orders"),
        F.sum("_value").alias("_value"))
    return by_category.select(
        "category", "total_orders", "returned_orders",
        percent(F.col("returned_orders"), F.col("total_orders")).alias("return_rate_pct"),
        as_double(F.col("_value"), 2).alias("returned_value")
    ).orderBy(F.desc("return_rate_pct"), "category")


def overall_return_rate(rates: DataFrame) -> DataFrame:
    """Each category beside the rate of the whole store."""
    store_rate = ratio(100.0 * F.sum("returned_orders").over(overall()), F.sum("total_orders").over(overall()))
    return (rates.withColumn("_overall", store_rate)
            .select("category", "return_rate_pct", F.round("_overall", 6).alias("overall_return_rate"),
                    (F.col("return_rate_pct") > F.col("_overall")).alias("above_overall")))


def monthly_peak(months: DataFrame) -> DataFrame:
    """Month with the highest net revenue, the earliest of equals."""
    return months.select("month", "net_revenue").orderBy(F.desc("net_revenue"), "month").limit(1)


def _total(df: DataFrame, column: str) -> Column:
    """Sum of a money column as a one-value subquery, added up in decimals."""
    return df.agg(F.sum(F.col(column).cast("decimal(28,2)"))).scalar()


def category_concentration(revenue: DataFrame, rates: DataFrame, category: str) -> DataFrame:
    """Share of the strongest category, and what returns of ``category`` cost of all returns."""
    top = revenue.orderBy(F.desc("net_revenue"), "category").limit(1)
    value = rates.where(F.col("category") == category).select("returned_value")
    return (top.select(F.col("category").alias("top_category"), F.col("revenue_share_pct").alias("top_share_pct"),
                       value.scalar().alias("returned_value"), _total(rates, "returned_value").alias("_all"))
            .withColumn("pct_of_returned_value", percent(F.col("returned_value"), F.col("_all")))
            .drop("_all"))


def category_return_ratio(rates: DataFrame, category: str) -> DataFrame:
    """Return rate of one category as a multiple of the store's rate."""
    store_rate = rates.agg(ratio(100.0 * F.sum("returned_orders"), F.sum("total_orders"))).scalar()
    return (rates.where(F.col("category") == category).withColumn("_overall", store_rate)
            .select("category", "return_rate_pct", F.round("_overall", 6).alias("overall_return_rate"),
                    F.round(ratio(F.col("return_rate_pct"), F.col("_overall")), 4).alias("ratio")))


def city_concentration(cities: DataFrame) -> DataFrame:
    """Share of the two strongest cities, and the city whose customers spend most."""
    by_net = overall().orderBy(F.desc("net_revenue"), "city")
    sums = cities.withColumn("_place", F.row_number().over(by_net)).agg(
        F.sum(F.when(F.col("_place") <= 2, F.col("revenue_share_pct").cast("decimal(10,2)"))).alias("_share"),
        F.min_by(F.struct("city", "revenue_per_customer"),
                 F.struct((-F.col("revenue_per_customer")).alias("v"), F.col("city"))).alias("_best"),
        F.sum(F.col("net_revenue").cast("decimal(28,2)")).alias("_net"), F.sum("customers").alias("_customers"))
    mean = ratio(F.col("_net"), F.col("_customers"))
    best = F.col("_best.revenue_per_customer")
    return sums.select(
        as_double(F.col("_share")).alias("top2_share_pct"), F.col("_best.city").alias("best_city"),
        best.alias("best_revenue_per_customer"), F.round(mean, 2).alias("avg_revenue_per_customer"),
        F.round(100.0 * (ratio(best, mean) - 1.0), 2).alias("pct_above_avg"))


def growth_summary(months: DataFrame) -> DataFrame:
    """Last month against the month before and against the same month one year earlier."""
    in_order = overall().orderBy("month")
    lagged = months.withColumn("prev_month", F.lag("month").over(in_order))
    last = lagged.orderBy(F.desc("month")).limit(1).withColumn("yoy_month", year_earlier(F.col("month")))
    base = months.select(F.col("month").alias("yoy_month"), F.col("net_revenue").alias("_base"))
    return (last.join(base, "yoy_month", "left")
            .select(F.col("month").alias("last_month"), "prev_month", "mom_growth_pct",
                    F.when(F.col("_base").isNotNull(), F.col("yoy_month")).alias("yoy_month"),
                    change_percent(F.col("net_revenue"), F.col("_base")).alias("yoy_growth_pct")))
