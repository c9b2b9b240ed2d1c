"""Point-in-time customer features and the churn label."""
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import day
from storelens.functions.money import kept_amount, net_amount, ratio, total

# The model's features, in the order in which it takes them.
NUMERIC_FEATURES = ["total_orders", "total_spending", "avg_order_value", "days_since_last_order",
                    "return_rate", "avg_delivery_days", "age"]
CATEGORICAL_FEATURES = ["membership_type"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
AGGREGATES = NUMERIC_FEATURES[:6]


@dataclass(frozen=True)
class Window:
    """Days from ``start`` to ``end``, both included."""
    start: str
    end: str

    def holds(self, date: Column) -> Column:
        return date.between(day(self.start), day(self.end))


def purchase_sums(orders: DataFrame, until: Column | None = None, window: Window | None = None) -> DataFrame:
    """Sums per customer over the orders up to ``until``, and the orders inside ``window``.

    History and target window come from one aggregation, so orders are read and shuffled
    once. The sums merge map-side: a customer with very many orders is a few rows.
    """
    date = F.col("order_date")
    past = F.lit(True) if until is None else date <= until
    if until is not None:
        orders = orders.where(past if window is None else past | window.holds(date))

    def of_past(value: Column) -> Column:
        return value if until is None or window is None else F.when(past, value)

    net, returned, delivery = net_amount(), F.col("returned"), F.col("delivery_days")
    active = [] if window is None else [F.count(F.when(window.holds(date), 1)).alias("actual_orders")]
    return orders.groupBy("customer_id").agg(
        F.count(of_past(F.lit(1))).alias("_n"), total(of_past(kept_amount())).alias("_kept"),
        total(of_past(net)).alias("_net"), F.count(of_past(net)).alias("_net_n"),
        F.max(of_past(date)).alias("_last"),
        F.sum(of_past(returned)).alias("_back"), F.count(of_past(returned)).alias("_back_n"),
        F.sum(of_past(delivery)).alias("_days"), F.count(of_past(delivery)).alias("_days_n"), *active)


def purchase_history(sums: DataFrame, until: Column) -> DataFrame:
    """Six aggregates per customer with a purchase by ``until``.

    Spending leaves returned orders out; order value and return rate count them.
    """
    extra = [c for c in sums.columns if c == "actual_orders"]
    return sums.where(F.col("_n") > 0).select(
        "customer_id",
        F.col("_n").alias("total_orders"),
        F.col("_kept").cast("double").alias("total_spending"),
        ratio(F.col("_net"), F.col("_net_n")).alias("avg_order_value"),
        F.datediff(until, F.col("_last")).alias("days_since_last_order"),
        ratio(F.col("_back"), F.col("_back_n")).alias("return_rate"),
        ratio(F.col("_days"), F.col("_days_n")).alias("avg_delivery_days"), *extra)


def _with_profile(history: DataFrame, customers: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Orders are aggregated before this join, so it moves one row per customer."""
    profile = customers.select("customer_id", "customer_name", "city", "age", "membership_type", *also)
    extra = [c for c in history.columns if c == "actual_orders"] + list(also)
    return history.join(profile, "customer_id").select(
        "customer_id", "customer_name", "city", *AGGREGATES, "age", "membership_type", *extra)


def customer_features(orders: DataFrame, customers: DataFrame, cutoff: str,
                      window: Window | None = None, also: Sequence[str] = ()) -> DataFrame:
    """History of every customer who ordered by the cutoff day, with profile columns; ``also``: more of them.

    With a window, ``actual_orders`` counts the customer's orders inside it.
    """
    until = day(cutoff)
    return _with_profile(purchase_history(purchase_sums(orders, until, window), until), customers, also)


def latest_features(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Features as of the newest order.

    That day is one scalar, for which the dates alone are read.
    """
    newest = orders.agg(F.max("order_date")).scalar()
    return _with_profile(purchase_history(purchase_sums(orders), newest), customers)


def churn_dataset(orders: DataFrame, customers: DataFrame, cutoff: str, start: str, end: str) -> DataFrame:
    """Features up to the cutoff and ``churn`` = 1 for no order from ``start`` to ``end``.

    A returned order is still activity.
    """
    rows = customer_features(orders, customers, cutoff, Window(start, end))
    return rows.select("customer_id", *AGGREGATES, "age", "membership_type",
                       F.when(F.col("actual_orders") == 0, 1).otherwise(0).alias("churn"))


def orders_in_window(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Orders per customer from ``start`` to ``end``, both days included."""
    return (orders.where(Window(start, end).holds(F.col("order_date")))
            .groupBy("customer_id").agg(F.count("*").alias("orders")))
