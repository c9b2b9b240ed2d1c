"""Labels derived from numbers: risk bands, decisions and review sentiment."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk bands, the advice that goes with each, and the names of the drivers.
HIGH, MEDIUM, LOW = "High risk", "Medium risk", "Low risk"
RISK_BANDS = [HIGH, MEDIUM, LOW]
RISK_ADVICE = {
    HIGH: "Call or message now with a personal win-back offer.",
    MEDIUM: "Send a reminder with products they are likely to buy.",
    LOW: "Keep them engaged with normal updates. No discount needed.",
}
DRIVER_NAMES = {
    "total_orders": "Number of orders",
    "total_spending": "Total spending",
    "avg_order_value": "Average order value",
    "days_since_last_order": "Days since last order",
    "return_rate": "Return rate",
    "avg_delivery_days": "Delivery time",
    "age": "Age",
}
SENTIMENTS = ["Negative", "Neutral", "Positive"]


def risk_band(probability: Column) -> Column:
    return (F.when(probability >= 0.7, HIGH)
            .when(probability >= 0.5, MEDIUM)
            .otherwise(LOW))


def decision(probability: Column) -> Column:
    return F.when(probability >= 0.5, "Likely to churn").otherwise("Likely to stay")


def relabel(key: Column, mapping: dict[str, str]) -> Column:
    """Constant lookup as one expression; unknown keys pass through."""
    chain = F
    for old, new in mapping.items():
        chain = chain.when(key == old, F.lit(new))
    return chain.otherwise(key)


def sentiment_of(rating: Column) -> Column:
    return (F.when(rating <= 2, "Negative")
            .when(rating == 3, "Neutral")
            .otherwise("Positive"))
