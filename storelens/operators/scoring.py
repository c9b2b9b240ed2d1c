"""Churn scoring with a linear scorecard: a fitted model written out as numbers.

The probability is one column expression, so scoring runs inside whole-stage code
generation next to the aggregation that feeds it, and every push can be read off.
"""
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.labels import DRIVER_NAMES, decision, relabel, risk_band, RISK_ADVICE
from storelens.operators.features import NUMERIC_FEATURES


@dataclass(frozen=True)
class Scorecard:
    """Median, mean, deviation and weight per numeric feature; a weight per membership."""
    intercept: float
    median: dict[str, float]
    mean: dict[str, float]
    deviation: dict[str, float]
    weight: dict[str, float]
    membership_weight: dict[str, float] = field(default_factory=dict)

    def scaled(self, feature: str) -> Column:
        """Standardised value, with the training median in place of null."""
        value = F.coalesce(F.col(feature).cast("double"), F.lit(self.median[feature]))
        return (value - F.lit(self.mean[feature])) / F.lit(self.deviation[feature] or 1.0)

    def push(self, feature: str) -> Column:
        return self.scaled(feature) * F.lit(self.weight[feature])

    def log_odds(self) -> Column:
        """Unknown memberships add nothing."""
        total = F.lit(self.intercept)
        for feature in NUMERIC_FEATURES:
            total = total + self.push(feature)
        if self.membership_weight:
            chain = F
            for name, weight in self.membership_weight.items():
                chain = chain.when(F.col("membership_type") == name, F.lit(weight))
            total = total + chain.otherwise(F.lit(0.0))
        return total

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Scorecard":
        return Scorecard(**json.loads(text))


def score(features: DataFrame, card: Scorecard) -> DataFrame:
    """Add churn_probability, risk and value_at_risk."""
    return (features.withColumn("churn_probability", card.probability())
            .withColumn("risk", risk_band(F.col("churn_probability")))
            .withColumn("value_at_risk", F.col("churn_probability") * F.col("total_spending")))


def predict(rows: DataFrame, card: Scorecard) -> DataFrame:
    """Probability, risk, decision and advice for rows that hold the model's features.

    A return rate given in percent (``return_rate_pct``) is taken as a fraction.
    """
    if "return_rate_pct" in rows.columns:
        rows = rows.withColumn("return_rate", F.col("return_rate_pct") / 100.0)
    p = F.col("churn_probability")
    return (rows.withColumn("churn_probability", card.probability())
            .withColumns({"risk": risk_band(p), "prediction": decision(p)})
            .withColumn("action", relabel(F.col("risk"), RISK_ADVICE)))


def explain(rows: DataFrame, card: Scorecard, k: int = 4) -> DataFrame:
    """The ``k`` numeric features that push each customer's score most, with their push.

    The seven candidates of a customer are ranked inside its own row, without a shuffle.
    """
    pushes = F.array(*[F.struct((-F.abs(card.push(f))).alias("_order"), F.lit(i).alias("_tie"),
                                F.lit(DRIVER_NAMES[f]).alias("feature"), card.push(f).alias("push"))
                       for i, f in enumerate(NUMERIC_FEATURES)])
    strongest = F.slice(F.array_sort(pushes), 1, k)
    return (rows.select("customer_id", F.posexplode(strongest).alias("_at", "_e"))
            .select("customer_id", F.col("_e.feature").alias("feature"),
                    F.col("_e.push").alias("push"), (F.col("_at") + 1).alias("rank")))
