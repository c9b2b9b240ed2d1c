"""Classification metrics as aggregations over (label, score) or (label, pred) rows."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.money import ratio
from storelens.operators.durable import durable
from storelens.operators.ranking import running_totals


def _harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def by_score(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score: ties become one row before any sort.

    The counts are written, because the running totals read them several times. Rows without a score count nowhere.
    """
    return durable(scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))).where(F.col("score").isNotNull())


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score",
                   threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at the threshold, and the area under the ROC curve.

    The area is the rank statistic: each positive counts the negatives below it and half
    of those at the same score. It is null when only one class is present.
    """
    counted = by_score(scored, label, score)
    ranked = running_totals(counted, "score", ["neg"])
    above = F.col("score") >= threshold
    sums = ranked.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("pos").cast("decimal(19,0)") * (2 * F.col("neg_before") + F.col("neg"))).alias("wins2"))
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    return (sums.withColumn("precision", _or_zero(ratio(tp, tp + fp)))
            .withColumn("recall", _or_zero(ratio(tp, p)))
            .select(ratio(tp + n - fp, p + n).alias("accuracy"), "precision", "recall",
                    _or_zero(_harmonic(F.col("precision"), F.col("recall"))).alias("f1"),
                    ratio(F.col("wins2"), 2.0 * p.cast("double") * n.cast("double")).alias("roc_auc")))


def confusion_matrix(predicted: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return predicted.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n"))


def roc_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct threshold, and the origin (with a null threshold)."""
    ranked = running_totals(by_score(scored, label, score), "score", ["pos", "neg"])
    points = ranked.select(
        ratio(F.col("neg_all") - F.col("neg_before"), F.col("neg_all")).alias("fpr"),
        ratio(F.col("pos_all") - F.col("pos_before"), F.col("pos_all")).alias("tpr"),
        F.col("score").alias("threshold"))
    origin = points.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(origin)


def class_report(predicted: DataFrame, classes: list[str], label: str = "label",
                 pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then their plain mean and the accuracy.

    Everything follows from the confusion matrix, which has at most one row per pair of classes.
    """
    matrix = confusion_matrix(predicted, label, pred)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    per_class = matrix.agg(
        F.array(*[F.struct(F.lit(c).alias("class"),
                           total((F.col("label") == c) & (F.col("pred") == c)).alias("hit"),
                           total(F.col("label") == c).alias("support"),
                           total(F.col("pred") == c).alias("guessed")) for c in classes]).alias("_c"),
        total(F.col("label") == F.col("pred")).alias("_right"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    rated = per_class.select("_right", "_all", F.posexplode("_c").alias("_at", "_e")).select(
        "_right", "_all", "_at", F.col("_e.class").alias("class"),
        _or_zero(ratio(F.col("_e.hit"), F.col("_e.guessed"))).alias("precision"),
        _or_zero(ratio(F.col("_e.hit"), F.col("_e.support"))).alias("recall"),
        F.col("_e.support").alias("support"))
    rated = rated.withColumn("f1", _or_zero(_harmonic(F.col("precision"), F.col("recall"))))
    rows = rated.select("class", "precision", "recall", "f1", "support", F.lit(None).cast("double").alias("accuracy"))
    macro = rated.agg(
        F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
        ratio(F.max("_right"), F.max("_all")).alias("accuracy"))
    return rows.unionByName(macro)
