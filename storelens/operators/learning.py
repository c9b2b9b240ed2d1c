"""Churn classifiers on Spark ML, with the preparation that the features need."""
import re
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.hashing import digest, drawn
from storelens.operators.durable import durable, release
from storelens.operators.features import NUMERIC_FEATURES
from storelens.operators.forest import Forest, ForestModel, Growth
from storelens.operators.metrics import binary_metrics
from storelens.operators.network import ReluNetwork
from storelens.operators.selection import exact_quantiles, thresholds
from storelens.operators.scoring import Scorecard

SEED = 42


def _side(rows: DataFrame, key: str, label: str, seed: int, shares: list[tuple[int, int]]) -> Column:
    """Which of consecutive shares of its class a row falls into (from 0), in the order of its key's digest.

    A share ends at a fraction of the class. The last digest of each share is selected, which moves no row; what is left is a comparison. Rows that share a
    key stay together.
    """
    mixed = digest(F.col(key), seed)
    found = F
    ends = thresholds(rows, mixed, [label], lambda n: [F.floor(n * part / whole) - 1 for part, whole in shares])
    for (name,), last in ends.items():
        own = F.lit(0)
        for end in last:
            own = own + (mixed > F.lit(end)).cast("int")
        # Classes too small to fill the first shares have fewer ends.
        found = found.when(F.col(label).eqNullSafe(F.lit(name)), own + (len(shares) - len(last)))
    return found.otherwise(len(shares)) if ends else F.lit(len(shares))


def stratified_split(rows: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Add ``split``: four fifths of every class are ``train``, the rest ``test``. ``rows`` is read several times."""
    side = _side(rows, key, label, seed, [(4, 5)])
    return rows.withColumn("split", F.when(side == 0, "train").otherwise("test"))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED + 1) -> DataFrame:
    """Add ``fold`` from 0 to k-1, as equal as possible in every class. ``rows`` is read several times."""
    return rows.withColumn("fold", _side(rows, key, label, seed, [(i, k) for i in range(1, k)]))


class NumericPreparation(Estimator):
    """Learns medians, and means and population deviations when scaling, from its training rows.

    Missing values take the exact median (interpolated between the two middle values);
    a constant feature keeps a deviation of 1. The result is a SQL projection.
    """

    def __init__(self, columns: list[str], scale: bool):
        super().__init__()
        self.columns, self.scale = columns, scale

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        numbers = durable(dataset.select([F.col(c).cast("double").alias(c) for c in self.columns]))
        long = numbers.unpivot([], self.columns, "feature", "value")
        medians = {c: 0.0 for c in self.columns}
        medians.update({r.feature: r.median for r in
                        exact_quantiles(long, "value", {"median": 0.5}, ["feature"]).collect()})
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in self.columns}
        mean, deviation = dict.fromkeys(self.columns, 0.0), dict.fromkeys(self.columns, 1.0)
        if self.scale:
            row = dataset.agg(*[F.avg(v).alias(f"{c}_m") for c, v in filled.items()],
                              *[F.stddev_pop(v).alias(f"{c}_d") for c, v in filled.items()]).first()
            mean = {c: row[f"{c}_m"] for c in self.columns}
            deviation = {c: row[f"{c}_d"] or 1.0 for c in self.columns}
        outputs = ", ".join(
            f"(COALESCE(CAST({c} AS DOUBLE), {medians[c]!r}D) - {mean[c]!r}D) / {deviation[c]!r}D AS {c}_in"
            for c in self.columns)
        return SQLTransformer(statement=f"SELECT *, {outputs} FROM __THIS__")


_PREPARED = re.compile(r"CAST\((\w+) AS DOUBLE\), (\S+)D\) - (\S+)D\) / (\S+)D AS \w+_in")


def preparation_of(stage: SQLTransformer) -> dict[str, dict[str, float]]:
    """Median, mean and deviation per feature, read from the projection itself, which is all that is saved."""
    found = _PREPARED.findall(stage.getStatement())
    return {name: {f[0]: float(f[i]) for f in found} for i, name in ((1, "median"), (2, "mean"), (3, "deviation"))}


class UnitPenaltyLogistic(Estimator):
    """Logistic regression with the penalty ½‖w‖² against the *sum* of the losses.

    Spark penalises the mean loss, so its parameter is one over the number of training rows.
    """

    def __init__(self, iterations: int = 1000, **params):
        super().__init__()
        self.iterations, self.settings = iterations, params

    def _fit(self, dataset: DataFrame):
        estimator = LogisticRegression(
            maxIter=self.iterations, regParam=1.0 / dataset.count(), elasticNetParam=0.0,
            standardization=False, **self.settings)
        return estimator.fit(dataset)


def _preparation(scale: bool) -> list:
    """Seven numbers, then one column per membership; an unknown membership is all zeros."""
    return [
        NumericPreparation(NUMERIC_FEATURES, scale),
        StringIndexer(inputCol="membership_type", outputCol="membership_index",
                      handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["membership_index"], outputCols=["membership_vector"], dropLast=True),
        VectorAssembler(inputCols=[f"{c}_in" for c in NUMERIC_FEATURES] + ["membership_vector"],
                        outputCol="features"),
    ]


def logistic_pipeline() -> Pipeline:
    return Pipeline(stages=_preparation(scale=True) + [UnitPenaltyLogistic(labelCol="churn")])


def forest_pipeline(trees: int = 300) -> Pipeline:
    return Pipeline(stages=_preparation(scale=False) + [
        Forest("churn", Growth(trees=trees, leaf=5, depth=30, seed=SEED))])


def network_pipeline() -> Pipeline:
    """32 and 16 rectified units, dropout and early stopping."""
    return Pipeline(stages=_preparation(scale=True) + [ReluNetwork(label="churn", key="customer_id")])


def scorecard_of(model: PipelineModel) -> Scorecard:
    """The fitted logistic pipeline as plain numbers; a pipeline read back from disk serves as well."""
    stats, labels = preparation_of(model.stages[0]), model.stages[1].labels
    weights = [float(w) for w in model.stages[-1].coefficients]
    n = len(NUMERIC_FEATURES)
    return Scorecard(
        intercept=float(model.stages[-1].intercept), **stats,
        weight=dict(zip(NUMERIC_FEATURES, weights[:n])),
        membership_weight=dict(zip(labels, weights[n:])))


def with_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with the probability of churn as ``score``."""
    found = model.transform(rows)
    listed = found.schema["probability"].dataType.typeName() == "array"
    chance = F.col("probability") if listed else vector_to_array("probability")
    return (found
            .withColumn("score", chance[1])
            .select(*rows.columns, "score"))


def evaluate(name: str, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """One row of test metrics."""
    metrics = binary_metrics(with_probability(model, rows), "churn", "score")
    return metrics.select(F.lit(name).alias("model"), *metrics.columns)


def fold_areas(name: str, pipeline: Pipeline, train: DataFrame, folds: int, most: int | None = None,
               parallel: int = 2) -> DataFrame:
    """One row per fold: rows fitted on, rows held out, and the area under the curve over all of the latter.

    ``train`` carries a ``fold`` column and is read often; give a written table. Preparation and model are fitted
    anew inside every fold, on about ``most`` rows of the other folds at most, drawn by digest (all, if
    None). What is held out is evaluated whole. ``parallel`` folds at a time: each takes memory of the driver.
    """
    def one(fold: int) -> tuple:
        others, own = train.where(F.col("fold") != fold), train.where(F.col("fold") == fold)
        fitted_on = others if most is None else drawn(others, "customer_id", most)
        fitted, held_out = fitted_on.count(), own.count()
        if not fitted or not held_out:
            return name, fold, fitted, held_out, None
        model = pipeline.fit(fitted_on)
        area = evaluate(name, model, own).first()["roc_auc"]
        if isinstance(model.stages[-1], ForestModel):
            release(model.stages[-1].trees)
        return name, fold, fitted, held_out, area

    with ThreadPool(parallel) as pool:
        rows = pool.map(inheritable_thread_target(train.sparkSession)(one), range(folds))
    return train.sparkSession.createDataFrame(
        rows, "model string, fold int, fitted_rows bigint, held_out_rows bigint, auc double")


def mean_area(areas: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds that have both classes."""
    return areas.groupBy("model").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def model_size(model: PipelineModel) -> int:
    """Weights and intercept, or tree nodes, or network weights."""
    last = model.stages[-1]
    if hasattr(last, "totalNumNodes"):
        return last.totalNumNodes
    if hasattr(last, "weights"):
        return last.weights.size
    return last.coefficients.size + 1


def feature_names(model: PipelineModel) -> list[str]:
    return NUMERIC_FEATURES + [f"membership_type_{name}" for name in model.stages[1].labels]
