"""Churn: dataset, its checks, split, models, evaluation and metadata."""
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.hashing import drawn
from storelens.functions.money import percent, ratio
from storelens.operators import learning
from storelens.operators.durable import durable
from storelens.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, churn_dataset
from storelens.operators.profiling import as_rows, count_where
from storelens.operators.selection import exact_quantiles
from storelens.plans.business import overall
from storelens.sources.store import Store

LOGISTIC, FOREST, NETWORK = "Logistic Regression", "Random Forest", "Neural Network (32-16)"


def churn_rows(store: Store, cutoff: str, start: str, end: str) -> DataFrame:
    return churn_dataset(store.orders, store.customers, cutoff, start, end)


def class_balance(dataset: DataFrame) -> DataFrame:
    counts = dataset.groupBy("churn").agg(F.count("*").alias("customers"))
    return counts.withColumn("percent", percent(F.col("customers"), F.sum("customers").over(overall())))


def feature_nulls(dataset: DataFrame) -> DataFrame:
    """Columns of the dataset with missing values."""
    totals = dataset.agg(*[count_where(F.col(c).isNull()).alias(f"v{i}") for i, c in enumerate(dataset.columns)])
    return as_rows(totals, [{"column": c} for c in dataset.columns], [], "missing").where(F.col("missing") > 0)


def feature_summary(dataset: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of every numeric column."""
    columns = NUMERIC_FEATURES + ["churn"]
    values = durable(dataset.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    long = values.unpivot([], columns, "feature", "value")
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["feature"])
    return moments.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def churn_split(dataset: DataFrame) -> DataFrame:
    """The dataset with its split. It is written first: splitting and fitting read it many times."""
    return learning.stratified_split(durable(dataset), "customer_id", "churn")


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count("*").alias("n"), F.round(ratio(100.0 * F.sum("churn"), F.count("*")), 2).alias("churn_rate"))


class ChurnStudy:
    """Train and test rows of one dataset, and the models fitted on them.

    Every model is fitted on all training rows, in every fold of a cross-validation as well. Who wants a forest of fewer
    names ``forest_rows``: it then learns from about so many, drawn by digest. Test rows and held-out folds are
    evaluated whole; the training area is that of the rows a model was fitted on.
    """

    pipelines = {LOGISTIC: learning.logistic_pipeline, FOREST: learning.forest_pipeline,
                 NETWORK: learning.network_pipeline}

    def __init__(self, dataset: DataFrame, forest_rows: int | None = None):
        self.rows = durable(churn_split(dataset))
        self.train = self.rows.where(F.col("split") == "train")
        self.test = self.rows.where(F.col("split") == "test")
        self.forest_rows = forest_rows
        self._models: dict[str, PipelineModel] = {}
        self._areas: dict[tuple[str, int], DataFrame] = {}
        self._folds: dict[int, DataFrame] = {}

    def _fitted_on(self, name: str) -> DataFrame:
        if name == FOREST and self.forest_rows is not None:
            return drawn(self.train, "customer_id", self.forest_rows)
        return self.train

    def model(self, name: str) -> PipelineModel:
        if name not in self._models:
            self._models[name] = self.pipelines[name]().fit(self._fitted_on(name))
        return self._models[name]

    def metrics(self, name: str) -> DataFrame:
        return learning.evaluate(name, self.model(name), self.test)

    def fold_areas(self, name: str, folds: int = 5) -> DataFrame:
        """The area under the curve of every fold of the training rows, with the rows on either side."""
        if folds not in self._folds:
            self._folds[folds] = durable(learning.stratified_folds(self.train, "customer_id", "churn", folds))
        if (name, folds) not in self._areas:
            self._areas[name, folds] = learning.fold_areas(
                name, self.pipelines[name](), self._folds[folds], folds, self.forest_rows if name == FOREST else None)
        return self._areas[name, folds]

    def cross_validation(self, name: str, folds: int = 5) -> DataFrame:
        """Mean and deviation of the area under the curve over folds of the training rows."""
        return learning.mean_area(self.fold_areas(name, folds))

    def comparison(self, names: list[str], cross_validated: list[str] | None = None) -> DataFrame:
        """One row per model: test metrics, area on the rows it was fitted on and gap, size.

        Models in ``cross_validated`` also carry their fold results: all but the network,
        unless said otherwise.
        """
        if cross_validated is None:
            cross_validated = [LOGISTIC, FOREST]
        rows = []
        for name in names:
            model = self.model(name)
            fitted_on = learning.evaluate(name, model, self._fitted_on(name))
            row = (self.metrics(name)
                   .join(fitted_on.select("model", F.col("roc_auc").alias("train_auc")), "model")
                   .withColumn("gap", F.col("train_auc") - F.col("roc_auc"))
                   .withColumn("model_size", F.lit(learning.model_size(model)).cast("bigint")))
            if name in cross_validated:
                row = row.join(self.cross_validation(name), "model")
            else:
                row = row.withColumns({c: F.lit(None).cast("double") for c in ("mean_auc", "std_auc")})
            rows.append(row)
        return reduce(DataFrame.unionByName, rows)

    def coefficients(self) -> DataFrame:
        """Weights of the logistic model on scaled features, ascending."""
        model = self.model(LOGISTIC)
        weights = [float(w) for w in model.stages[-1].coefficients]
        pairs = list(zip(learning.feature_names(model), weights))
        return self.train.sparkSession.createDataFrame(
            pairs, "feature string, coefficient double").orderBy("coefficient", "feature")

    def metadata(self, cutoff: str, start: str, end: str) -> DataFrame:
        """What a reader of the saved model needs to know, as one row."""
        metrics = self.metrics(LOGISTIC)
        rounded = F.struct(*[F.round(c, 3).alias(c) for c in metrics.columns if c != "model"])
        memberships = self.rows.agg(F.array_sort(F.collect_set("membership_type"))).scalar()

        def names(values: list[str]):
            return F.array(*[F.lit(v) for v in values])

        return metrics.select(
            "model", names(NUMERIC_FEATURES).alias("numeric_features"),
            names(CATEGORICAL_FEATURES).alias("categorical_features"),
            memberships.alias("membership_types"), F.lit(cutoff).alias("feature_cutoff"),
            names([start, end]).alias("target_window"), rounded.alias("test_metrics"),
            F.lit(self.train.sparkSession.version).alias("spark_version"))
