"""Saving fitted models and reading them back."""
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from storelens.functions.labels import SENTIMENTS
from storelens.operators.scoring import Scorecard
from storelens.plans.sentiment import SentimentModel


def save_pipeline(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_pipeline(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)


def save_scorecard(spark: SparkSession, card: Scorecard, folder: str) -> None:
    spark.range(1).select(F.lit(card.to_json()).alias("value")).write.mode("overwrite").text(folder)


def load_scorecard(spark: SparkSession, folder: str) -> Scorecard:
    return Scorecard.from_json(spark.read.text(folder, wholetext=True).first().value)


def save_sentiment(model: SentimentModel, folder: str) -> None:
    """The term table as Parquet and, beside it, one row of intercepts."""
    model.terms.write.mode("overwrite").parquet(f"{folder}/terms")
    spark = model.terms.sparkSession
    spark.range(1).select(*[F.lit(model.intercepts[c]).alias(c) for c in SENTIMENTS]) \
        .write.mode("overwrite").parquet(f"{folder}/intercepts")


def load_sentiment(spark: SparkSession, folder: str) -> SentimentModel:
    row = spark.read.parquet(f"{folder}/intercepts").first()
    return SentimentModel(spark.read.parquet(f"{folder}/terms"), {c: row[c] for c in SENTIMENTS})
