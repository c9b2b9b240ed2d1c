"""A corpus pipeline in five stages: each takes (spark, docs, sf_dir) and works on all that the one before kept."""
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import bpe, language, leaks, minhash, suffixes
from storelens.llm.entries import held_out, importable, vocabulary
from storelens.operators.durable import durable

#: A document stays if its language is this likely.
LEAST_SCORE = 0.5
#: What counts as a repeated passage: over 50 words, or 400 bytes where words are long or not set apart.
REPEATS = suffixes.Repeats(length=400, anchor=100, words=51)
#: Settings of the session from the first stage on: rows and bytes of an Arrow batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(stage):
    """Rows go to Python in batches of a few megabytes: with workers and heap of all stages, that is what bounds an executor."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for setting, most in BATCH.items():
            spark.conf.set(setting, most)
        return stage(spark, docs, sf_dir)
    return importable(run)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language can be told. Learns from the labelled documents of the learning folds."""
    model = language.learn(docs.where(~held_out()))
    found = language.predict(docs, model, language_column="__lang", score_column="__score")
    return found.where((F.col("__lang") != language.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).drop(
        "__lang", "__score")


def with_row(docs: DataFrame) -> DataFrame:
    """Adds ``__row``, a number of its own for every row: the id, or for rows whose id is null or repeats a number
    above all ids. Only the latter rows are written, so that their numbers stay."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = durable(ids.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__again")))
    alone = F.col("doc_id").cast("bigint")
    if again.isEmpty():
        return docs.withColumn("__row", alone)
    most = docs.agg(F.greatest(F.max("doc_id"), F.lit(0))).first()[0]
    above = durable(docs.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left_semi")
                    .withColumn("__row", F.monotonically_increasing_id() + F.lit(most + 1)))
    once = docs.where("doc_id IS NOT NULL").join(again, F.col("doc_id") == F.col("__again"), "left_anti")
    return once.withColumn("__row", alone).unionByName(above)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8), that of the smallest id. Every
    row is a document, whether its id repeats or not; one without an id stays only if no copy of it has one."""
    rows = with_row(docs)
    groups = (minhash.near_duplicates(rows, id_column="__row").select(F.col("doc_id").alias("__row"), "component_id")
              .join(rows.select("__row", "doc_id"), "__row"))
    kept = groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first")).select("first.__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words, or of 400 bytes or more, that occur twice. Parts of characters that a cut leaves go, and so do texts
    of which nothing is left."""
    found = suffixes.repeated_spans(docs, REPEATS, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    whole = F.col("kept_text").isNull()
    left = (found.withColumn("text", F.coalesce("kept_text", "text")).where(whole | (F.trim("text") != ""))
            .withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))))
    return left.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark. Items under 8 words count where they occur word by word.
    A row without an id is a document of its own."""
    rows = with_row(docs)
    found = leaks.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks.EVERY_ITEM, id_column="__row")
    return rows.join(found.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed, little-endian) and whether they decode to its text."""
    found = bpe.encode_decode(docs, vocabulary(), carry=["text"])
    return found.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [("language", small_batches(identify_language)), ("near_duplicates", small_batches(drop_near_duplicates)),
          ("repeats", small_batches(cut_repeats)), ("decontamination", small_batches(decontaminate)),
          ("tokens", small_batches(tokenize))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs


#: Suffix arrays, near-duplicate components and merges go beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None
