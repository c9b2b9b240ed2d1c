"""Review sentiment: labels, text checks, split, TF-IDF and a multinomial model."""
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.hashing import digest_number, drawn
from storelens.functions.labels import SENTIMENTS, sentiment_of
from storelens.functions.money import percent
from storelens.functions.text import mentions, strip, words
from storelens.operators.durable import durable
from storelens.operators.metrics import class_report
from storelens.operators.ranking import numbered
from storelens.operators import softmax, tfidf
from storelens.sources.store import Store

# Roman Urdu words that mark a mixed-language review.
MARKERS = ["hai", "thi", "bohat", "theek", "kharab", "mili", "nikla"]

# Join keys over which the reviews of a text are spread when scores go back to them.
PARTS = 16


def sentiment_labels(store: Store) -> DataFrame:
    """Every review; one without a rating has no sentiment."""
    rating = F.col("rating")
    return store.reviews.select("review_id", "rating", "review_text",
                                F.when(rating.isNotNull(), sentiment_of(rating)).alias("sentiment"))


def rated(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("sentiment").isNotNull())


def _counts(labelled: DataFrame, classes: list[str]) -> list[Column]:
    return [F.count(F.when(F.col("sentiment") == c, 1)).alias(c) for c in classes]


def sentiment_distribution(labelled: DataFrame) -> DataFrame:
    """Reviews per label in the fixed order; a label without reviews has a row as well."""
    totals = labelled.agg(*_counts(labelled, SENTIMENTS), F.count("sentiment").alias("_all"))
    entries = F.array(*[F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("reviews")) for c in SENTIMENTS])
    return totals.select("_all", F.inline(entries)).select(
        "sentiment", "reviews", percent(F.col("reviews"), F.col("_all")).alias("percent"))


def text_duplication(labelled: DataFrame) -> DataFrame:
    """How many reviews repeat a text. Copies merge map-side, texts travel as digests."""
    copies = labelled.groupBy(tfidf.text_key(F.col("review_text")).alias("_text")).agg(F.count("*").alias("_n"))
    sums = copies.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count("_text").alias("unique_texts"))
    repeated = F.col("total") - F.col("unique_texts")
    return sums.select("total", "unique_texts", repeated.alias("repeated"),
                       percent(repeated, F.col("total"), 1).alias("repeated_pct"))


def language_marker_share(labelled: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    marked = F.sum(F.when(mentions(F.col("review_text"), markers), 1).otherwise(0))
    return labelled.agg(F.coalesce(marked, F.lit(0)).alias("rows_with_marker"),
                        percent(marked, F.count("*"), 1).alias("share_pct"))


#: Characters by which equally frequent texts are compared at a time, and how many of them are fetched at most.
PREFIX, TIED = 64, 256


def most_repeated_texts(labelled: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent texts; the smaller text first among equals.

    Copies are counted by digest, with the first characters of the text. The k-th row by count and these characters
    is the bound: what comes before it is in, and texts that tie with it, however many, are counted again by
    their next characters until few are left. So ``k`` and ``TIED`` texts are fetched at most, also where no text repeats.
    """
    text = F.col("review_text")
    keyed = labelled.select("review_text", tfidf.text_key(text).alias("_text"))
    known, pieces, chosen = F.lit(True), 0, None
    while True:
        piece = F.substring(text, pieces * PREFIX + 1, PREFIX)
        counts = durable(keyed.where(known).groupBy("_text").agg(F.count("*").alias("n"), F.min(piece).alias("piece")))
        if chosen is not None:
            counts = counts.where(F.col("n") == n)
        wanted = k if chosen is None else k - len(chosen)
        first = counts.orderBy(F.desc("n"), "piece").limit(wanted).collect()
        n, last = (first[-1]["n"], first[-1]["piece"]) if first else (0, None)
        chosen = (chosen or []) + [r for r in first if r["n"] > n or r["piece"] != last]
        tied = counts.where((F.col("n") == n) & F.col("piece").eqNullSafe(F.lit(last))).limit(TIED + 1).collect() if first else []
        if len(tied) <= TIED:
            break
        known = known & (piece == F.lit(last))
        pieces += 1
    chosen += tied
    few = labelled.sparkSession.createDataFrame([(r["_text"], r["n"]) for r in chosen], "_text binary, n bigint")
    # Bounded by k and TIED, so each task can have them all.
    return (keyed.join(F.broadcast(few), keyed["_text"].eqNullSafe(few["_text"]))
            .groupBy(keyed["_text"]).agg(F.first("review_text").alias("review_text"), F.first("n").alias("n"))
            .select("review_text", "n").orderBy(F.desc("n"), "review_text").limit(k)) if chosen else \
        labelled.select("review_text", F.lit(0).cast("bigint").alias("n")).limit(0)


def review_tokens(labelled: DataFrame) -> DataFrame:
    return labelled.select("review_id", words(F.col("review_text")).alias("tokens"))


def in_train(text: Column) -> Column:
    """All copies of a text fall on the same side; four fifths of the texts are for training."""
    return digest_number(text) % 100 < 80


def sentiment_split(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("split", F.when(in_train(F.col("review_text")), "train").otherwise("test"))


def split_leakage(split: DataFrame) -> DataFrame:
    """Test reviews whose text occurs in training: must be none.

    Both sides are reduced to one row per text (by digest) before they meet, so a text with
    very many copies is a single row in the join.
    """
    keyed = split.select("split", tfidf.text_key(F.col("review_text")).alias("_text"))
    test = keyed.where(F.col("split") == "test").groupBy("_text").agg(F.count("*").alias("_n"))
    train = keyed.where(F.col("split") == "train").select("_text").distinct()
    return test.join(train, "_text", "left_semi").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("overlap"))


def split_label_mix(split: DataFrame) -> DataFrame:
    """Share of each label within train and within test."""
    sides = ["train", "test"]
    totals = split.agg(
        *[F.count(F.when((F.col("split") == s) & (F.col("sentiment") == c), 1)).alias(f"{s}_{c}")
          for s in sides for c in SENTIMENTS],
        *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in sides])
    entries = F.array(*[
        F.struct(F.lit(c).alias("sentiment"),
                 *[percent(F.col(f"{s}_{c}"), F.col(s)).alias(f"{s}_pct") for s in sides]) for c in SENTIMENTS])
    return totals.select(F.inline(entries))


def review_tfidf(labelled: DataFrame, min_df: int = 2) -> DataFrame:
    """Weights per review and term. Vocabulary and frequencies come from training reviews only.

    Texts are weighed once each, however many reviews share them.
    """
    return tfidf.review_weights(labelled, in_train(F.col("review_text")), min_df)


def vocabulary_size(labelled: DataFrame, min_df: int = 2) -> DataFrame:
    texts = durable(tfidf.distinct_texts(labelled, in_train(F.col("review_text"))))
    return tfidf.vocabulary(texts, min_df).agg(F.count("*").alias("vocabulary_size"))


@dataclass(frozen=True)
class SentimentModel:
    """Terms with their idf and one weight per class, and the class intercepts."""
    terms: DataFrame
    intercepts: dict[str, float]

    def score(self, texts: DataFrame, key: str = "review_id", text: str = "review_text") -> DataFrame:
        """Class probabilities, predicted class and confidence for every text that is not blank, by ``key``.

        Each distinct text is scored once: its terms meet the term table, and the products
        are summed per text. A text without a known term is left with the intercepts. Scores go
        back by the text's digest; its reviews are spread over ``PARTS`` keys, which costs that
        many copies of a few numbers per text.
        """
        asked = texts.where(strip(F.col(text)) != "").select(
            key, F.col(text).alias("review_text"), tfidf.text_key(F.col(text)).alias("text_id"))
        distinct = tfidf.distinct_texts(asked, F.lit(False))
        hits = tfidf.term_counts(distinct).join(self.terms, "term").select(
            "text_id", ((1.0 + F.ln(F.col("n").cast("double"))) * F.col("idf")).alias("raw"), *SENTIMENTS)
        sums = hits.groupBy("text_id").agg(
            F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_length"),
            *[F.sum(F.col("raw") * F.col(c)).alias(c) for c in SENTIMENTS])
        parts = F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))
        spread = asked.select(key, "text_id", F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("_part"))
        scored = spread.join(sums.withColumn("_part", F.explode(parts)), ["text_id", "_part"], "left")
        margins = {c: F.lit(self.intercepts[c]) + F.coalesce(F.col(c) / F.col("_length"), F.lit(0.0))
                   for c in SENTIMENTS}
        top = F.greatest(*margins.values())
        shifted = {c: F.exp(m - top) for c, m in margins.items()}
        total = sum(shifted.values(), F.lit(0.0))
        probability = {c: shifted[c] / total for c in SENTIMENTS}
        best = F.greatest(*probability.values())
        label = F
        for c in SENTIMENTS:
            label = label.when(F.col(f"p_{c.lower()}") == F.col("confidence"), c)
        return (scored.select(key, best.alias("confidence"),
                              *[p.alias(f"p_{c.lower()}") for c, p in probability.items()])
                .select(key, label.alias("predicted"), *[f"p_{c.lower()}" for c in SENTIMENTS], "confidence"))


def sentiment_model(train: DataFrame, min_df: int = 2, iterations: int = 2000,
                    fit_reviews: int | None = None) -> SentimentModel:
    """Fit on reviews with a sentiment. Classes weigh the same in total.

    Reviews that share a text are one training row weighted by their number. The weights of the terms stay with the
    executors (``operators/softmax.py``); the driver holds some numbers per distinct text. All reviews are learned
    from, or about ``fit_reviews`` if given, drawn by the digest of their id.
    """
    train = rated(train) if fit_reviews is None else drawn(rated(train), "review_id", fit_reviews)
    texts = durable(train.groupBy(tfidf.text_key(F.col("review_text")).alias("_key"), "review_text")
                    .agg(F.count("*").alias("train_copies"), *_counts(train, SENTIMENTS)))
    rows = durable(numbered(texts.withColumn("_digest", F.coalesce(F.hex("_key"), F.lit(""))), "_digest")
                   .select((F.col("position") - 1).cast("int").alias("text_id"), "review_text", "train_copies", *SENTIMENTS))
    totals = rows.agg(F.count("*"), F.sum("train_copies"), F.sum(F.length("review_text"))).first()
    size, reviews, characters = totals[0], totals[1], totals[2] or 0
    packed = softmax.blocks(tfidf.term_counts(rows), characters, reviews, min_df)

    known = rows.select("text_id", *SENTIMENTS).toArrow()
    copies = np.zeros((size, len(SENTIMENTS)))
    for k, c in enumerate(SENTIMENTS):
        copies[known["text_id"].to_numpy(), k] = known[c].to_numpy()
    present = np.flatnonzero(copies.sum(axis=0))
    wanted = copies[:, present] * (reviews / (len(present) * copies.sum(axis=0)[present]))
    products = softmax.Products(packed, size)
    numbers, fitted = softmax.solve(products, wanted, iterations)
    products.release()

    every = np.zeros((size, len(SENTIMENTS)))
    every[:, present] = numbers * products.scale
    intercepts = dict.fromkeys(SENTIMENTS, float("-inf")) | {SENTIMENTS[k]: float(b) for k, b in zip(present, fitted)}
    return SentimentModel(durable(softmax.term_weights(packed, every, SENTIMENTS)), intercepts)


def sentiment_report(predicted: DataFrame, label: str = "sentiment", pred: str = "predicted") -> DataFrame:
    return class_report(predicted, SENTIMENTS, label, pred)


def sentiment_metadata(predicted: DataFrame) -> DataFrame:
    """What a reader of the saved model needs to know, as one row."""
    macro = sentiment_report(predicted).where(F.col("class") == "macro avg")
    return macro.select(
        F.lit("TF-IDF + Logistic Regression").alias("model"),
        F.struct(F.lit("rating 1-2").alias("Negative"), F.lit("rating 3").alias("Neutral"),
                 F.lit("rating 4-5").alias("Positive")).alias("labels"),
        F.struct(F.round("accuracy", 3).alias("accuracy"), F.round("precision", 3).alias("precision_macro"),
                 F.round("recall", 3).alias("recall_macro"), F.round("f1", 3).alias("f1_macro")).alias("test_metrics"),
        F.lit(predicted.sparkSession.version).alias("spark_version"))
