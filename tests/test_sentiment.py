import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows
from fixtures import store
from storelens.operators import softmax, tfidf
from storelens.plans import sentiment
from storelens.sources import models

STRESS = ["Very satisfied, quality feels premium.", "Would not buy again, packaging was damaged.",
          "quality bohat kharab thi", "I love it", "It broke after two days", "Not bad at all, I really liked it"]


def template_reviews():
    good = ["Very satisfied, quality feels premium.", "Good value for money, very satisfied.", "Quality feels premium, good value.",
            "Very good value, feels premium."]
    bad = ["Would not buy again, packaging was damaged.", "Packaging was damaged, quality bohat kharab thi.",
           "Would not buy again, bohat kharab.", "Quality was kharab, would not buy."]
    plain = ["It does the job, packaging was average.", "Average quality, does the job.", "It is average overall.",
             "Does the job, average overall."]
    data = []
    for rating, texts in ((5, good), (1, bad), (3, plain)):
        for n, text in enumerate(texts):
            data += [(rating, text)] * (n + 1 if rating != 5 else 6 * (n + 1))
    return [(i, 1, rating, text, None) for i, (rating, text) in enumerate(data)]


@pytest.fixture(scope="module")
def labelled(spark):
    return sentiment.sentiment_labels(store(spark, reviews=template_reviews()))


def test_distribution_lists_absent_labels(spark, labelled):
    only = labelled.where("sentiment = 'Positive'")
    assert rows(sentiment.sentiment_distribution(only)) == [
        ("Negative", 0, 0.0), ("Neutral", 0, 0.0), ("Positive", 60, 100.0)]


def test_text_checks(labelled):
    assert rows(sentiment.text_duplication(labelled)) == [(80, 12, 68, 85.0)]
    # four reviews say it with "thi" or "kharab": weights 2, 3 and 4
    assert rows(sentiment.language_marker_share(labelled)) == [(9, 11.3)]
    assert rows(sentiment.most_repeated_texts(labelled, 1)) == [("Very good value, feels premium.", 24)]


@pytest.mark.parametrize("kind", ["unique", "boilerplate", "mixed", "nulls"])
def test_most_repeated_texts_fetches_few(spark, monkeypatch, kind):
    """Ties of any number are settled by their next characters; no more than k and TIED texts are fetched."""
    rng = random.Random(8)
    if kind == "unique":
        texts = [f"{rng.random()} text" for _ in range(900)]
    elif kind == "boilerplate":
        texts = ["Dear shop, " * 20 + f"{k:04d}" for k in range(700)] + ["Dear shop, " * 20]
    elif kind == "mixed":
        texts = [f"word {k}" for k in range(300) for _ in range(3)] + ["a"] * 9 + ["b"] * 9 + [f"one {k}" for k in range(500)]
    else:
        texts = [None] * 4 + ["", "x", "x", "y"]
    labelled = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id int, review_text string").repartition(3)
    monkeypatch.setattr(sentiment, "TIED", 20)
    fetched = []
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: fetched.append(len(data)) or make(self, data, *a, **b))
    for k in (1, 3, 7):
        counts = Counter(texts)
        wanted = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]
        assert rows(sentiment.most_repeated_texts(labelled, k)) == wanted
        assert fetched.pop() <= k + 20
    assert rows(sentiment.most_repeated_texts(labelled.limit(0), 3)) == []


def test_text_checks_read_reviews_without_a_rating(spark):
    texts = sentiment.sentiment_labels(store(spark, reviews=[(1, 1, 5, "good", None), (2, 1, None, "good", None)]))
    assert rows(sentiment.text_duplication(texts)) == [(2, 1, 1, 50.0)]
    assert rows(sentiment.most_repeated_texts(texts)) == [("good", 2)]
    assert rows(texts.select("review_id", "sentiment").orderBy("review_id")) == [(1, "Positive"), (2, None)]
    assert sentiment.rated(texts).count() == 1


def test_split_keeps_copies_together(labelled):
    split = sentiment.sentiment_split(labelled)
    assert rows(sentiment.split_leakage(split)) == [(0,)]
    assert split.groupBy("review_text").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    leaked = split.withColumn("split", F.when(F.col("review_id") % 2 == 0, "train").otherwise("test"))
    assert rows(sentiment.split_leakage(leaked))[0][0] > 0


def reference_weights(texts, train, min_df=2):
    """TF-IDF of word and pair lists, by hand."""
    import re

    def grams(text):
        w = re.findall(r"\b[a-z]{2,}\b", text.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    df = {}
    for text in train:
        for g in set(grams(text)):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items() if n >= min_df}
    out = []
    for text in texts:
        g = grams(text)
        raw = {t: (1 + math.log(g.count(t))) * idf[t] for t in set(g) if t in idf}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / length for t, v in raw.items()})
    return out, idf


def test_tfidf(labelled):
    data = [(r.review_id, r.review_text, r.split) for r in sentiment.sentiment_split(labelled).orderBy("review_id").collect()]
    expected, idf = reference_weights([t for _, t, _ in data], [t for _, t, s in data if s == "train"])
    found = {}
    for r in sentiment.review_tfidf(labelled).collect():
        found.setdefault(r.review_id, {})[r.term] = r.weight
    for (key, _, _), weights in zip(data, expected):
        assert found.get(key, {}) == pytest.approx(weights)
    assert rows(sentiment.vocabulary_size(labelled)) == [(len(idf),)]


def test_weights_of_a_text_with_most_of_the_reviews(spark):
    texts = ["good good value"] * 3000 + [f"good value item {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    labelled = sentiment.sentiment_labels(store(spark, reviews=[(i, 1, 5, t, None) for i, t in enumerate(texts)]))
    weights = sentiment.review_tfidf(labelled)
    per_review = weights.groupBy("review_id").agg(F.count("*").alias("n"), F.sum(F.col("weight") ** 2).alias("l"))
    hot = per_review.where("review_id < 3000")
    assert hot.count() == 3000 and rows(hot.select("n").distinct()) == [(4,)]
    assert per_review.agg(F.min("l"), F.max("l")).first() == pytest.approx((1.0, 1.0))


def softmax_fit(x, y, k, weight):
    """Penalised multinomial regression by plain gradient descent with line search."""
    from itertools import count
    w = np.zeros((k, x.shape[1] + 1))
    design = np.column_stack([x, np.ones(len(x))])
    target = np.eye(k)[y]

    def loss(w):
        z = design @ w.T
        z = z - z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        return 0.5 * (w[:, :-1] ** 2).sum() - (weight * np.log(p[np.arange(len(y)), y])).sum(), p

    step = 1.0
    value, p = loss(w)
    for n in count():
        g = ((p - target) * weight[:, None]).T @ design
        g[:, :-1] += w[:, :-1]
        if np.abs(g).max() < 1e-7 or n > 20000:
            return w
        while True:
            trial, q = loss(w - step * g)
            if trial <= value - 0.3 * step * (g * g).sum() or step < 1e-12:
                break
            step /= 2
        w, value, p, step = w - step * g, trial, q, step * 2


def test_model_matches_a_direct_fit(spark, labelled, tmp_path):
    model = sentiment.sentiment_model(labelled)
    texts = [r.review_text for r in labelled.orderBy("review_id").collect()]
    y = np.array([sentiment.SENTIMENTS.index(r.sentiment) for r in labelled.orderBy("review_id").collect()])
    vectors, idf = reference_weights(texts, texts)
    terms = sorted(idf)
    x = np.array([[v.get(t, 0.0) for t in terms] for v in vectors])
    weight = np.array([len(y) / (3 * (y == c).sum()) for c in y])
    w = softmax_fit(x, y, 3, weight)

    asked = spark.createDataFrame(list(enumerate(STRESS + ["   ", texts[0]])), "review_id int, review_text string")
    scored = by_key(model.score(asked), "review_id")
    assert sorted(scored) == [0, 1, 2, 3, 4, 5, 7]  # blank text is not scored
    import re
    for i, text in list(enumerate(STRESS)) + [(7, texts[0])]:
        g = re.findall(r"\b[a-z]{2,}\b", text.lower())
        g += [f"{a} {b}" for a, b in zip(g, g[1:])]
        raw = np.array([(1 + math.log(g.count(t))) * idf[t] if t in g else 0.0 for t in terms])
        length = math.sqrt((raw ** 2).sum())
        z = w @ np.append(raw / length if length else raw, 1.0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        found = [scored[i][f"p_{c.lower()}"] for c in sentiment.SENTIMENTS]
        assert found == pytest.approx(list(p), abs=2e-3)
        assert sum(found) == pytest.approx(1.0) and scored[i]["confidence"] == max(found)
    assert [scored[i]["predicted"] for i in (0, 1, 2)] == ["Positive", "Negative", "Negative"]

    models.save_sentiment(model, str(tmp_path / "m"))
    again = by_key(models.load_sentiment(spark, str(tmp_path / "m")).score(asked), "review_id")
    assert {k: v["predicted"] for k, v in again.items()} == {k: v["predicted"] for k, v in scored.items()}

    predicted = model.score(labelled).join(labelled.select("review_id", "sentiment"), "review_id")
    meta = sentiment.sentiment_metadata(predicted).first()
    assert meta.test_metrics.accuracy == 1.0 and meta.labels.Neutral == "rating 3"


def test_two_classes_only(spark, labelled):
    model = sentiment.sentiment_model(labelled.where("sentiment <> 'Neutral'"))
    out = model.score(labelled.where("review_id < 3")).first()
    assert out.p_neutral == 0.0 and out.predicted == "Positive"


def test_model_is_the_minimum(spark, labelled):
    """Not only near it: weights are those of a direct fit to five digits, in few passes over the texts."""
    passes = []
    make = softmax.Products.__call__
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(softmax.Products, "__call__", lambda self, x: passes.append(1) or make(self, x))
        model = sentiment.sentiment_model(labelled)
    data = labelled.orderBy("review_id").collect()
    texts, y = [r.review_text for r in data], np.array([sentiment.SENTIMENTS.index(r.sentiment) for r in data])
    vectors, idf = reference_weights(texts, texts)
    terms = sorted(idf)
    x = np.array([[v.get(t, 0.0) for t in terms] for v in vectors])
    w = softmax_fit(x, y, 3, np.array([len(y) / (3 * (y == c).sum()) for c in y]))
    found = by_key(model.terms, "term")
    assert sorted(found) == terms
    for i, t in enumerate(terms):
        assert [found[t][c] for c in sentiment.SENTIMENTS] == pytest.approx(list(w[:, i]), abs=2e-5)
        assert found[t]["idf"] == pytest.approx(idf[t])
    assert list(model.intercepts.values()) == pytest.approx(list(w[:, -1] - w[:, -1].mean()), abs=2e-4)
    assert len(passes) < 60


def test_products_of_blocks(spark):
    """Blocks together multiply by the inner products of all terms; a text without a known term has none."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"], 7)) for _ in range(40)] + ["unheard", ""]
    counts = tfidf.term_counts(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "text_id int, review_text string, train_copies bigint"))
    vectors, idf = reference_weights(texts, texts)
    terms = sorted(idf)
    x = np.array([[v.get(t, 0.0) for t in terms] for v in vectors])
    for characters in (1, 9 * softmax.BLOCK_CHARACTERS):
        packed = softmax.blocks(counts, characters, len(texts), 2)
        products = softmax.Products(packed, len(texts))
        numbers = rng.normal(size=(len(texts), 3))
        assert np.allclose(products(numbers), x @ x.T @ numbers)
        found = by_key(softmax.term_weights(packed, numbers * products.scale, ["a", "b", "c"]), "term")
        assert np.allclose([[found[t][c] for c in "abc"] for t in terms], x.T @ numbers)
        products.release()


def test_every_review_is_learned_from(spark, labelled, monkeypatch):
    def refuse(*_):
        raise AssertionError("reviews were drawn")
    monkeypatch.setattr(sentiment, "drawn", refuse)
    assert sentiment.sentiment_model(labelled).terms.count() > 0


def test_weights_exchange_distinct_terms_of_blocks(spark, monkeypatch):
    """Terms of one text don't travel on their own, whatever blocks are cut; null, blank and repeated texts keep their place."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], 12)) for _ in range(50)]
    data = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[:9])] + [(200, None), (201, ""), (202, "x"), (None, texts[0]), (None, "gg aa")]
    labelled = spark.createDataFrame(data, "review_id bigint, review_text string").repartition(3)
    monkeypatch.setattr(tfidf, "find_package", lambda _: None)
    train = [t for _, t in data if t is not None and rows(spark.createDataFrame([(t,)], "t string").select(sentiment.in_train(F.col("t"))))[0][0]]
    expected, idf = reference_weights([t or "" for _, t in data], train)
    wanted = sorted(((k, term, round(w, 9)) for (k, _), own in zip(data, expected) for term, w in own.items()), key=str)
    for size in (1, 40, 1 << 21):
        monkeypatch.setattr(tfidf, "BLOCK_TERMS", size)
        weights = sentiment.review_tfidf(labelled)
        assert sorted(((k, t, round(w, 9)) for k, t, w in rows(weights)), key=str) == wanted
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and plan.count("Generate inline") == 2
