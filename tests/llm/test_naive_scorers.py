"""Quality and language against models recomputed word by word in plain Python, and shards bucket by bucket."""
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import entries, language, quality, shards
from storelens.llm.textbytes import BASE

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def hashed(text):
    total, power = 0, 1
    for c in text:
        total, power = (total + (ord(c) + 1) * power) & MASK, power * int(BASE) & MASK
    return mixed((total + len(text)) & MASK)


def words_of(text, inside):
    """Runs of characters that ``inside`` holds for."""
    return [w for w in "".join(c if inside(c) else "\n" for c in text).split("\n") if w]


def grams(word, size):
    return [word[k:k + size] for k in range(len(word) - size + 1)]


@pytest.fixture(scope="module")
def docs(spark, small):
    odd = [(10_001, None), (10_002, ""), (10_003, "  \n"), (10_004, "12 34 -- 漢字 ÀÉ"), (10_005, "naïve naïve x y"), (10_006, "!!! ???"),
           (10_007, "wort " * 3000)]
    base = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text", "lang")
    return base.unionByName(spark.createDataFrame([(i, t, None) for i, t in odd], "doc_id bigint, text string, lang string")).cache()


def test_quality_scores_by_hand(spark, small, docs):
    labelled = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    model = quality.learn(labelled.where(~entries.held_out()), quality.QualityParameters(epochs=2))
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}

    def bucket(h, kind):
        return mixed(h + kind & MASK) >> 64 - model.p.bits

    for row in docs.collect():
        words = words_of(row.text or "", lambda c: not c.isspace())
        used = [bucket(hashed(w), 0) for w in words]
        used += [bucket(hashed(g), size) for w in words for size in model.p.grams for g in grams(w, size)]
        used += [bucket(hashed(b) - hashed(a) & MASK, 1) for a, b in zip(words, words[1:])]
        odds = sum(model.weight[b] for b in used) / max(1, len(used)) + model.bias
        assert found[row.doc_id] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9), row.doc_id


def test_languages_by_hand(docs):
    p = language.LanguageParameters(words=150, grams=90)
    model = language.learn(docs, p)
    texts = [(r.doc_id, (r.text or "").lower(), r.lang) for r in docs.collect()]
    languages = sorted({lang for _, t, lang in texts if lang is not None})
    counts = defaultdict(Counter)  # (size, hash) -> language -> times
    for _, text, lang in texts:
        if lang is not None:
            for word in words_of(text, str.isalpha):
                counts[0, hashed(word)][lang] += 1
                for size in range(1, p.longest + 1):
                    for g in grams(word, size):
                        counts[size, hashed(g)][lang] += 1
    tables = {}
    for size in range(p.longest + 1):
        # Hashes sort as signed numbers in the table that is cut.
        own = sorted(((-sum(c.values()), h - (1 << 64) if h >> 63 else h, c) for (s, h), c in counts.items() if s == size),
                     key=lambda x: x[:2])[:p.grams if size else p.words]
        smooth = {h & MASK: [c[lang] + p.smoothing for lang in languages] for _, h, c in own}
        sums = [sum(v[k] for v in smooth.values()) for k in range(len(languages))]
        tables[size] = {h: [math.log(x / total) for x, total in zip(v, sums)] for h, v in smooth.items()}
        assert set(model.tables[size][0].tolist()) == set(tables[size])
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    for doc_id, text, _ in texts:
        words, scored = words_of(text, str.isalpha), []
        for word in words:
            known = [tables[0][hashed(word)]] if hashed(word) in tables[0] else []
            for size in range(p.longest, 0, -1):
                if not known:
                    known = [tables[size][hashed(g)] for g in grams(word, size) if hashed(g) in tables[size]]
            if known:
                scored.append([sum(x) / len(known) for x in zip(*known)])
        if not words:
            assert found[doc_id] == ("und", 0.0)
            continue
        total = [sum(x) * min(len(scored), p.evidence) / len(scored) for x in zip(*scored)] if scored else [0.0] * len(languages)
        chances = [math.exp(t - max(total)) for t in total]
        best = chances.index(max(chances))
        assert found[doc_id][0] == languages[best]
        assert found[doc_id][1] == pytest.approx(max(chances) / sum(chances), abs=1e-6)


def test_shards_bucket_by_bucket(spark, small):
    """Buckets recomputed one by one: scatter by hash, fixed order, Fisher-Yates, cut into shards."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    p = shards.Sharding(bucket_bytes=20_000)
    rows = docs.withColumn("key", F.xxhash64(F.lit(p.seed), F.col("doc_id").cast("string"), F.col("text"))).collect()
    size = sum(len((r.text or "").encode()) + p.overhead for r in rows)
    buckets = max(1, -(-size // p.bucket_bytes))
    assert buckets > 10
    by = defaultdict(list)
    for r in rows:
        by[r.key % buckets].append(r)
    whole = []
    for bucket in range(buckets):
        own = sorted(by[bucket], key=lambda r: (r.key, r.doc_id))
        order = list(range(len(own)))
        picks = np.random.default_rng([p.seed, bucket]).integers(0, np.arange(1, len(own) + 1)) if own else []
        for i in range(len(own) - 1, 0, -1):
            order[i], order[picks[i]] = order[picks[i]], order[i]
        whole += [own[i] for i in order]
    starts = [s * len(whole) // p.shards for s in range(p.shards + 1)]
    wanted = {(whole[k].doc_id, s, k - starts[s]) for s in range(p.shards) for k in range(starts[s], starts[s + 1])}
    assert {(r.doc_id, r.shard, r.slot) for r in shards.shuffled(docs, p).collect()} == wanted
