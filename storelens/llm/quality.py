"""Quality of a text by supervised subword embeddings.

Every word, word pair and character n-gram of a text hashes to a row of a table of learned vectors; their
mean is the text's vector, and a softmax layer makes class probabilities of it. Table and layer are trained
together by stochastic gradient descent in numpy on a bounded sample. As scoring is linear up to the
softmax, the trained model folds into one number per table row.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.codepoints import Slice, text_slices, visible
from storelens.llm.textbytes import mixed


@dataclass(frozen=True)
class QualityParameters:
    """``texts``: labelled texts to learn from at most (about). ``bits``: binary logarithm of the table's rows."""
    texts: int = 4096
    bits: int = 16
    width: int = 8
    grams: tuple[int, ...] = (2, 3)
    epochs: int = 12
    rate: float = 0.5
    seed: int = 5


def _bucket(hashes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) >> np.uint64(64 - bits)).astype(np.int64)


def word_features(s: Slice, p: QualityParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word of each word, buckets of all distinct words, where each distinct word's begin, bucket of each
    word pair). A pair is hashed by the difference of its words, so a repeated word has one bucket whatever it is.
    """
    _, first, back = np.unique(s.words, return_index=True, return_inverse=True)
    parts = [(_bucket(s.words[first], 0, p.bits), np.arange(len(first)))]
    for size in p.grams:
        grams, bounds = s.grams(first, size)
        parts.append((_bucket(grams, size, p.bits), np.repeat(np.arange(len(first)), np.diff(bounds))))
    bucket, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    pair = _bucket(s.words[1:] - s.words[:-1], 1, p.bits)
    return back, bucket[order], np.searchsorted(owner[order], np.arange(len(first) + 1)), pair


def _pair_rows(s: Slice) -> np.ndarray:
    """Which word pairs lie within one text."""
    inside = np.ones(max(0, len(s.words) - 1), bool)
    cut = s.at[(s.at > 0) & (s.at < len(s.words))] - 1
    inside[cut] = False
    return inside


class QualityModel:
    def __init__(self, weight: np.ndarray, bias: float, p: QualityParameters):
        """``weight``: what each table row adds to the log odds of the better class."""
        self.weight, self.bias, self.p = weight, bias, p

    def score(self, s: Slice) -> np.ndarray:
        """Probability of the better class of each text; a text without words has the bias alone."""
        back, bucket, bounds, pair = word_features(s, self.p)
        sums = np.append(0.0, np.cumsum(self.weight[bucket]))
        values = np.stack([sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds)], axis=1)[back] if len(back) else \
            np.zeros((0, 2))
        inside = _pair_rows(s)
        values[1:][inside] += np.stack([self.weight[pair[inside]], np.ones(inside.sum())], axis=1)
        total = s.per_text(values)
        odds = total[:, 0] / np.maximum(total[:, 1], 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: QualityParameters) -> QualityModel:
    """Stochastic gradient descent over (buckets, counts) of each text and its label, 0 or 1."""
    rng = np.random.default_rng(p.seed)
    table = rng.normal(0, 1 / p.width, (1 << p.bits, p.width))
    layer, bias = np.zeros((p.width, 2)), np.zeros(2)
    target = np.eye(2)[labels]
    steps, step = p.epochs * len(texts), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            rate = p.rate * (1 - step / steps)
            step += 1
            bucket, count = texts[i]
            share = count / max(1, count.sum())
            mean = share @ table[bucket]
            odds = mean @ layer + bias
            odds = np.exp(odds - odds.max())
            error = odds / odds.sum() - target[i]
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            # Rows of frequent features move with their share; the mean has many rows, so the step is scaled up.
            table[bucket] -= (rate * p.width) * np.outer(share, back)
    better = layer[:, 1] - layer[:, 0]
    return QualityModel(table @ better, float(bias[1] - bias[0]), p)


def learn(docs: DataFrame, p: QualityParameters = QualityParameters(), label: str = "quality", text: str = "text",
          key: str = "doc_id") -> QualityModel:
    """The model of the rows of ``docs`` with a label 0 or 1, from about ``p.texts`` whole texts drawn by the digest
    of ``key``. Null texts count as empty. Without any label every score is one half.
    """
    rows = docs.where(F.col(label).isin(0, 1)).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label"),
        F.xxhash64(F.col(key).cast("string"), F.lit("quality")).alias("draw"))
    n = rows.count()
    share = min(1.0, p.texts / max(1, n))
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, s in text_slices(batch.column("text"), visible(), lower=False):
                back, bucket, bounds, pair = word_features(s, p)
                inside = _pair_rows(s)
                for a, b in zip(s.at[:-1], s.at[1:], strict=True):
                    word, times = np.unique(back[a:b], return_counts=True)
                    many = bounds[word + 1] - bounds[word]
                    at = np.repeat(bounds[word] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                    own = pair[a:max(a, b - 1)][inside[a:max(a, b - 1)]]
                    all_of = np.concatenate([bucket[at], own])
                    count = np.bincount(all_of, np.concatenate([np.repeat(times, many), np.ones(len(own))]),
                                        1 << p.bits)
                    used = np.flatnonzero(count)
                    found.append(used.astype("<u4").tobytes() + count[used].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), batch.column("label"), pa.array(found, pa.binary())],
                names=["draw", "label", "features"])

    table = drawn.select("draw", "label", "text").mapInArrow(
        features, "draw bigint, label int, features binary").toArrow().sort_by("draw")
    texts = []
    for blob in table.column("features").to_pylist():
        k = len(blob) // 8
        texts.append((np.frombuffer(blob, "<u4", k).astype(np.int64), np.frombuffer(blob, "<f4", k, 4 * k)))
    return train(texts, table.column("label").to_numpy(), p)


def score(docs: DataFrame, model: QualityModel, text: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of the better class.

    A null or empty text is scored like one without words. A column of that name is replaced; all others pass.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != score_column]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(s) for _, _, s in text_slices(
                batch.column(batch.schema.get_field_index(text)), visible(), lower=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(rest))), pa.array(np.concatenate([np.empty(0), *scores]))],
                names=[*rest, score_column])

    kept = docs.select(*rest)
    return kept.mapInArrow(per_batch, kept.limit(0).withColumn(score_column, F.lit(0.0)).schema)
