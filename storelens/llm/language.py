"""Language of a text, word first: known words by their frequency per language, unseen words by their longest
known character n-grams.

The model is a table of word hashes and one table of n-gram hashes for each length, with the logarithm of
the relative frequency per language. A word that is not in the word table takes the mean over its n-grams
of the greatest length at which any of them is known; a word with none says nothing.
"""
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.codepoints import Slice, letters, text_slices
from storelens.operators.durable import durable

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParameters:
    """``texts``: about so many texts per language to learn from. ``words``, ``grams``: entries of the word table and
    of each n-gram table. ``longest``: letters of the longest n-gram. ``smoothing``: added to every count.
    ``evidence``: a text counts as if it had at most so many words, which keeps the score from saturating.
    """
    texts: int = 2048
    words: int = 40_000
    grams: int = 20_000
    longest: int = 4
    smoothing: float = 0.5
    evidence: int = 16


class LanguageModel:
    """Tables by n-gram length; length 0 is the word table."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], p: LanguageParameters):
        self.languages, self.tables, self.p = languages, tables, p

    def _known(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[size]
        row = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        return (keys[row] == hashes if len(keys) else np.zeros(len(hashes), bool)), row

    def word_scores(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """For each word of a slice its score per language, and whether anything of it is known."""
        hashes, first, back = np.unique(s.words, return_index=True, return_inverse=True)
        scores = np.zeros((len(hashes), len(self.languages)))
        done, row = self._known(0, hashes)
        scores[done] = self.tables[0][1][row[done]]
        for size in range(self.p.longest, 0, -1):
            open_words = np.flatnonzero(~done)
            if not len(open_words):
                break
            grams, bounds = s.grams(first[open_words], size)
            found, row = self._known(size, grams)
            of = np.repeat(np.arange(len(open_words)), np.diff(bounds))[found]
            many = np.bincount(of, minlength=len(open_words))
            hit = many > 0
            for g in range(len(self.languages)):
                total = np.bincount(of, self.tables[size][1][row[found], g], len(open_words))
                scores[open_words[hit], g] = total[hit] / many[hit]
            done[open_words[hit]] = True
        return scores[back], done[back]

    def classify(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """For each text the best language's number (-1: no letter) and its score."""
        scores, known = self.word_scores(s)
        total, many = s.per_text(scores), s.per_text(known.astype(float))
        # A language is read off the mean word, weighed as so many independent words at most.
        total *= (np.minimum(many, self.p.evidence) / np.maximum(many, 1))[:, None]
        total -= total.max(axis=1, keepdims=True)
        weight = np.exp(total)
        best = weight.argmax(axis=1)
        score = weight[np.arange(len(best)), best] / weight.sum(axis=1)
        empty = np.diff(s.at) == 0
        return np.where(empty, -1, best), np.where(empty, 0.0, score)


def learn(docs: DataFrame, p: LanguageParameters = LanguageParameters(), lang: str = "lang", text: str = "text",
          key: str = "doc_id") -> LanguageModel | None:
    """The model of the labelled rows of ``docs``, from about ``p.texts`` whole texts per language drawn by
    the digest of ``key``. Rows with a null language or text are left out; None if nothing is left.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                       F.xxhash64(F.col(key).cast("string"), F.lit("language")).alias("draw")).where(
                           "lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, p.texts / n))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    languages = sorted(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in sorted(set(names)):
                own = batch.filter(pa.array(names == name))
                for _, _, s in text_slices(own.column("text"), letters(), lower=True):
                    everything = np.arange(len(s.words))
                    for size in range(p.longest + 1):
                        hashes = s.grams(everything, size)[0] if size else s.words
                        value, n = np.unique(hashes, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([size] * len(value), pa.int32()), pa.array(value.view(np.int64)),
                             pa.array([name] * len(value)), pa.array(n.astype(np.int64))],
                            names=["size", "hash", "lang", "n"])

    counts = (drawn.mapInArrow(count, "size int, hash bigint, lang string, n bigint")
              .groupBy("size", "hash", "lang").agg(F.sum("n").alias("n"))
              .groupBy("size", "hash").agg(F.sum("n").alias("n"),
                                           F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))
    counts = durable(counts.select("size", "hash", "n", *[F.coalesce(F.col("by")[name], F.lit(0)).alias(f"n{k}")
                                                          for k, name in enumerate(languages)]))
    # Every size keeps its own most frequent ones, each task sending as many at most.
    table = reduce(DataFrame.unionByName, [
        counts.where(F.col("size") == size).orderBy(F.desc("n"), "hash").limit(p.grams if size else p.words)
        for size in range(p.longest + 1)]).toArrow()
    size = table.column("size").to_numpy()
    hashes = table.column("hash").to_numpy().view(np.uint64)
    n = np.stack([table.column(f"n{k}").to_numpy() for k in range(len(languages))], axis=1) if len(table) else \
        np.zeros((0, len(languages)))
    tables = {}
    for s in range(p.longest + 1):
        mine = np.flatnonzero(size == s)
        mine = mine[np.argsort(hashes[mine])]
        count_of = n[mine] + p.smoothing
        tables[s] = hashes[mine], np.log(count_of / count_of.sum(axis=0)) if len(mine) else count_of
    return LanguageModel(languages, tables, p)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", language_column: str = "lang_pred",
            score_column: str = "score") -> DataFrame:
    """``docs`` with two more columns, the language and its score between 0 and 1.

    The score is the posterior of equally likely languages. A null text and a text without a letter are
    ``und`` with score 0, and so is everything without a model. A text with letters of which nothing is
    known gets the first language with a score of one over their number. Columns of those names are
    replaced; all others pass.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (language_column, score_column)]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            names, scores = [], []
            if model is None:
                names, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            else:
                for _, _, s in text_slices(batch.column(batch.schema.get_field_index(text)), letters(), lower=True):
                    best, score = model.classify(s)
                    names += [UNDETERMINED if b < 0 else model.languages[b] for b in best]
                    scores += score.tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(rest))), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], names=[*rest, language_column, score_column])

    kept = docs.select(*rest)
    schema = kept.limit(0).withColumn(language_column, F.lit("")).withColumn(score_column, F.lit(0.0)).schema
    return kept.mapInArrow(per_batch, schema)
