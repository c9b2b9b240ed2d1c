"""Benchmark passages in training texts, found by spaced seeds.

A passage counts as leaked if ``span`` consecutive words of a benchmark item and of a text agree, place by
place, in all but ``misses`` words. The window is cut into ``misses + 2`` blocks, and a mask keeps two of
them and ignores the rest: whatever ``misses`` places differ, at least two blocks are untouched, so one of
the masks hits. Every window of both sides is hashed under every mask, equal hashes are joined, and the
windows around a hit are compared word by word.

An item with fewer words than ``span`` is looked for as a whole. It must agree in every word, or, from ``scaled``
words on, in all but a proportionate number, found by masks over its own length.

The benchmark is taken in blocks of a bounded number of windows. A block's hashes are sent to all tasks, and
each text meets every block; a larger benchmark means more blocks, never more memory.
"""
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.textbytes import BASE, NOT_ALNUM, chained, mixed, texts_in, words

_BITS = 22
#: Letters of scripts that do not set words apart.
_UNSEGMENTED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


@dataclass(frozen=True)
class Seeds:
    """``span`` words of which ``misses`` may differ; items under ``shortest`` words are not looked for.

    ``block`` bounds the benchmark words whose hashes a task holds at a time. ``scaled``: items of so many words and
    more, but fewer than ``span``, may differ in a proportionate number of words; 0 for none. ``by_character``: a
    character of a script that does not set words apart is a word.
    """
    span: int = 13
    misses: int = 2
    shortest: int = 8
    block: int = 200_000
    scaled: int = 0
    by_character: bool = False

    def misses_in(self, size: int) -> int:
        """Words in which an item of fewer words than ``span`` may differ."""
        return size * self.misses // self.span if 0 < self.scaled <= size else 0

    def masks(self) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """Pairs of (first word, words) that a mask keeps."""
        edges = np.linspace(0, self.span, self.misses + 3).astype(int)
        blocks = [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]
        return list(combinations(blocks, 2))


#: Looks for every item that has a word at all.
EVERY_ITEM = Seeds(shortest=1, scaled=8, by_character=True)


def seed_hashes(hashes: np.ndarray, seeds: Seeds) -> Iterator[np.ndarray]:
    """For each mask the hash of every window."""
    n = len(hashes) - seeds.span + 1
    if n <= 0:
        return
    runs: dict[int, np.ndarray] = {}
    for k, ((a, la), (b, lb)) in enumerate(seeds.masks()):
        for size in (la, lb):
            if size not in runs:
                runs[size] = chained(hashes, size)
        yield mixed((runs[la][a:a + n] * BASE) ^ (runs[lb][b:b + n] + np.uint64(k)))


def _words(column: pa.Array, seeds: Seeds) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, where each text's words begin); case does not count."""
    lower = pc.utf8_lower(column)
    if seeds.by_character:
        lower = pc.replace_substring_regex(lower, pattern=_UNSEGMENTED, replacement=r" \1 ")
    lower = pa.RecordBatch.from_arrays([lower], names=["text"])
    for first, last, data, starts in texts_in(lower, "text"):
        _, _, hashes, at = words(data, starts, NOT_ALNUM)
        yield first, last, hashes, at


def benchmark_words(items: DataFrame, seeds: Seeds, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, first, n_words, words): items in pieces of bounded size that overlap by a window."""
    step = 1024

    def per_batch(batches):
        for batch in batches:
            rows = []
            ids = batch.column("item_id").to_pylist()
            for first, last, hashes, at in _words(batch.column("text"), seeds):
                for i in range(first, last):
                    own = hashes[at[i - first]:at[i - first + 1]]
                    if len(own) < seeds.shortest:
                        continue
                    for a in range(0, max(1, len(own) - seeds.span + 1), step):
                        rows.append({"item_id": ids[i], "first": a, "n_words": len(own),
                                     "words": own[a:a + step + seeds.span - 1].view(np.int64)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("item_id", pa.int64()), ("first", pa.int32()), ("n_words", pa.int32()),
                ("words", pa.list_(pa.int64()))]))

    picked = items.select(F.col(id_column).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return picked.where("item_id IS NOT NULL").mapInArrow(
        per_batch, "item_id bigint, first int, n_words int, words array<bigint>")


class _Block:
    """The windows of one block of the benchmark, by hash."""

    def __init__(self, pieces: list, seeds: Seeds):
        self.seeds = seeds
        self.words = [np.array(p["words"], np.int64).view(np.uint64) for p in pieces]
        self.pieces = pieces
        self.tables = [self._table(k) for k in range(len(seeds.masks()))]
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.shorter: list[tuple[np.ndarray, _Block]] = []
        short = [k for k, w in enumerate(self.words) if len(w) < seeds.span]
        for size in sorted({len(self.words[k]) for k in short}):
            own = [k for k in short if len(self.words[k]) == size]
            if seeds.misses_in(size):
                self.shorter.append((np.array(own), _Block([pieces[k] for k in own], replace(
                    seeds, span=size, misses=seeds.misses_in(size)))))
                continue
            value = np.array([chained(self.words[k], size)[0] for k in own], np.uint64)
            order = np.argsort(value, kind="stable")
            self.whole[size] = (value[order], np.array(own)[order])

    def _table(self, mask: int):
        value, piece, place = [], [], []
        for k, own in enumerate(self.words):
            for m, hashes in enumerate(seed_hashes(own, self.seeds)):
                if m == mask:
                    value.append(hashes)
                    piece.append(np.full(len(hashes), k))
                    place.append(np.arange(len(hashes)))
        if not value:
            return None
        value, piece, place = map(np.concatenate, (value, piece, place))
        order = np.argsort(value, kind="stable")
        bits = np.zeros(1 << _BITS, bool)
        bits[(value >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return value[order], piece[order], place[order], bits

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, piece, place in the piece) of verified windows of a run of words, without repeats."""
        seeds = self.seeds
        found = [np.empty((0, 3), np.int64)]
        for value, table in zip(seed_hashes(hashes, seeds), self.tables, strict=False):
            if table is None:
                continue
            known, piece, place, bits = table
            at = np.flatnonzero(bits[(value >> np.uint64(64 - _BITS)).astype(np.int64)])
            low = np.searchsorted(known, value[at], "left")
            many = np.searchsorted(known, value[at], "right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            row = np.repeat(low - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            found.append(np.stack([np.repeat(at, many), piece[row], place[row]], axis=1))
        found = np.unique(np.concatenate(found), axis=0)
        good = []
        for k in np.unique(found[:, 1]):
            rows = found[found[:, 1] == k]
            span = np.arange(seeds.span)
            equal = hashes[rows[:, :1] + span] == self.words[k][rows[:, 2:] + span]
            good.append(rows[equal.sum(axis=1) >= seeds.span - seeds.misses])
        for size, (known, own) in self.whole.items():
            value = chained(hashes, size)
            at = np.flatnonzero(np.isin(value, known))
            low = np.searchsorted(known, value[at], "left")
            many = np.searchsorted(known, value[at], "right") - low
            row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            good.append(np.stack([np.repeat(at, many), own[row], np.zeros(len(row), np.int64)], axis=1))
        for own, block in self.shorter:
            word, piece, place = block.hits(hashes)
            good.append(np.stack([word, own[piece], place], axis=1))
        good = np.concatenate(good) if good else np.empty((0, 3), np.int64)
        return good[:, 0], good[:, 1], good[:, 2]


def leaks(docs: DataFrame, items: DataFrame, seeds: Seeds = Seeds(), id_column: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word): one row per text and item that leaks into it.

    n_windows counts the windows of the text that agree with the item (for each piece of an item over a
    thousand words); first_word and last_word are the outermost words they reach. Words are runs of letters and digits (any byte beyond ASCII counts as a
    letter), in lower case; with ``by_character``, also each character of a script that does not set words apart. Null and empty texts, items without id and items under ``shortest`` words
    leak nowhere. Rows that repeat a document's id are summed up in one row. A document without id has a
    row with a null doc_id. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    pieces = benchmark_words(items, seeds)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // seeds.block)
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in (
        "item_id", "n_windows", "first_word", "last_word")]])
    out = spark.createDataFrame([], schema)
    for b in range(n_blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "first"), F.lit(n_blocks)) == b)
        out = out.unionByName(_scan(picked, [r.asDict() for r in mine.collect()], seeds, schema))
    return out.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"),
                                               F.min("first_word").alias("first_word"),
                                               F.max("last_word").alias("last_word"))


def _scan(docs: DataFrame, pieces: list[dict], seeds: Seeds, schema: T.StructType) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(held.value, seeds)
        item = np.array([p["item_id"] for p in block.pieces], np.int64)
        size = np.array([min(len(w), seeds.span) for w in block.words], np.int64)
        for batch in batches:
            for first, last, hashes, at in _words(batch.column("text"), seeds):
                word, piece, _ = block.hits(hashes)
                if not len(word):
                    continue
                text = np.searchsorted(at, word, "right") - 1
                inside = word + size[piece] <= at[text + 1]
                rows = np.unique(np.stack([text, item[piece], word, word + size[piece]], axis=1)[inside], axis=0)
                if not len(rows):
                    continue
                key, start = np.unique(rows[:, :2], axis=0, return_index=True)
                # A window may agree at several places of an item; it counts once.
                windows = np.add.reduceat(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)).astype(int), start)
                begin = rows[start, 2] - at[rows[start, 0]]
                end = np.maximum.reduceat(rows[:, 3], start) - at[rows[start, 0]] - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(first + key[:, 0])), pa.array(key[:, 1]),
                     pa.array(windows, pa.int64()), pa.array(begin), pa.array(end)],
                    names=["doc_id", "item_id", "n_windows", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(per_task, schema)
