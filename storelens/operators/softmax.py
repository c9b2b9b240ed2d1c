"""Penalised multinomial regression on the term weights of texts, solved over the texts.

The best weights of the terms are a sum over the texts, so the unknowns are one number per text and class, and one
intercept per class; weights of terms, of which there are far more, stay where the terms are. Terms are dealt out to
blocks. Multiplying by the texts' inner products is one job: every block sums the numbers of its terms' texts, and hands
each text what its terms have; blocks are added up. Newton's steps are found by conjugate gradients, each of which is one
such job; their lengths cost none.

The driver and every task hold some vectors of one number per text and class.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.durable import durable
from storelens.operators.workers import find_package

#: Characters of text whose terms make a block, and bytes of sums that the driver adds up by itself.
BLOCK_CHARACTERS, ADDED_HERE = 8 << 20, 64 << 20

_BLOCK = "terms array<string>, idf binary, starts binary, texts binary, raw binary"


def _packed(batches: Iterator[pa.RecordBatch], reviews: int, min_df: int) -> Iterator[pa.RecordBatch]:
    """Rows (term, text_id, n, train_copies) of whole terms as one block of those in ``min_df`` reviews, term by term."""
    terms, columns = [], []
    for batch in batches:
        if batch.num_rows:
            terms.append(batch.column("term").dictionary_encode())
            columns.append([batch.column(c).to_numpy() for c in ("text_id", "n", "train_copies")])
    if not terms:
        return
    chunks = pa.chunked_array(terms).unify_dictionaries().chunks
    place = np.concatenate([c.indices.to_numpy() for c in chunks])
    text, n, copies = map(np.concatenate, zip(*columns))
    df = np.bincount(place, copies, len(chunks[0].dictionary))
    kept = np.flatnonzero(df >= min_df)
    number = np.full(len(df), -1)
    number[kept] = np.arange(len(kept))
    own = np.flatnonzero(number[place] >= 0)
    if not len(own):
        return
    own = own[np.lexsort((text[own], number[place[own]]))]
    place, text, n = number[place[own]], text[own], n[own]
    idf = np.log((1.0 + reviews) / (1.0 + df[kept])) + 1.0
    raw = (1.0 + np.log(n.astype(np.float64))) * idf[place]
    starts = np.searchsorted(place, np.arange(len(kept)))
    words = chunks[0].dictionary.take(pa.array(kept))
    yield pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
         *(pa.array([a.tobytes()], pa.binary()) for a in (idf, starts.astype(np.int64), text.astype(np.int32), raw))],
        names=["terms", "idf", "starts", "texts", "raw"])


def blocks(counts: DataFrame, characters: int, reviews: int, min_df: int) -> DataFrame:
    """The vocabulary with its texts, from rows (text_id, term, train_copies, n); text_id counts from 0."""
    find_package(counts.sparkSession)
    parts = max(counts.sparkSession.sparkContext.defaultParallelism, -(-characters // BLOCK_CHARACTERS))
    return durable(counts.repartition(parts, "term").mapInArrow(lambda b: _packed(b, reviews, min_df), _BLOCK))


def _sums(block: tuple, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per term the sum of its texts' numbers, with the block's arrays."""
    starts, texts, raw = (np.frombuffer(x, t) for x, t in zip(block, (np.int64, np.int32, np.float64)))
    return np.add.reduceat(raw[:, None] * numbers[texts], starts, axis=0), starts, texts, raw


class Products:
    """Multiplies numbers of the texts by the inner products of their unit term weights."""

    def __init__(self, packed: DataFrame, texts: int):
        self.context, self.texts = packed.sparkSession.sparkContext, texts
        self.rows = packed.select("starts", "texts", "raw").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

        def squares(_, texts_: np.ndarray, raw: np.ndarray) -> np.ndarray:
            return np.bincount(texts_, raw * raw, texts)[:, None]

        length = np.sqrt(self._added(lambda block, _: squares(*(np.frombuffer(x, t) for x, t in zip(
            block, (np.int64, np.int32, np.float64)))), 1, None))
        self.scale = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)

    def _added(self, of: Callable, width: int, sent) -> np.ndarray:
        texts = self.texts

        def part(own: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = np.zeros((texts, width))
            for block in own:
                total += of(block, sent)
            yield total

        sums = self.rows.mapPartitions(part)
        many = self.rows.getNumPartitions() * texts * width * 8 > ADDED_HERE
        return sums.treeReduce(np.add) if many else sums.reduce(np.add)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        texts, width = numbers.shape

        def product(block: tuple, sent) -> np.ndarray:
            sums, starts, at, raw = _sums(block, sent.value)
            back = np.repeat(sums, np.diff(starts, append=len(at)), axis=0) * raw[:, None]
            return np.stack([np.bincount(at, back[:, k], texts) for k in range(width)], axis=1)

        sent = self.context.broadcast(numbers * self.scale)
        found = self._added(product, width, sent) * self.scale
        sent.destroy()
        return found

    def release(self) -> None:
        self.rows.unpersist()


def solve(products: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts, intercepts) of least ½‖w‖² + sum of losses, in about ``steps`` products at most.

    ``wanted`` is the weight of each class in each text. Intercepts are not penalised and sum to zero.
    """
    weight, total = wanted.sum(axis=1, keepdims=True), wanted.sum()
    numbers, margins = np.zeros_like(wanted), np.zeros_like(wanted)
    intercepts = np.log(wanted.sum(axis=0) / total)

    def losses(numbers: np.ndarray, margins: np.ndarray, intercepts: np.ndarray) -> float:
        z = margins + intercepts
        top = z.max(axis=1, keepdims=True)
        whole = top + np.log(np.exp(z - top).sum(axis=1, keepdims=True))
        return float((weight * whole).sum() - (wanted * z).sum() + 0.5 * (numbers * margins).sum())

    done, loss = 0, losses(numbers, margins, intercepts)
    while done < steps:
        z = margins + intercepts
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        rest = weight * p - wanted
        down, down_b = -(numbers + rest), -rest.sum(axis=0)
        flow = products(down)
        done += 1
        size = (down * flow).sum() + (down_b**2).sum()
        if size <= 1e-12 * total:
            break
        curved = max((weight * p * (1 - p)).sum() / p.shape[1], 1e-12)

        # Conjugate gradients for the Newton step; intercepts are scaled by their curvature.
        r, r_b, g = down, down_b, flow
        rho = first = (r * g).sum() + (r_b**2).sum() / curved
        d, d_b, d_g = r, r_b / curved, g
        step, step_b, step_g = np.zeros_like(numbers), np.zeros_like(intercepts), np.zeros_like(numbers)
        near = min(0.1, (size / total)**0.5)
        while done < steps:
            s = d_g + d_b
            bent = weight * p * (s - (p * s).sum(axis=1, keepdims=True))
            h, h_b = d + bent, bent.sum(axis=0)
            length = rho / ((d_g * h).sum() + (d_b * h_b).sum())
            step, step_b, step_g = step + length * d, step_b + length * d_b, step_g + length * d_g
            r, r_b = r - length * h, r_b - length * h_b
            g = products(r)
            done += 1
            last, rho = rho, (r * g).sum() + (r_b**2).sum() / curved
            if rho <= near**2 * first:
                break
            d, d_b, d_g = r + rho / last * d, r_b / curved + rho / last * d_b, g + rho / last * d_g
        slope = (down * step_g).sum() + (down_b * step_b).sum()
        part = 1.0
        while True:
            trial = numbers + part * step, margins + part * step_g, intercepts + part * step_b
            now = losses(*trial)
            if now <= loss - 1e-4 * part * slope or part < 1e-6:
                break
            part /= 2
        if now >= loss:
            break
        (numbers, margins, intercepts), loss = trial, now
    return numbers, intercepts - intercepts.mean()


def term_weights(packed: DataFrame, scaled: np.ndarray, classes: list[str]) -> DataFrame:
    """(term, idf, one weight per class) from the texts' numbers, each divided by the length of its text."""
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                sums = _sums(tuple(own.column(c)[0].as_py() for c in ("starts", "texts", "raw")), scaled)[0]
                idf = np.frombuffer(own.column("idf")[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [own.column("terms").flatten(), pa.array(idf), *(pa.array(np.ascontiguousarray(w)) for w in sums.T)],
                    names=["term", "idf", *classes])

    return packed.mapInArrow(weights, ", ".join(["term string, idf double", *(f"{c} double" for c in classes)]))
