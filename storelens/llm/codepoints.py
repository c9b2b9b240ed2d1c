"""Texts as code points in numpy arrays: words, their hashes and character n-grams, for a slice of texts at a time."""
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from storelens.llm.textbytes import prefix_sums, slices, span_hashes


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def visible() -> np.ndarray:
    """Which code points are not white space."""
    return np.fromiter((not chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


class Slice:
    """Some consecutive texts. ``at`` says where each text's words begin among all words."""

    def __init__(self, texts: list[str], inside: np.ndarray):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        n = len(self.codes)
        member = inside[self.codes]
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        before = np.append(False, member[:-1])[:n]
        after = np.append(member[1:], False)[:n]
        self.begin = np.flatnonzero(member & (~before | edge[:n]))
        self.end = np.flatnonzero(member & (~after | edge[1:])) + 1
        self.sums = prefix_sums(self.codes)
        self.words = span_hashes(self.sums, self.begin, self.end)
        self.at = np.searchsorted(self.begin, self.starts)

    def grams(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all character n-grams within the given words, and where each word's begin."""
        many = np.maximum(self.end[words] - self.begin[words] - size + 1, 0)
        bounds = np.append(0, np.cumsum(many))
        place = np.repeat(self.begin[words] - bounds[:-1], many) + np.arange(bounds[-1])
        return span_hashes(self.sums, place, place + size), bounds

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text; ``values`` has a row for each word."""
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def text_slices(column: pa.Array, inside: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Slice]]:
    """(first row, last row, slice) over a column of texts; a null text is empty."""
    texts = [t or "" for t in column.to_pylist()]
    if lower:
        texts = [t.lower() for t in texts]
    sizes = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    for first, last in slices(sizes, 1 << 19):
        yield first, last, Slice(texts[first:last], inside)
