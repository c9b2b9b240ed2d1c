"""Texts as UTF-8 bytes in numpy arrays: words, word hashes and shingles of whole Arrow batches.

Everything works on the flat byte buffer that Arrow hands over. A batch is cut into slices of at most
``SLICE_BYTES`` (a longer text is a slice of its own), which bounds the arrays a task holds.
"""
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WRAP = 1 << 64


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more entry than texts).

    A null text counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.type != kind:
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else kind).cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [first, last) of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def texts_in(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, starts) for each slice of the column ``name``."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(name)))
    for first, last in slices(offsets):
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def _inverse(odd: int) -> int:
    return pow(odd, -1, _WRAP)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    base = np.full(size, BASE, np.uint64)
    back = np.full(size, np.uint64(_inverse(int(BASE))), np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    up, down = _powers(size) if size <= 4 * SLICE_BYTES else _powers.__wrapped__(size)
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, shifted by :func:`powers`, are polynomial hashes of substrings."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: What separates words when only letters and digits count; bytes of other scripts are letters here.
NOT_ALNUM = ~byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, starts: np.ndarray, separators: np.ndarray = WHITE):
    """Begin, end and hash of every word (A-Z as a-z), and where each text's words begin."""
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = span_hashes(prefix_sums(LOWER[data]), begin, end)
    return begin, end, hashes, np.searchsorted(begin, starts)


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        out = mixed((out ^ hashes[j:j + n]) * BASE + np.uint64(j))
    return out


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of ``width`` words.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    _, _, hashes, at = words(data, starts)
    runs = chained(hashes, width)
    for first, last in zip(at[:-1], at[1:], strict=True):
        if last - first >= width:
            yield np.unique(runs[first:last - width + 1])
        elif last > first:
            yield chained(hashes[first:last], last - first)
        else:
            yield np.empty(0, np.uint64)
