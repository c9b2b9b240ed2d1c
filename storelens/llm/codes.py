"""Vector codes by product quantisation in integers, nearest entries found by slicing and intersecting bitmasks.

A vector is cut into parts, each with a codebook that is learned in rounds: assign every part to its nearest
entry, then move each entry to the mean of its parts. Everything is integer arithmetic, so the result does not depend
on the order or the number of tasks.

The nearest entry is found without measuring all. For every dimension the entries' coordinates are sorted, with
a bitmask per prefix of that order. The distance to some entry is an initial radius; no nearer entry differs by
more in any dimension. Two searches in a dimension give the range of entries within the radius, and the
exclusive or of two prefix masks gives that range as a mask. The masks of all dimensions, ANDed, leave the
entries of the box around the part, among them every nearest one; only these are measured.
"""
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.integers import LONG, as_long, by_size, finite, floors, matrix
from storelens.operators.durable import durable

_ISQRT = np.frompyfunc(isqrt, 1, 1)
#: Integers below this in size: sums of squares of up to 2**17 dimensions fit 64 bits.
NARROW = 2.0**21


@dataclass(frozen=True)
class CodeParameters:
    """``entries`` per codebook, at most 256; ``scale``, a power of two: integers are floor(scale * x)."""
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def bounds(self, size: int) -> list[int]:
        """Where parts begin and end; of equal length where ``parts`` divides the size."""
        return [k * size // self.parts for k in range(self.parts + 1)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return (apart * apart).sum(axis=1)


class Slices:
    """Nearest entry of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, dims = entries.shape
        self.words = -(-k // 64)
        place = np.zeros((k, self.words), np.uint64)
        place[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(entries, self.order, axis=0)
        self.prefix = [np.concatenate([np.zeros((1, self.words), np.uint64),
                                       np.bitwise_or.accumulate(place[self.order[:, j]], axis=0)]) for j in range(dims)]
        spread = self.coordinates[-1] - self.coordinates[0]
        self.widest = int(spread.argmax()) if dims else 0

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ by ``radius`` at most in every dimension."""
        found = np.full((len(parts), self.words), ~np.uint64(0))
        for j, prefix in enumerate(self.prefix):
            coordinates = self.coordinates[:, j]
            low = np.searchsorted(coordinates, parts[:, j] - radius, "left")
            high = np.searchsorted(coordinates, parts[:, j] + radius, "right")
            found &= prefix[high] ^ prefix[low]
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part, the lowest index if several are."""
        n, dims = parts.shape
        if not dims:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        # The neighbour in the dimension that tells entries apart best gives the radius.
        at = np.searchsorted(self.coordinates[:, self.widest], parts[:, self.widest])
        guess = self.order[np.minimum(at, len(self.entries) - 1), self.widest]
        squares = _squares(parts, self.entries[guess])
        radius = np.sqrt(squares).astype(np.int64) + 1 if parts.dtype != object else _ISQRT(squares)
        masks = self.candidates(parts, radius)
        best, index = squares.copy(), guess.astype(np.int64)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            if len(rows):
                squares = _squares(parts[rows], self.entries[e])
                nearer = (squares < best[rows]) | ((squares == best[rows]) & (e < index[rows]))
                best[rows[nearer]], index[rows[nearer]] = squares[nearer], e
        return index, best


Codebooks = dict[int, list[np.ndarray]]


def _same_kind(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers, or both as Python's."""
    return (parts, entries) if parts.dtype == entries.dtype else (parts.astype(object), entries.astype(object))


def _assigned(vectors: np.ndarray, books: list[np.ndarray], p: CodeParameters) -> Iterator[tuple]:
    """(part, its integers, entry, squared distance) for each part position."""
    bounds = p.bounds(vectors.shape[1])
    for part, book in enumerate(books):
        own, entries = _same_kind(vectors[:, bounds[part]:bounds[part + 1]], book)
        yield part, own, *Slices(entries).nearest(own)


def _integers(rows: list[list[int]]) -> np.ndarray:
    found = np.array(rows, object)
    if not found.size:
        return np.zeros((len(rows), 0), np.int64)
    return found.astype(np.int64) if max(abs(int(found.max())), abs(int(found.min()))) < NARROW else found


def _first(rows: DataFrame, size: int, n: int) -> list[np.ndarray]:
    """The vectors of the ``n`` smallest ids; an id that repeats counts once, with its smallest vector."""
    found, last = {}, None
    own = rows.where((F.size("v") == size) & F.col("vec_id").isNotNull())
    while len(found) < n:
        more = (own if last is None else own.where(F.col("vec_id") > last)).orderBy("vec_id", "v").limit(n).collect()
        if not more:
            break
        for row in more:
            found.setdefault(row["vec_id"], row["v"])
            last = row["vec_id"]
    return [np.array(found[k], np.float64) for k in sorted(found)[:n]]


def _sums(rows: DataFrame, books: Codebooks, p: CodeParameters) -> DataFrame:
    """(size, part, entry, position, limb, total, count): sums in pieces of 32 bits, the highest one signed."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list] = {}
        for batch in batches:
            for size, at in by_size(batch, "v"):
                if size not in books:
                    continue
                vectors = floors(matrix(batch.column("v").take(pa.array(at))), p.scale, NARROW)
                for part, own, index, _ in _assigned(vectors, books[size], p):
                    for e in np.unique(index):
                        rows_of = own[index == e]
                        total = totals.setdefault((size, part, int(e)), [0, [0] * own.shape[1]])
                        total[0] += len(rows_of)
                        total[1] = [a + int(b) for a, b in zip(total[1], rows_of.sum(axis=0))]
        out = []
        for (size, part, e), (count, total) in totals.items():
            for position, value in enumerate(total):
                limb = 0
                while not -(1 << 31) <= value < 1 << 31:
                    out.append((size, part, e, position, limb, value & 0xffffffff, count))
                    value, limb = value >> 32, limb + 1
                out.append((size, part, e, position, limb, value, count))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*out)], names=names)

    names = ["size", "part", "entry", "position", "limb", "total", "count"]
    found = rows.select("v").mapInArrow(per_task, ", ".join(f"{n} bigint" for n in names))
    # Only limb 0 is there for every position of every task.
    return found.groupBy(*names[:5]).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))


def learned(rows: DataFrame, p: CodeParameters) -> Codebooks:
    """Codebooks for each size of the vectors ``v``, from all rows. What comes to the driver is as large as they are."""
    books: Codebooks = {}
    for row in rows.select(F.size("v").alias("size")).distinct().collect():
        first = _first(rows, row["size"], p.entries)
        if first:
            whole = floors(np.stack(first), p.scale, NARROW).tolist()
            bounds = p.bounds(row["size"])
            books[row["size"]] = [_integers([v[bounds[k]:bounds[k + 1]] for v in whole]) for k in range(p.parts)]
    for _ in range(p.rounds if books else 0):
        sums: dict[tuple, list[int]] = {}
        for r in _sums(rows, books, p).collect():
            total = sums.setdefault((r["size"], r["part"], r["entry"], r["position"]), [0, 0])
            total[0] += r["total"] << 32 * r["limb"]
            total[1] = max(total[1], r["count"])
        moved = {size: [book.tolist() for book in parts] for size, parts in books.items()}
        for (size, part, e, position), (total, count) in sums.items():
            moved[size][part][e][position] = total // count
        books = {size: [_integers(book) for book in parts] for size, parts in moved.items()}
    return books


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


def coded(vectors: DataFrame, p: CodeParameters = CodeParameters(), id_column: str = "vec_id", vector: str = "embedding",
          label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector.

    ``code``: the entry of each part, two hex digits each. ``error``: squared distances to these entries, summed.
    ``label_error``: errors summed over the rows of one label, null labels together. Rows whose vector is null
    or has a null or non-finite component are left out. Vectors of different sizes share nothing: each size has
    codebooks of its own, started from its own smallest ids. If a size is no multiple of the parts, these differ in
    length by one at most; vectors without components have code 00... and no error. A null id starts no entry but is coded;
    if a size has only such rows they have no code. Integers are exact at any size; an error beyond a long
    counts as the largest one. Ties go to the lower entry, repeated rows count each. Other columns are not read.
    """
    rows = durable(vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
                   .where(finite("v")))
    books = learned(rows, p)
    digests = {size: digest_of(parts) for size, parts in books.items()}

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at in by_size(batch, "v"):
                own = batch.take(pa.array(at))
                codes = errors = digest = [None] * len(at)
                if size in books:
                    found = list(_assigned(floors(matrix(own.column("v")), p.scale, NARROW), books[size], p))
                    codes = [bytes(code).hex() for code in np.stack([index for _, _, index, _ in found], axis=1).astype(np.uint8)]
                    errors = [as_long(e) for e in sum(squares for *_, squares in found)]
                    digest = [digests[size]] * len(at)
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("label"), pa.array(codes, pa.string()),
                     pa.array(errors, pa.int64()), pa.array(digest, pa.string())],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(rows.dtypes)
    found = durable(rows.mapInArrow(per_task, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, "
                                              "error bigint, codebooks_sha256 string"))
    per_label = found.groupBy(F.col("label").alias("l")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return (found.join(per_label, F.col("label").eqNullSafe(F.col("l")))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
