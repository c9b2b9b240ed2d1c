"""MinHash near-duplicates, verified in batches by a sequential Bayesian test and then on whole sets.

1. Every text becomes its set of word shingles, a digest of that set, ``bands * rows`` minima and a
   signature that keeps one byte of each minimum. Texts with equal sets are one node from here on,
   so copies cost one row each and nothing else.
2. Nodes that share a band are candidates. Each is first compared with its band's smallest node only,
   which is linear however large a band is.
3. A candidate's signatures are compared batch after batch. It is dropped as soon as the posterior
   probability that its similarity reaches the threshold, given the matches so far and a uniform prior,
   falls below ``miss``. Survivors are compared on their whole sets.
4. Links are joined into components. What is left are bands that still hold nodes of different
   components. Every such pair is compared, in blocks, in the first band that it shares: first by the same test, then
   by sets of 32-bit digests, which can only overrate it. A task joins what it links at once and passes on no
   more links than it takes to span its components; these are verified on whole sets. If one fails, which takes a
   collision of digests at the very threshold, another round looks with other digests.
"""
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.components import components
from storelens.llm.textbytes import flat, mixed, shingle_sets, texts_in
from storelens.operators.durable import durable, release

#: Nodes of a band, and bytes of their digests, that are compared in one block.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Rounds over blocks; a second one is rare.
ROUNDS = 20
_CHUNK = 1 << 17
_PAIRS = 20_000


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. Pairs at the threshold share no band with probability (1 - t^rows)^bands.

    The defaults miss such a pair about once in eight million; ``miss`` bounds the Bayesian test.
    ``batch`` hashes are compared at a time. ``bits`` of a shingle's digest, 32 at most, are compared within blocks.
    """
    width: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    batch: int = 20
    bits: int = 32
    miss: float = 1e-7
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=8)
def _orders(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and masks of ``n`` bijections of 32-bit words, and room for their values."""
    draw = np.random.default_rng(seed).integers(0, 1 << 32, (2, n, 1), np.uint32)
    return draw[0] | np.uint32(1), draw[1], np.empty((n, max(1, _CHUNK // n)), np.uint32)


def minima(shingles: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` minima of a non-empty set of hashes under random orders."""
    factor, mask, room = _orders(n, seed)
    short = shingles.astype(np.uint32)
    step = room.shape[1]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), step):
        part = short[i:i + step]
        at = room[:, :len(part)]
        np.multiply(part, factor, out=at)
        np.bitwise_xor(at, mask, out=at)
        np.minimum(out, at.min(axis=1), out=out)
    return mixed(out.astype(np.uint64))


@lru_cache(maxsize=8)
def least_matches(p: NearDuplicates, hashes: int) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches with which a pair goes on).

    With m of n matches and a uniform prior, P(similarity >= t) is the chance of at most m successes
    in n + 1 draws of t. A byte also matches by accident, once in 256.
    """
    t = p.percent / 100
    t += (1 - t) / 256
    out = []
    for n in [*range(p.batch, hashes, p.batch), hashes]:
        tail, m = 0.0, 0
        while m <= n:
            tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
            if tail >= p.miss:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, p: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of paired signatures: which survive every batch, and all their matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    done = 0
    for n, least in least_matches(p, left.shape[1]):
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        done = n
    return alive, matches[alive]


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), -1)


def _digest(shingles: bytes) -> bytes:
    return blake2b(shingles, digest_size=16).digest()


def signatures(docs: DataFrame, p: NearDuplicates, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, set_id, n_shingles, band, signature) of every row; the last three are empty for an empty set."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, starts in texts_in(batch, "text"):
                digest, size, band, mark = [], [], [], []
                for s in shingle_sets(data, starts, p.width):
                    digest.append(_digest(s.tobytes()))
                    size.append(len(s))
                    if not len(s):
                        band.append([])
                        mark.append(b"")
                        continue
                    low = minima(s, p.hashes, p.seed)
                    rows = low.reshape(p.bands, p.rows)
                    key = np.arange(p.bands, dtype=np.uint64)
                    for j in range(p.rows):
                        key = mixed((key ^ rows[:, j]) + np.uint64(j))
                    band.append(key.view(np.int64))
                    mark.append((low >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(digest, pa.binary()), pa.array(size, pa.int64()),
                     pa.array(band, pa.list_(pa.int64())), pa.array(mark, pa.binary())],
                    names=["doc_id", "set_id", "n_shingles", "band", "signature"])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(
        per_batch, "doc_id bigint, set_id binary, n_shingles bigint, band array<bigint>, signature binary")


def _likely(pairs: DataFrame, marks: DataFrame, p: NearDuplicates) -> DataFrame:
    """The pairs (a, b) that survive the Bayesian test."""
    def per_batch(batches):
        for batch in batches:
            if batch.num_rows:
                alive, _ = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), p)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    joined = (pairs.join(marks.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
              .join(marks.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(per_batch, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    def per_batch(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                low, high = sorted((len(x), len(y)))
                if 100 * low < p.percent * high:
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= p.percent * (len(x) + len(y) - common))
            if any(keep):
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b"))
    return joined.select("a", "b", "xa", "xb").mapInArrow(per_batch, "a bigint, b bigint")


def _sets(docs: DataFrame, nodes: DataFrame, p: NearDuplicates, id_column: str, text: str) -> DataFrame:
    """(node, shingles) of the texts that stand for a node. nodes: (node, set_id)."""
    def per_batch(batches):
        for batch in batches:
            for first, last, data, starts in texts_in(batch, "text"):
                found = [s.tobytes() for s in shingle_sets(data, starts, p.width)]
                wanted = batch.column("set_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(first, last - first), pa.array(found, pa.binary())],
                    names=["node", "shingles"]).filter(
                        pa.array([_digest(s) == w.as_py() for s, w in zip(found, wanted, strict=True)]))

    picked = docs.select(F.col(id_column).cast("bigint").alias("node"), F.col(text).alias("text"))
    return picked.join(nodes, "node").select("node", "set_id", "text").mapInArrow(
        per_batch, "node bigint, shingles binary")


def _short(shingles: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Sorted distinct digests of a set, others for every salt."""
    return np.unique((mixed(shingles ^ np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.uint32))


def _shorts(sets: DataFrame, marks: DataFrame, salt: int, bits: int) -> DataFrame:
    """``marks`` of the nodes in ``sets`` with the size of the set and its 32-bit digests."""
    def per_batch(batches):
        for batch in batches:
            found = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in found], pa.int64()),
                 pa.array([_short(s, salt, bits).tobytes() for s in found], pa.binary())], names=["node", "size", "short"])

    more = sets.mapInArrow(per_batch, "node bigint, size bigint, short binary").dropDuplicates(["node"])
    return marks.join(more, "node").select("node", "keys", "signature", "size", "short")


def _open_pairs(members: DataFrame, shorts: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links across components within a band that 32-bit digests allow, as many as span what they join.

    A pair counts in the first band it shares. members: (band, node, component). A band of n nodes is cut into blocks of
    about BLOCK nodes or BLOCK_BYTES, and every two blocks meet in one group, so a group is bounded however large the band is.
    """
    sized = members.join(shorts.select("node", "size"), "node")
    sizes = sized.groupBy("band").agg(F.count("*").alias("n"), F.sum(4 * F.col("size")).alias("bytes"),
                                      F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    cut = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("bigint")
    mine = F.pmod(F.xxhash64("node"), F.col("cut"))
    spread = (members.join(sizes.select("band", cut.alias("cut")), "band").withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cut") - 1)))
              .select("band", "node", "component", "mine", F.least("mine", "other").alias("x"),
                      F.greatest("mine", "other").alias("y"))
              .join(shorts, "node"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            for rows in filter(len, table):
                new = _changes(rows)
                # The last group may go on in the next batch.
                yield from _links_in_groups(rows.slice(0, int(new[-1])), new[:-1], p)
                rest = rows.slice(int(new[-1]))
        if rest is not None and rest.num_rows:
            yield from _links_in_groups(rest, _changes(rest), p)

    ordered = spread.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return ordered.select("band", "x", "y", "node", "component", "mine", "keys", "signature", "size", "short").mapInArrow(
        per_task, "a bigint, b bigint")


def _changes(rows: pa.RecordBatch) -> np.ndarray:
    """Where groups begin in sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in ("band", "x", "y"):
        value = rows.column(name).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(new)


def _root(parent: dict[int, int], node: int) -> int:
    while (above := parent.get(node, node)) != node:
        parent[node] = node = parent.get(above, above)
    return node


def _links_in_groups(rows: pa.RecordBatch, begins: np.ndarray, p: NearDuplicates) -> Iterator[pa.RecordBatch]:
    """Links of whole groups: a row meets the rows after it in its group."""
    n = rows.num_rows
    if not n:
        return
    band, node, component, mine, x, y, size = (rows.column(c).to_numpy()
                                               for c in ("band", "node", "component", "mine", "x", "y", "size"))
    sign = _matrix(rows.column("signature"))
    digests, starts = flat(rows.column("short"))
    starts = starts // 4
    merged = size - np.diff(starts)
    # Digests by their place among all of these rows, so that a set is marked in an array.
    values, shingle = np.unique(digests.view(np.uint32), return_inverse=True)
    marked = np.zeros(len(values), bool)
    keys = rows.column("keys").flatten().to_numpy().reshape(n, -1)
    ends = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    many = ends - np.arange(n) - 1
    total = np.append(0, np.cumsum(many))
    first = 0
    parent: dict[int, int] = {}
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + _PAIRS, "right")) - 1)
        i = np.repeat(np.arange(first, last), many[first:last])
        j = np.arange(total[first], total[last]) - np.repeat(total[first:last], many[first:last]) + i + 1
        first = last
        meets = ((component[i] != component[j]) & ((x[i] == y[i]) | (mine[i] != mine[j]))
                 & (100 * np.minimum(size[i], size[j]) >= p.percent * np.maximum(size[i], size[j])))
        i, j = i[meets], j[meets]
        shared = (keys[i] == keys[j]).argmax(axis=1)
        here = keys[i, shared] == band[i]
        i, j = i[here], j[here]
        alive, _ = survivors(sign[i], sign[j], p)
        i, j = i[alive], j[alive]
        found = []
        for a in np.unique(i):
            # What the row shares with each row up to the last one in question, in one sweep over their sets.
            mine_of, others = shingle[starts[a]:starts[a + 1]], j[i == a]
            low, high = others.min(), others.max() + 1
            marked[mine_of] = True
            shared = np.add.reduceat(marked[shingle[starts[low]:starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
            marked[mine_of] = False
            common = shared[others - low] + np.minimum(merged[a], merged[others])
            for b in others[100 * common >= p.percent * (size[a] + size[others] - common)]:
                ca, cb = _root(parent, int(component[a])), _root(parent, int(component[b]))
                if ca != cb:
                    parent[max(ca, cb)] = min(ca, cb)
                    found.append((min(node[a], node[b]), max(node[a], node[b])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found)], names=["a", "b"])


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates(), id_column: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked if they share at least ``percent`` hundredths of the union of their shingles. An
    empty or null text, or one without words, has no shingles and no links: it is its own component and is
    kept. A row with a null id is linked with nothing, has a null component and is not kept. Ids should be
    unique: rows that repeat an id belong to one document, which has the set with the smallest digest.
    Other columns of ``docs`` are not read.
    """
    sign = durable(signatures(docs, p, id_column, text))
    owner = (sign.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("set_id").alias("set_id")))
    classes = durable(owner.groupBy("set_id").agg(F.min("doc_id").alias("node")))
    owner = durable(owner.join(classes, "set_id"))
    chosen = durable(sign.join(classes.withColumnRenamed("node", "doc_id"), ["set_id", "doc_id"], "left_semi")
                     .dropDuplicates(["set_id", "doc_id"])
                     .select(F.col("doc_id").alias("node"), "set_id", "band", "signature"))
    sizes = durable(sign.select("doc_id", "n_shingles"))
    release(sign, classes)
    marks = chosen.select("node", F.col("band").alias("keys"), "signature")
    members = chosen.select(F.explode("band").alias("band"), "node")
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    members = durable(members.join(shared.select("band", "first"), "band"))
    pairs = durable(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
                    .distinct())
    wanted = members.select("node").distinct().join(chosen.select("node", "set_id"), "node")
    sets = durable(_sets(docs, wanted, p, id_column, text))
    links = durable(_confirmed(_likely(pairs, marks, p), sets, p))
    release(pairs)
    found = durable(components(links))
    for salt in range(ROUNDS):
        labelled = members.join(found, "node", "left").select(
            "band", "node", F.coalesce("component", "node").alias("component"))
        bands = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        open_ = durable(labelled.join(bands.where("lo <> hi"), "band", "left_semi").select("band", "node", "component"))
        shorts = durable(_shorts(sets.join(open_.select("node").distinct(), "node", "left_semi"), marks, salt, p.bits))
        pairs = durable(_open_pairs(open_, shorts, p).distinct())
        fresh = durable(_confirmed(pairs, sets, p))
        tried, held = pairs.count(), fresh.count()
        release(open_, shorts, pairs)
        if held:
            links = links.unionByName(fresh)
            old = found
            found = durable(components(links))
            release(old)
        if held == tried:
            break
    else:
        raise RuntimeError(f"links still fail after {ROUNDS} rounds")
    owner = owner.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return (sizes.join(owner, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
