"""Removal of long byte strings that occur more than once: a distributed, common-prefix-aware merge sort.

1. Anchors. Of every window of ``length`` bytes the leftmost smallest hash of ``anchor`` bytes is picked.
   Equal windows pick equal anchors at the same place, so it is enough to look at anchors, about one byte
   in 120, and of those at the ones whose bytes are an anchor twice.
2. Runs. Every task sorts the suffixes that begin at its repeated anchors, up to the end of the last window
   that picked them and with the bytes from the first such window on as payload, into runs of bounded size. Equal suffixes with equal payload are
   one entry. A run is cut at range borders and each piece is written front-coded: common prefix with the
   suffix before it, and the rest.
3. Merge. The pieces of a range are merged by a loser tree that keeps with every loser its common prefix
   with the winner, so no known prefix is compared again; the result carries all common prefixes.
4. Neighbours that share an anchor tell, for every entry, how far its text agrees with some other place to
   the right and to the left: a place counts if both together reach ``length``.
5. The spans go back to the places by the entry's digest and are united per text.
"""
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.textbytes import WHITE, flat, mixed, powers, prefix_sums, texts_in
from storelens.operators.durable import durable, release

PIECE = 1 << 20
_ROWS = 20_000
_AT = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a repeat. ``anchor``: bytes of an anchor, at least eight and less than ``length``. Longer
    anchors are more of them, but fewer lines and phrases shorter than a repeat look like one.

    ``words``: if given, so many words are a repeat too, however few bytes they take; they hold two bytes a word but
    two, so ``anchor`` must not be longer. With ``cut_words`` off they are only reported.

    ``run_bytes``: bytes of suffixes that a task sorts at a time. ``range_anchors``: distinct repeated
    anchors of a merge range.
    """
    length: int = 400
    anchor: int = 160
    run_bytes: int = 32 << 20
    range_anchors: int = 4096
    words: int = 0
    cut_words: bool = True

    def least(self) -> int:
        """Bytes of the shortest repeat."""
        return min(self.length, 2 * self.words - 1) if self.words else self.length


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _window_ends(data: np.ndarray, starts: np.ndarray, at: int, part: np.ndarray, n: int,
                 p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows that begin at the first ``n`` bytes of a part at ``at`` end: after ``length`` bytes or
    ``words`` words, whichever comes first. Past the part if their text ends before. And where ``length`` bytes or
    their text end.
    """
    none = len(part) + 1
    place = np.arange(n)
    text_end = starts[np.searchsorted(starts, place + at, "right")] - at
    most = np.minimum(place + p.length, text_end)
    end = np.where(place + p.length > text_end, none, most)
    inside = ~WHITE[part]
    before, after = np.zeros((2, len(part)), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = at > 0 and not WHITE[data[at - 1]]
    edges = starts[(starts >= at) & (starts < at + len(part))] - at
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    begins = inside & ~before
    stop = np.flatnonzero(inside & ~after) + 1
    # The part may begin within a word. One that it ends within is too far for a window of ``length`` bytes.
    stop = np.append(stop[len(stop) - int(begins.sum()):], np.full(p.words + 1, none))
    # Words that begin after the window does, all but one: where it ends then follows from what is in it.
    by_words = stop[np.cumsum(begins[:n]) + p.words - 2]
    by_words[by_words > text_end] = none
    return np.minimum(end, by_words), most


def _least_between(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of x[i:j] for i < j, without a table for more than one length."""
    depth = np.frexp((j - i).astype(float))[1] - 1
    out = np.empty(len(i), x.dtype)
    for d in range(int(depth.max(initial=-1)) + 1):
        at = np.flatnonzero(depth == d)
        out[at] = np.minimum(x[i[at]], x[j[at] - (1 << d)])
        x = np.minimum(x[:-(1 << d)], x[1 << d:])
    return out


def _word_anchors(data: np.ndarray, starts: np.ndarray, p: Repeats) -> list[tuple[np.ndarray, ...]]:
    """As :func:`anchors`, for windows that may end after some words. Their ends never go back either. What belongs to
    an anchor reaches on to the end of ``length`` bytes, so that a repeat of these is seen whole.
    """
    found = []
    for at in range(0, len(data), PIECE):
        part = data[at:at + PIECE + p.length]
        m = len(part) - p.anchor + 1
        if m <= 0:
            continue
        sums = prefix_sums(part)
        _, down = powers(len(sums))
        value = mixed((sums[p.anchor:] - sums[:-p.anchor]) * down[:m])
        key = (value & ~_AT) | np.arange(m, dtype=np.uint64)
        end, most = _window_ends(data, starts, at, part, min(PIECE, len(part)), p)
        window = np.flatnonzero(end <= len(part))
        end = end[window]
        pick = (_least_between(key, window, end - p.anchor + 1) & _AT).astype(np.int64)
        if len(pick):
            new = np.flatnonzero(np.append(True, pick[1:] != pick[:-1]))
            last = np.append(new[1:] - 1, len(pick) - 1)
            found.append((pick[new] + at, value[pick[new]], window[new] + at, most[window[last]] + at))
    return found


def anchors(data: np.ndarray, starts: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """Places of all anchors in the joined texts, their hashes, and the bytes from the first window that picked
    them to the last one's end. No window leaves its text.
    """
    found = _word_anchors(data, starts, p) if p.words else []
    n = len(data) - p.length + 1
    if n > 0 and not p.words:
        inside = np.zeros(n, bool)
        for first, last in zip(starts[:-1], starts[1:], strict=True):
            inside[first:max(first, last - p.length + 1)] = True
        for at in range(0, n, PIECE):
            part = data[at:at + PIECE + p.length - 1]
            sums = prefix_sums(part)
            m = len(part) - p.anchor + 1
            _, down = powers(len(sums))
            value = mixed((sums[p.anchor:] - sums[:-p.anchor]) * down[:m])
            key = (value & ~_AT) | np.arange(m, dtype=np.uint64)
            low = _sliding_min(key, p.length - p.anchor + 1)
            window = np.flatnonzero(inside[at:at + len(low)])
            pick = (low[window] & _AT).astype(np.int64)
            # Picks never go back, so windows of one anchor are side by side.
            new = np.flatnonzero(np.append(True, pick[1:] != pick[:-1])) if len(pick) else pick
            last = np.append(new[1:] - 1, len(pick) - 1) if len(pick) else pick
            found.append((pick[new] + at, value[pick[new]], window[new] + at, window[last] + at + p.length))
    if not found:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    place, value, low, high = map(np.concatenate, zip(*found, strict=True))
    # An anchor may be picked from both sides of a piece's border.
    place, first, back = np.unique(place, return_index=True, return_inverse=True)
    high_of = high[first].copy()
    np.maximum.at(high_of, back, high)
    low_of = low[first].copy()
    np.minimum.at(low_of, back, low)
    return place, value[first], low_of, high_of


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | data[at + j].astype(np.uint64)
    return (out >> np.uint64(1)).astype(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _anchor_rows(keyed: DataFrame, p: Repeats) -> DataFrame:
    """(id, tag, place, low, high, hash, head): all anchors of each text, and the bytes their windows cover."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in texts_in(batch, "text"):
                at, value, low, high = anchors(data, starts, p)
                bounds = np.searchsorted(at, starts)
                begin = np.repeat(starts[:-1], np.diff(bounds))
                full = np.flatnonzero(np.diff(bounds))
                cut = np.append(bounds[full], len(at))
                rows = pa.array(full + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("tag").take(rows),
                     _lists(at - begin, cut, pa.int32()), _lists(low - begin, cut, pa.int32()),
                     _lists(high - begin, cut, pa.int32()), _lists(value.view(np.int64), cut, pa.int64()),
                     _lists(_heads(data, at), cut, pa.int64())],
                    names=["id", "tag", "place", "low", "high", "hash", "head"])

    return keyed.mapInArrow(per_batch, "id bigint, tag bigint, place array<int>, low array<int>, high array<int>, "
                                       "hash array<bigint>, head array<bigint>")


def _common(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix, which is known to be at least ``start``."""
    n = min(len(x), len(y))
    if x[start:n] == y[start:n]:
        return n
    a, b = int.from_bytes(x[start:n]), int.from_bytes(y[start:n])
    return n - (((a ^ b).bit_length() + 7) >> 3)


def front_coded(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """Sorted (suffix, bytes before it, times seen) as one block."""
    shared = np.zeros(len(entries), np.uint32)
    sizes = np.array([(len(r), len(l), n) for r, l, n in entries], np.uint32).reshape(-1, 3)
    tails, before = [], b""
    for k, (r, _, _) in enumerate(entries):
        shared[k] = _common(before, r)
        tails.append(r[shared[k]:])
        before = r
    return b"".join([np.uint32(len(entries)).tobytes(), shared.tobytes(), sizes.T.tobytes(), *tails,
                     *[l for _, l, _ in entries]])


def decoded(block: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(common prefix with the one before, suffix, bytes before it, times seen) of a block, one at a time."""
    n = int(np.frombuffer(block, np.uint32, 1)[0])
    shared, rights, lefts, seen = np.frombuffer(block, np.uint32, 4 * n, 4).reshape(4, n).tolist()
    at = 4 + 16 * n
    left = at + sum(rights) - sum(shared)
    before = b""
    for c, r, l, k in zip(shared, rights, lefts, seen, strict=True):
        before = before[:c] + block[at:at + r - c]
        at += r - c
        yield c, before, block[left:left + l], k
        left += l


def merged(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int]]:
    """All entries of sorted blocks in order, each with its common prefix with the one before.

    A loser tree. ``prefix[i]`` is the common prefix of the head of run i with the winner it last lost to.
    The successor of a winner knows its prefix with that winner from the front coding, and so does every
    loser on its path; of two heads the one with the longer prefix comes first, and only equal prefixes
    are compared, from there on.
    """
    runs = [decoded(b) for b in blocks]
    k = 1 << max(0, len(runs) - 1).bit_length()
    head: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k

    def beats(i: int, j: int) -> bool:
        if head[j] is None or head[i] is None:
            return head[j] is None
        if prefix[i] != prefix[j]:
            return prefix[i] > prefix[j]
        x, y = head[i][1], head[j][1]
        c = _common(x, y, prefix[i])
        first = x[c:c + 1] <= y[c:c + 1]
        prefix[j if first else i] = c
        return first

    tree = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        winners = []
        for m in range(width):
            i, j = level[2 * m], level[2 * m + 1]
            if not beats(i, j):
                i, j = j, i
            tree[width + m] = j
            winners.append(i)
        level = winners
    winner = level[0]
    while head[winner] is not None:
        _, r, l, n = head[winner]
        yield prefix[winner], r, l, n
        head[winner] = following = next(runs[winner], None)
        if following is not None:
            prefix[winner] = following[0]
        node = (winner + k) >> 1
        while node:
            if not beats(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node >>= 1


def _range_min(values: np.ndarray):
    table = [values]
    while len(table[-1]) > 1 and 2 ** len(table) <= len(values):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def between(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Smallest of values[i:j] for i < j."""
        depth = np.frexp((j - i).astype(float))[1] - 1
        out = np.empty(len(i), values.dtype)
        for d in np.unique(depth):
            at = depth == d
            out[at] = np.minimum(table[d][i[at]], table[d][j[at] - 2 ** d])
        return out
    return between


def _are_repeats(entries: list[tuple[int, bytes, bytes, int]], length: int, words: int):
    """Tells of entries, and of bytes before and after their places, whether these are a repeat."""
    if not words:
        return lambda k, before, after: before + after >= length
    sizes = np.array([(len(l), len(r)) for _, r, l, _ in entries], np.int64).reshape(-1, 2)
    start = np.append(0, np.cumsum(sizes.sum(axis=1)))[:-1]
    place = start + sizes[:, 0]
    inside = ~WHITE[np.frombuffer(b"".join(x for _, r, l, _ in entries for x in (l, r)), np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[start] = inside[start]
    seen = np.append(0, np.cumsum(begins, dtype=np.int32))

    def enough(k: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        first, last = place[k] - before, place[k] + after
        return (before + after >= length) | (seen[last] - seen[first] + (inside[first] & ~begins[first]) >= words)
    return enough


def agreements(entries: list[tuple[int, bytes, bytes, int]], length: int,
               words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For entries with a common anchor, in order: the bytes before and after the place that repeat.

    Each entry is (common prefix with the one before, suffix, bytes before, times seen). For every common
    prefix d that occurs, entries fall into groups that agree on d bytes; in the order of their reversed
    left sides, a neighbour within the group agrees furthest to the left. The pair counts if both
    agreements reach ``length``, or have ``words`` words, those cut by an end included. Zero where nothing does.
    """
    n = len(entries)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    enough_of = _are_repeats(entries, length, words)
    copied = np.array([k for k, e in enumerate(entries) if e[3] > 1], np.int64)
    before, after = (np.array([len(entries[k][side]) for k in copied], np.int64) for side in (2, 1))
    whole = enough_of(copied, before, after)
    low[copied[whole]], high[copied[whole]] = before[whole], after[whole]
    if n == 1:
        return low, high
    lefts = [l[::-1] for _, _, l, _ in entries]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    between = _range_min(np.array([_common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])], np.int64))
    shared = np.array([e[0] for e in entries], np.int64)
    for depth in np.unique(shared[1:])[::-1]:
        group = np.cumsum(shared < depth)
        by_left = np.lexsort((rank, group))
        a, b = by_left[:-1], by_left[1:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        agree = between(rank[a], rank[b])
        enough = enough_of(a, agree, np.full(len(a), depth))
        for side in (a[enough], b[enough]):
            np.maximum.at(low, side, agree[enough])
            np.maximum.at(high, side, depth)
    return low, high


def _entry_id(r: bytes, l: bytes) -> bytes:
    return blake2b(len(l).to_bytes(4) + l + r, digest_size=16).digest()


def _runs(texts: DataFrame, borders: list[int], p: Repeats) -> DataFrame:
    """Two kinds of rows: a place and the entry it belongs to, or a range and a piece of a run."""
    borders_at = np.array(borders, np.int64)
    kinds = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("place", pa.int32()), ("entry", pa.binary()),
                       ("part", pa.int32()), ("block", pa.binary())])

    def pieces(found: dict) -> Iterator[pa.RecordBatch]:
        entries = sorted((r, l, n) for (r, l), n in found.items())
        heads = np.array([int.from_bytes(r[:8]) >> 1 for r, _, _ in entries], np.int64)
        part = np.searchsorted(borders_at, heads, "right")
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(entries)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield pa.RecordBatch.from_pylist([{"part": int(part[a]), "block": front_coded(entries[a:b])}], kinds)

    def places(rows: list[tuple]) -> pa.RecordBatch:
        k = len(rows)
        ids, tags, place, entry = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(place, pa.int32()),
             pa.array(entry, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=kinds)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bytes], int] = {}
        held, rows = 0, []
        for batch in batches:
            data, starts = flat(batch.column("text"))
            ids, tags = batch.column("id").to_pylist(), batch.column("tag").to_pylist()
            for i, marks in enumerate(batch.column("marks")):
                text = data[starts[i]:starts[i + 1]].tobytes()
                marks = marks.values
                for a, x, y in zip(*(marks.field(k).to_pylist() for k in range(3)), strict=True):
                    r, l = text[a:y], text[x:a]
                    n = found.get((r, l), 0)
                    found[r, l] = n + 1
                    held += 0 if n else len(r) + len(l)
                    rows.append((ids[i], tags[i], a, _entry_id(r, l)))
                    if len(rows) >= _ROWS:
                        yield places(rows)
                        rows = []
                    if held > p.run_bytes:
                        yield from pieces(found)
                        found, held = {}, 0
        if rows:
            yield places(rows)
        if found:
            yield from pieces(found)

    return texts.mapInArrow(per_task, "id bigint, tag bigint, place int, entry binary, part int, block binary")


def _verdicts(blocks: DataFrame, p: Repeats) -> DataFrame:
    """(entry, low, high) of every entry that repeats; no bytes where a repeat is only reported."""
    def per_range(table: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, int]] = []

        def settle(group: list) -> None:
            low, high = agreements(group, p.length, p.words)
            repeats = np.flatnonzero(high)
            if len(repeats) and p.words and not p.cut_words:
                low, high = agreements(group, p.length)
            for k in repeats:
                out.append((_entry_id(group[k][1], group[k][2]), int(low[k]), int(high[k])))

        group: list = []
        same: dict[bytes, int] = {}
        for shared, r, l, n in merged(table.column("block").to_pylist()):
            if group and shared < p.anchor:
                settle(group)
                group, same = [], {}
            if not group or r != group[-1][1]:
                same = {}
            if l in same:
                k = same[l]
                group[k] = (*group[k][:3], group[k][3] + n)
                continue
            same[l] = len(group)
            group.append((shared, r, l, n))
        if group:
            settle(group)
        entry, low, high = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"entry": pa.array(entry, pa.binary()), "low": pa.array(low, pa.int32()),
                         "high": pa.array(high, pa.int32())})

    return (blocks.select("part", "block").groupBy("part")
            .applyInArrow(per_range, "entry binary, low int, high int"))


def repeated_spans(docs: DataFrame, p: Repeats = Repeats(), id_column: str = "doc_id", text: str = "text",
                   carry: list[str] = ()) -> DataFrame:
    """(doc_id, text, n_bytes, spans, kept, kept_text, repeats): the maximal byte spans that repeats cover, what is
    left, and whether there is a repeat at all, cut or only reported.

    A byte is covered if a string of ``length`` bytes, or one from word to word of ``words``, around it also starts at
    another place of the table, the same text included; overlaps count. Spans are [start, end) in the UTF-8 bytes of the text; a null
    text is empty. Rows may repeat ids: a row that occurs twice repeats itself. A null id is one more
    id. ``kept`` is binary, since a cut may split a character; ``kept_text`` leaves such parts
    out and is null where nothing is cut. Columns named in ``carry`` follow, others are not read.
    """
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"),
                        *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)],
                        F.coalesce(F.col(id_column).cast("bigint"), F.lit(-1)).alias("id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"))
    found = durable(_anchor_rows(keyed.where(F.octet_length("text") >= p.least()).select("id", "tag", "text"), p))
    places = found.select("id", "tag", F.explode(F.arrays_zip("hash", "place", "low", "high")).alias("x")) \
        .select("id", "tag", "x.*")
    heads = found.select(F.explode(F.arrays_zip("hash", "head")).alias("x")).select("x.*")
    twice = durable(heads.groupBy("hash").agg(F.count("*").alias("n"), F.min("head").alias("head")).where("n > 1")
                    .select("hash", "head"))
    ranges = -(-twice.count() // p.range_anchors)
    borders = sorted(set(twice.agg(F.percentile_approx("head", [k / ranges for k in range(1, ranges)], 100 * ranges))
                         .first()[0])) if ranges > 1 else []
    marks = (places.join(twice.select("hash"), "hash")
             .groupBy("id", "tag").agg(F.collect_set(F.struct("place", "low", "high")).alias("marks")))
    runs = durable(_runs(keyed.select("id", "tag", "text").join(marks, ["id", "tag"]).select("id", "tag", "text", "marks"),
                         borders, p))
    release(found, twice)
    verdicts = durable(_verdicts(runs.where("part IS NOT NULL"), p))
    spans = (runs.where("part IS NULL").select("id", "tag", "place", "entry").join(verdicts, "entry")
             .groupBy("id", "tag").agg(F.collect_set(F.struct((F.col("place") - F.col("low")).alias("start"),
                                                              (F.col("place") + F.col("high")).alias("end")))
                                       .alias("found")))
    # One that is only reported covers nothing.
    spans = spans.withColumn("found", F.filter("found", lambda s: s["start"] < s["end"]))
    carried = [f"carried_{k}" for k in range(len(carry))]
    joined = keyed.join(spans, ["id", "tag"], "left").select("doc_id", "text", *carried, "found")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, starts = flat(batch.column("text"))
            united, kept, kept_text = [], [], []
            for i, found in enumerate(batch.column("found")):
                text = data[starts[i]:starts[i + 1]]
                spans = _united(found.values) if found.is_valid and len(found.values) else []
                united.append(spans)
                edges = [0, *(v for s in spans for v in (s["start"], s["end"])), len(text)]
                parts = [text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)]
                kept.append(b"".join(parts))
                kept_text.append("".join(part.decode("utf-8", "ignore") for part in parts) if spans else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(np.diff(starts), pa.int64()),
                 pa.array(united, span_type), pa.array(kept, pa.binary()), pa.array(kept_text, pa.string()),
                 batch.column("found").is_valid(), *(batch.column(c) for c in carried)],
                names=["doc_id", "text", "n_bytes", "spans", "kept", "kept_text", "repeats", *carry])

    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = (T.StructType().add("doc_id", docs.schema[id_column].dataType).add("text", T.StringType())
              .add("n_bytes", T.LongType()).add("spans", T.ArrayType(span))
              .add("kept", T.BinaryType()).add("kept_text", T.StringType())
              .add("repeats", T.BooleanType()))
    for c in carry:
        schema.add(c, docs.schema[c].dataType)
    return joined.mapInArrow(per_batch, schema)


def _united(found: pa.StructArray) -> list[dict[str, int]]:
    """Spans that overlap or touch, as one."""
    a, b = (found.field(k).to_numpy() for k in range(2))
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > reach[:-1])
    ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
    return [{"start": int(x), "end": int(y)} for x, y in zip(a[new], ends, strict=True)]
