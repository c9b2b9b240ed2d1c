"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

What comes after a token can only change it by taking its last part into a merge of higher priority, and
that merge can in turn only be prevented by one of still higher priority further to the right. Such a
chain has strictly rising priority, so the merge list fixes for every token how many bytes to its right
can matter (:func:`sufficient_lookahead`). The encoder keeps that many bytes, emits a token as soon as
that many follow it, and forgets it. The decoder is a byte-to-text state machine that holds at most an
unfinished character.
"""
import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of text into pieces, which merges do not cross, and the classes of long pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")

#: Characters that are split at a time, and the length from which a piece is streamed.
CHUNK = 1 << 16
CACHED_PIECES = 1 << 18
LONGEST_CACHED = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, special tokens and the merge list of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {i: bytes(map(alphabet.__getitem__, s)) for s, i in ids.items()}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.lookahead = sufficient_lookahead(self)
        #: Bytes that a stream takes at a time.
        self.step = 2 * max(self.lookahead.values()) + 2 * max(map(len, self.token_bytes.values()))

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a whole piece: the pair of lowest rank first, the leftmost of equals."""
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if (found := self.merges.get((ids[i], ids[i + 1]))) is not None:
                queue.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, x, y = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := self.merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (found := self.merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (found[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]


def sufficient_lookahead(vocabulary: Vocabulary) -> dict[int, int]:
    """For each token the bytes after it that decide whether it stands.

    The merge (e, y) takes e away from whatever ends in e, if it comes before e is used up; it reaches
    over y and over all that can change y in time. Merges are taken in order of rank, so for each token
    ``open_end`` holds the reach of the merges so far that begin with it; a merged token keeps, in
    ``inner``, the reach that its right parts had while they stood.
    """
    open_end: dict[int, int] = {}
    inner: dict[int, int] = {}
    for (left, right), (_, whole) in sorted(vocabulary.merges.items(), key=lambda m: m[1][0]):
        right_reach = max(inner.get(right, 0), open_end.get(right, 0))
        inner[whole] = max(inner.get(whole, 0), right_reach)
        reach = len(vocabulary.token_bytes[right]) + right_reach
        open_end[left] = max(open_end.get(left, 0), reach)
    return {t: max(inner.get(t, 0), open_end.get(t, 0)) for t in vocabulary.token_bytes}


class PieceStream:
    """Tokens of one piece that arrives in parts. Holds a bounded number of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held = b""
        self.step = vocabulary.step

    def feed(self, part: bytes, last: bool = False) -> Iterator[int]:
        at = 0
        while at < len(part) or last:
            taken = part[at:at + self.step]
            at += len(taken)
            self.held += taken
            ends = last and at >= len(part)
            kept = 0
            for token in self.vocabulary.merged(self.held):
                end = kept + len(self.vocabulary.token_bytes[token])
                if not ends and end + self.vocabulary.lookahead[token] > len(self.held):
                    break
                yield token
                kept = end
            self.held = self.held[kept:]
            if ends:
                return


class Encoder:
    """Packed tokens (unsigned 32-bit, little-endian) of texts, part after part."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN)
        self.runs = [regex.compile(c) for c in CLASSES]
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        encode = self._packed

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                packed = encode(piece)
                if len(piece) <= LONGEST_CACHED:
                    if len(self) >= CACHED_PIECES:
                        self.clear()
                    self[piece] = packed
                return packed

        self.known = Known()

    def _packed(self, piece: str) -> bytes:
        raw = piece.encode()
        # Up to a step the stream is the same single merge.
        if len(raw) <= self.vocabulary.step:
            return np.array(self.vocabulary.merged(raw), "<u4").tobytes()
        return np.fromiter(PieceStream(self.vocabulary).feed(raw, last=True), "<u4").tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed tokens of a text, in blocks."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.vocabulary.special:
                yield np.array([self.vocabulary.special[part]], "<u4").tobytes()
            elif part:
                yield from self.stream(part[i:i + CHUNK] for i in range(0, len(part), CHUNK))

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Packed tokens of a text without special tokens that arrives in chunks.

        The end of a chunk is held back from the last sure border on, a space after something else. A
        piece that goes on for a whole chunk is streamed as it is.
        """
        known = self.known.__getitem__
        held = ""
        open_run: PieceStream | None = None
        run = None
        for chunk in chunks:
            held += chunk
            if open_run is not None:
                more = run.match(held)
                part = more.group() if more else ""
                ends = len(part) < len(held)
                yield np.fromiter(open_run.feed(part.encode(), last=ends), "<u4").tobytes()
                held = held[len(part):]
                if not ends:
                    continue
                open_run = None
            cut = _sure_border(held)
            if cut:
                yield b"".join(map(known, self.split.findall(held[:cut])))
                held = held[cut:]
            elif len(held) >= CHUNK:
                pieces = self.split.findall(held)
                run = next((r for r in self.runs if r.fullmatch(pieces[-1].removeprefix(" "))), None)
                if run is not None and len(pieces[-1]) > 2:
                    yield b"".join(map(known, pieces[:-1]))
                    open_run = PieceStream(self.vocabulary)
                    yield np.fromiter(open_run.feed(pieces[-1].encode()), "<u4").tobytes()
                    held = ""
                elif len(pieces) > 3:
                    tail = sum(map(len, pieces[-3:]))
                    yield b"".join(map(known, pieces[:-3]))
                    held = held[len(held) - tail:]
        if open_run is not None:
            yield np.fromiter(open_run.feed(b"", last=True), "<u4").tobytes()
        if held:
            yield b"".join(map(known, self.split.findall(held)))


def _sure_border(text: str) -> int:
    """The last place before a space that follows a visible character; 0 if there is none."""
    at = text.rfind(" ")
    while at > 0:
        if text[at - 1] > " " and not text[at - 1].isspace():
            return at
        at = text.rfind(" ", 0, at)
    return 0


class Decoder:
    """Text of packed tokens, part after part. Bytes that are not UTF-8 become the replacement character."""

    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.token_bytes) + 1
        self.bytes_of = [vocabulary.token_bytes.get(i, b"") for i in range(size)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Encoder, Decoder]:
    vocabulary = Vocabulary(path)
    return Encoder(vocabulary), Decoder(vocabulary)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text",
                  carry: list[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row: the tokens as packed unsigned 32-bit numbers, little-endian,
    and the text decoded from them.

    ``path`` is the vocabulary file, which every executor must be able to read. A null text counts as
    empty and has no tokens. The strings of special tokens become those tokens. Ids may repeat or be
    null. Columns named in ``carry`` follow, others are not read.
    """
    carried = [f"carried_{k}" for k in range(len(carry))]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, texts = [], []
                for value in part.column("text"):
                    blocks, spans = [], []
                    for block in encoder.encode(value.as_py() or ""):
                        blocks.append(block)
                        spans.append(decoder.feed(block))
                    ids.append(b"".join(blocks))
                    texts.append("".join(spans) + decoder.end())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(texts, pa.string()), *(part.column(c) for c in carried)],
                    names=["doc_id", "n_tokens", "ids", "decoded", *carry])

    schema = (T.StructType().add("doc_id", docs.schema[id_column].dataType).add("n_tokens", T.LongType())
              .add("ids", T.BinaryType()).add("decoded", T.StringType()))
    for c in carry:
        schema.add(c, docs.schema[c].dataType)
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"),
                         *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    return picked.mapInArrow(per_batch, schema)
