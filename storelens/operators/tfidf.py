"""TF-IDF over words and word pairs, as a long table of (text, term, weight).

Term frequency is 1 + ln(count); inverse document frequency is ln((1 + n) / (1 + df)) + 1 over
the training reviews; terms of fewer than ``min_df`` training reviews are dropped; the
weights of one text have length 1.

Texts repeat. A text is tokenised and counted once however many reviews carry it; the
number of copies only weights the document frequency.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.text import words, words_and_pairs
from storelens.operators.durable import durable
from storelens.operators.workers import find_package


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: half of its SHA-256 digest."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def distinct_texts(reviews: DataFrame, in_train: Column) -> DataFrame:
    """One row per text: text_id, review_text, copies, train_copies. ``in_train`` looks at the text only."""
    copies = reviews.groupBy(text_key(F.col("review_text")).alias("text_id"), "review_text").agg(
        F.count("*").alias("copies"))
    return copies.withColumn("train_copies", F.when(in_train, F.col("copies")).otherwise(0))


def term_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of each term in each text.

    Texts are spread by text_id before they are cut into terms. That also groups
    (text_id, term), so the texts are shuffled and their many terms are not.
    """
    terms = words_and_pairs(words(F.col("review_text")))
    return (texts.repartition("text_id")
            .select("text_id", "train_copies", F.explode(terms).alias("term"))
            .groupBy("text_id", "term").agg(F.first("train_copies").alias("train_copies"),
                                            F.count("*").alias("n")))


def _idf(train_reviews: Column) -> Column:
    return F.ln((F.lit(1.0) + train_reviews) / (F.lit(1.0) + F.col("df"))) + 1.0


def vocabulary(texts: DataFrame, min_df: int = 2) -> DataFrame:
    """The vocabulary of ``texts``, which is read twice; give a written table. Only distinct terms are exchanged."""
    learned = texts.where(F.col("train_copies") > 0)
    terms = F.explode(F.array_distinct(words_and_pairs(words(F.col("review_text"))))).alias("term")
    return (learned.select("train_copies", terms).groupBy("term").agg(F.sum("train_copies").alias("df"))
            .where(F.col("df") >= min_df).withColumn("idf", _idf(texts.agg(F.sum("train_copies")).scalar())))


#: Words and pairs of a block of texts: its distinct terms travel, not those of each text.
BLOCK_TERMS = 1 << 21


def _squeezed(data: np.ndarray | bytes) -> bytes:
    return pa.compress(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data, codec="zstd", asbytes=True)


def _numbers(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), np.int32)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (text_id, review_id, copies, train_copies, words) as blocks of terms with their copies in training, and per
    text the numbers of its terms and how often they occur. Texts of one review and of several are blocks of their own."""
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

    def flush(repeated: bool) -> pa.RecordBatch:
        table = pa.Table.from_batches(held[repeated]).combine_chunks()
        held[repeated] = []
        lists = table.column("words").chunk(0)
        words = lists.flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        key, n = np.unique(text * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, place = np.divmod(key, size)
        train = table.column("train_copies").to_numpy()
        copies = np.bincount(place, train[text], len(words.dictionary)).astype(np.int64)
        # What a text has more than the one before, and what a term's number is beyond the last: small numbers.
        own = np.bincount(text, minlength=len(sizes)).astype(np.int32)
        apart = np.diff(place, prepend=0).astype(np.int32)
        joined = "\n".join(words.dictionary.to_pylist()).encode()

        def whole(array: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

        return pa.RecordBatch.from_arrays(
            [pa.array([repeated]), whole(table.column("text_id").chunk(0)), whole(table.column("review_id").chunk(0)),
             pa.array([int(train.sum())], pa.int64()), whole(words.dictionary), whole(pa.array(copies)),
             pa.array([len(place)], pa.int64()), pa.array([len(joined)], pa.int64()),
             *(pa.array([_squeezed(a)], pa.binary()) for a in (joined, own, apart, n.astype(np.int32)))],
            names=["repeated", "text_ids", "review_ids", "train", "terms", "copies", "entries", "bytes", "joined", "sizes",
                   "apart", "counts"])

    for batch in batches:
        again = batch.column("copies").to_numpy() > 1
        for repeated in (False, True):
            own = batch.take(pa.array(np.flatnonzero(again == repeated)))
            if own.num_rows:
                held[repeated].append(own)
                if sum(len(b.column("words").flatten()) for b in held[repeated]) >= BLOCK_TERMS:
                    yield flush(repeated)
    for repeated in held:
        if held[repeated]:
            yield flush(repeated)


def _weighed(own: pa.Table, known: pa.Table) -> pa.Table:
    """(text_id, review_id, weights) of the texts of a block that have a known term; weights are (term, weight)."""
    kind = pa.struct([("term", pa.string()), ("weight", pa.float64())])
    if not own.num_rows:
        return pa.table({"text_id": pa.array([], pa.binary()), "review_id": own.column("review_ids").combine_chunks().flatten(),
                         "weights": pa.array([], pa.list_(kind))})
    block = own.to_pylist()[0]
    lists = {c: own.column(c).combine_chunks().flatten() for c in ("text_ids", "review_ids")}
    terms = pa.array(pa.decompress(block["joined"], block["bytes"], codec="zstd", asbytes=True).decode().split("\n"), pa.string())
    sizes = _numbers(block["sizes"], len(lists["text_ids"]))
    places, counts = np.cumsum(_numbers(block["apart"], block["entries"])), _numbers(block["counts"], block["entries"])
    idf = np.zeros(len(terms))
    idf[known.column("place").to_numpy()] = known.column("idf").to_numpy()
    hit = idf[places] > 0
    text = np.repeat(np.arange(len(sizes)), sizes)[hit]
    places = places[hit]
    raw = (1.0 + np.log(counts[hit].astype(np.float64))) * idf[places]
    weights = raw / np.sqrt(np.bincount(text, raw * raw, len(sizes)))[text]
    found, first = np.unique(text, return_index=True)
    entries = pa.StructArray.from_arrays([terms.take(pa.array(places)), pa.array(weights)],
                                         fields=list(kind))
    return pa.table({"text_id": lists["text_ids"].take(pa.array(found)), "review_id": lists["review_ids"].take(pa.array(found)),
                     "weights": pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), entries)})


def review_weights(reviews: DataFrame, in_train: Column, min_df: int = 2) -> DataFrame:
    """(review_id, term, weight) of every review; ``in_train`` looks at the text only.

    Texts are counted once each, in blocks. Only a block's distinct terms are exchanged, and what comes back to it is the
    idf of those in the vocabulary. A text of one review goes out from there; weights of a text that several reviews
    share are written and handed to them by its digest.
    """
    spark = reviews.sparkSession
    find_package(spark)
    key = reviews.schema["review_id"].dataType.simpleString()
    texts = (reviews.groupBy(text_key(F.col("review_text")).alias("text_id"), "review_text")
             .agg(F.min("review_id").alias("review_id"), F.count("*").alias("copies"))
             .select("text_id", "review_id", "copies", F.when(in_train, F.col("copies")).otherwise(0).alias("train_copies"),
                     words_and_pairs(words(F.col("review_text"))).alias("words")))
    blocks = durable(texts.mapInArrow(
        _encoded, f"repeated boolean, text_ids array<binary>, review_ids array<{key}>, train bigint, terms array<string>, "
                  "copies array<bigint>, entries bigint, bytes bigint, joined binary, sizes binary, apart binary, counts binary")
        .withColumn("block", F.monotonically_increasing_id()))
    train_reviews = blocks.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    terms = blocks.select("block", "repeated", F.posexplode(F.arrays_zip("terms", "copies")).alias("place", "_t"))
    df = F.sum("_t.copies").over(Window.partitionBy("_t.terms"))
    known = durable(terms.select("block", "repeated", "place", df.alias("df")).where(F.col("df") >= min_df)
                    .select("block", "repeated", "place", _idf(F.lit(train_reviews)).alias("idf")))

    def weights(repeated: bool) -> DataFrame:
        packed = blocks.select("block", "repeated", "text_ids", "review_ids", "entries", "bytes", "joined", "sizes", "apart", "counts")
        own, idf = (t.where(F.col("repeated") == repeated).groupBy("block") for t in (packed, known))
        return own.cogroup(idf).applyInArrow(
            _weighed, f"text_id binary, review_id {key}, weights array<struct<term:string,weight:double>>")

    # Weights are written first: the join then starts from two plain shuffles, and adaptive execution splits the reviews
    # of a text that very many share.
    shared = durable(weights(True).select("text_id", "weights"))
    keyed = reviews.select("review_id", text_key(F.col("review_text")).alias("text_id"))
    return (weights(False).select("review_id", F.inline("weights"))
            .unionAll(keyed.join(shared, "text_id").select("review_id", F.inline("weights"))))
