"""Learned operators, embeddings, tokens, chat logs and the pipeline: held-out accuracy, brute force and round trips."""
import hashlib
import math
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from storelens.llm import bpe, chat, entries, itq, language, quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, score string, lang string, quality int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS).repartition(2)


# -- language ------------------------------------------------------------------------------------------------

def test_language_held_out(spark, small):
    found = entries.op3_language(spark, small).join(
        spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r["doc_id"] for r in rows} <= {i for i in range(1000) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}


def test_language_backs_off(spark):
    train = table(spark, [(k, t, None, lang) for k, (t, lang) in enumerate(
        [("the house stands there", "en"), ("das haus steht dort", "de"), (None, "en"), ("kein", None)] * 3)])
    model = language.learn(train)
    assert model.languages == ["de", "en"]
    docs = table(spark, [(1, "THE"), (2, "haus"), (3, None), (4, ""), (5, "12 + 3 %"), (6, "漢字"), (7, "thestands"),
                         (8, "steht " * 30_000), (1, "THE"), (None, "dort")])
    found = language.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "quality", "lang_pred", "score"]
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert [rows[k][0] for k in (1, 2, 3, 4, 5, 7, 8, None)] == ["en", "de", "und", "und", "und", "en", "de", "de"]
    assert rows[3][1] == rows[4][1] == rows[5][1] == 0 and rows[6] == ("de", 0.5)
    assert all(0 <= s <= 1 for _, s in rows.values())
    # A word none of whose longest n-grams is known takes the next shorter length.
    for size in range(1, 5):
        assert len(model.tables[size][0])
    assert language.predict(docs.limit(0), model).count() == 0
    assert language.learn(train.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


# -- quality -------------------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    from conftest import TESTDATA
    folder = f"{TESTDATA}/sf0.01"
    found = entries.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 60
    for label in (0, 1):
        assert np.mean([r["predicted"] == label for r in rows if r["quality"] == label]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_cases(spark):
    rows = [(k, t, None, None, q) for k, (t, q) in enumerate([("good clean words here", 1), ("!!! $$$ !!!", 0)] * 20)]
    model = quality.learn(table(spark, [*rows, (90, "x", None, None, 7), (91, None, None, None, 1)]),
                          quality.QualityParameters(bits=10))
    docs = table(spark, [(1, "clean words"), (2, "$$$ !!!"), (3, None), (4, ""), (5, "words " * 30_000), (1, "clean words")])
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert found[1] > 0.5 > found[2] and found[3] == found[4] and all(0 <= s <= 1 for s in found.values())
    assert quality.score(docs, model).columns == ["doc_id", "text", "lang", "quality", "score"]
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.learn(table(spark, []), quality.QualityParameters(bits=10))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


# -- embeddings ----------------------------------------------------------------------------------------------

def brute_vectors(rows, cosine):
    valid = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid[k] = np.array(v, float) / np.linalg.norm(v)
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    keys = sorted(valid)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            if len(valid[a]) == len(valid[b]) and valid[a] @ valid[b] >= cosine:
                i, j = rows[a][0], rows[b][0]
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in parent}


def test_near_vectors(spark):
    draw = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        base = draw.normal(size=32)
        for _ in range(draw.integers(1, 7)):
            rows.append((base + draw.normal(size=32) * draw.choice([0.0, 0.1, 0.2, 0.5])).astype(np.float32).tolist())
    rows = list(enumerate(rows)) + [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, []),
                                    (904, [None] + [1.0] * 31), (905, [float("inf")] * 32), (906, [1.0, 2.0]),
                                    (907, [1.0, 2.0]), (908, [2.0 * x for x in rows[0]])]
    vectors = spark.createDataFrame([(i, v, "k", 1) for i, v in rows] + [(None, rows[0][1], "k", 1)],
                                    "vec_id bigint, embedding array<float>, key string, size int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.near_vectors(vectors).collect()}
    wanted = brute_vectors(rows, 0.95)
    assert found.pop(None) == (0, None, False)
    assert set(found) == set(wanted)
    # Recall against brute force, and nothing below the threshold.
    linked = sum(n for n, _ in wanted.values())
    assert 0.97 * linked <= sum(n for n, _, _ in found.values()) <= linked
    assert all(n <= wanted[i][0] and k == (i == c) for i, (n, c, k) in found.items())
    assert found[906][:2] == (1, 906) and found[907][:2] == (1, 906)
    assert itq.near_vectors(vectors.limit(0)).count() == 0
    assert itq.near_vectors(vectors.where("vec_id = 901")).collect()[0][:3] == (901, 0, 901)


def test_codes_are_balanced():
    sample = np.random.default_rng(1).normal(size=(500, 16)) * np.linspace(1, 3, 16)
    turn = itq.rotation(sample, 40, 0)
    assert np.allclose(turn @ turn.T, np.eye(16))
    plain = np.linalg.eigh(sample.T @ sample)[1]
    loss = [np.square(np.where(x >= 0, 1, -1) - x / x.std()).mean() for x in (sample @ plain, sample @ turn)]
    assert loss[1] < loss[0]


# -- tokens --------------------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def reference():
    return Tokenizer.from_file(PATH)


@lru_cache(maxsize=1)
def vocabulary():
    return bpe.Vocabulary(PATH)


def check_text(encoder, decoder, text):
    packed = b"".join(encoder.encode(text))
    ids = reference().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids, text[:200]
    assert decoder.feed(packed) + decoder.end() == reference().decode(ids, skip_special_tokens=False)


PARTS = ["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "'", "'re", "1", "23", "é", "ñ", "\x1c", "\x85", "漢", "😀",
         "́", "!!", "<|endoftext|>", "<|endo", "\t", "​", "²", "١"]


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_tokens_equal_the_library(monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    encoder, decoder = bpe.Encoder(vocabulary()), bpe.Decoder(vocabulary())
    draw = random.Random(chunk)
    for _ in range(1500):
        check_text(encoder, decoder, "".join(draw.choices(PARTS, k=draw.randint(0, 30))))
    for _ in range(60):
        check_text(encoder, decoder, "".join(draw.choices(["the", "tion", "ing", "aaaa", "zz", "an"], k=draw.randint(0, 300))))
        check_text(encoder, decoder, draw.choice(["a", "=", " ", "\n", "ab", "1", " -"]) * draw.randint(0, 2000))


def test_stream_emits_as_soon_as_stable():
    v = vocabulary()
    draw = random.Random(3)
    for _ in range(150):
        piece = "".join(draw.choices(["the", "tion", "ss", "er", *"abcdefgh"], k=draw.randint(0, 80))).encode()
        stream, out, at = bpe.PieceStream(v), [], 0
        stream.step = 5
        while at < len(piece):
            n = draw.randint(1, 9)
            out += stream.feed(piece[at:at + n])
            at += n
            assert len(stream.held) <= max(v.lookahead.values()) + max(map(len, v.token_bytes.values())) + stream.step
        assert out + list(stream.feed(b"", last=True)) == v.merged(piece)


def test_long_pieces_are_streamed(monkeypatch):
    v = vocabulary()
    merged, seen = v.merged, []
    monkeypatch.setattr(v, "merged", lambda piece: seen.append(len(piece)) or merged(piece))
    draw = random.Random(9)
    for text in ("".join(draw.choices(["the", "tion", "ss", *"abcdefgh"], k=9000)), "=" * 20_000, "a" * v.step):
        check_text(bpe.Encoder(v), bpe.Decoder(v), text)
    assert max(seen) <= 2 * v.step


def test_decoder_holds_unfinished_characters():
    decoder = bpe.Decoder(vocabulary())
    ids = [vocabulary().of_byte[b] for b in "é漢".encode()] + [vocabulary().of_byte[0xE6]]
    parts = [decoder.feed(np.array([i], "<u4").tobytes()) for i in ids]
    assert parts == ["", "é", "", "", "漢", ""] and decoder.end() == "�"


def test_encode_decode(spark):
    texts = ["", None, "Hello world", "a" * 100_000, " x" * 40_000, "<|endoftext|>!", "Hello world"]
    docs = table(spark, [*enumerate(texts), (None, "z")])
    found = bpe.encode_decode(docs, PATH, carry=["lang"])
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded", "lang"]
    for r in found.collect():
        text = "z" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = reference().encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], bytes(r["ids"]), r["decoded"]) == (len(ids), np.array(ids, "<u4").tobytes(), text)
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


# -- chat ----------------------------------------------------------------------------------------------------

LOG = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string, floor int"


def test_log_folds(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", None, "llo"),
        (1, 3, 0, "edit", None, "hi!"), (1, 4, 2, "message", "user", "more"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", "assistant", "hey"), (1, 7, 1, "delta", None, " you"), (1, 8, 3, None, "user", None),
        (2, 0, 0, "message", "user", "x"), (2, 1, 0, "regenerate", None, None),
        (None, 0, 0, "message", "user", "lost"), (3, 0, 0, "message", None, "no role"), (3, 1, 1, "other", "user", "?"),
    ]
    events = spark.createDataFrame([(*e, 5) for e in log], LOG).repartition(3)
    found = sorted(map(tuple, chat.final_messages(events).collect()), key=str)
    assert found == sorted([(1, 0, "user", "hi!"), (1, 1, "assistant", "hey you"), (1, 3, "user", ""),
                            (None, 0, "user", "lost"), (3, 0, None, "no role")], key=str)
    assert chat.final_messages(events.limit(0)).count() == 0


def test_chat_round_trip(spark):
    draw = random.Random(9)
    parts = [*chat.CONTROL, "\\", "\\\\", " ", "\n", "a", "é😀", "[", "<", "]"]
    turns = [(c, t, draw.choice(["user", "assistant", "system", "tool", "[SAYS]", None]),
              draw.choice(["".join(draw.choices(parts, k=draw.randint(0, 12))), None]))
             for c in range(40) for t in range(draw.randint(1, 6))]
    turns += [(50, 0, "user", "same"), (50, 0, "user", "same"), (50, 0, "assistant", "tie"), (None, 1, "user", "n"),
              (51, None, "user", "no turn"), (52, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, seq int")
    rows = chat.rendered(chat.final_messages(chat.events_of_turns(df)))
    for r in rows.collect():
        bare = chat._MARKED.findall(r["formatted"][r["loss_from"]:r["loss_to"]])
        assert all(len(slashes) % 2 for slashes, _ in bare)
    found = {r["conv_id"]: r for r in chat.read_back(rows, "bigint").collect()}
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or "", role is not None, text is not None))
    assert set(found) == set(by)
    for c, own in by.items():
        own.sort(key=lambda x: (x[0], x[3], x[1], x[4], x[2]))
        learned = "".join(text for _, role, text, *_ in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text, *_ in own).encode()).hexdigest()
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(own), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(rows.limit(0), "bigint").count() == 0


def test_injected_marks(spark, small):
    found = entries.op10_chat(spark, small).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (found["n_turns"], found["loss_chars"]) == (2, len(text))
    assert found["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert found["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# -- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(8)

    def prose(n):
        return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))

    passage, leak = prose(120), prose(30)
    base = prose(150)
    near = base.rsplit(" ", 3)[0] + " x y z"
    texts = {0: prose(100), 1: base, 2: near, 3: base, 4: "12 34 56", 5: None, 6: "", 7: prose(40) + " " + passage,
             8: passage + " " + prose(40), 9: prose(50) + " " + leak + " " + prose(20), 10: prose(60)}
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t) if t else None) for i, t in texts.items()],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        left = spark.read.parquet(f"{folder}/{name}")
        ids.append(sorted(r["doc_id"] for r in left.collect()))
    assert ids == [[0, 1, 2, 3, 7, 8, 9, 10], [0, 1, 7, 8, 9, 10], [0, 1, 7, 8, 9, 10], [0, 1, 7, 8, 10]]
    cut = {r["doc_id"]: r for r in left.collect()}
    assert passage[5:-5] not in cut[7]["text"] and passage[5:-5] not in cut[8]["text"] and cut[0]["text"] == texts[0]
    assert cut[7]["n_chars"] == len(cut[7]["text"])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == ids[-1] and all(r["lossless"] for r in rows)
    for r in rows:
        wanted = reference().encode(cut[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(wanted, "<u4").tobytes()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_pipeline_cuts_passages_of_51_words(spark, small):
    def passage(words, size, mark):
        return " ".join(f"{mark}{k:0{size - 1}d}" for k in range(words))

    def own(i):
        i = "abcdefghijklmnopqrstuvwxyz"[i]
        return " ".join(f"{i}own{k}of{i}" for k in range(40))

    shared = [passage(51, 5, "p"), passage(51, 3, "q"), passage(50, 5, "r")]
    texts = [f"{own(2 * k + j)} {s} {own(20 + 2 * k + j)}" for k, s in enumerate(shared) for j in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["repeats"](spark, docs, small).collect()}
    assert [shared[i // 2] in left[i] for i in range(6)] == [False] * 4 + [True] * 2
    assert all(own(i) in left[i] and own(20 + i) in left[i] for i in range(6))


def test_pipeline_keeps_rows_without_id(spark, tmp_path):
    def prose(mark):
        return " ".join(f"{mark}{k}" for k in range(40))

    texts = [(1, "a"), (-5, "b"), (None, "c"), (None, "c"), (None, "a"), (None, "leak"), (None, "d"), (7, "e"), (7, "e")]
    rows = [(i, prose(t), "en", "s", len(prose(t))) for i, t in texts] + [(None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, prose("leak"))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def left(name, df):
        out = stages[name](spark, df, str(tmp_path))
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], r["text"] and r["text"].split()[0][:-1]) for r in out.collect()), key=str)

    assert left("near_duplicates", docs) == sorted(
        [(1, "a"), (-5, "b"), (None, "c"), (None, "leak"), (None, "d"), (7, "e"), (None, None)], key=str)
    assert left("decontamination", docs) == sorted([t for t in texts if t[1] != "leak"] + [(None, None)], key=str)


def test_pipeline_loses_no_text_to_repeated_rows(spark, tmp_path):
    """Equal rows, rows of one id with different texts, and copies without an id: one copy of each text comes out whole."""
    def prose(mark):
        return " ".join(f"{mark}word{k}of{mark}" for k in range(80))

    texts = [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "b"), (None, "d"), (None, "d"), (None, "a"), (4, "e")] + [(9, "f")] * 5
    docs = spark.createDataFrame([(i, prose(t), "en", "s", len(prose(t))) for i, t in texts],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    spark.createDataFrame([(1, prose("x"))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted(
        [("1", prose("a")), ("2", prose("b")), ("2", prose("c")), ("None", prose("d")), ("4", prose("e")), ("9", prose("f"))])
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(
        ["1", "2", "2", "None", "4", "9"])


def test_pipeline_lists_its_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "repeats", "decontamination", "tokens"]
