"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""
import hashlib
import random
import re
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import leaks, licences, minhash, shards, suffixes
from storelens.llm.suffixes import _common, agreements, decoded, front_coded, merged

DOCS = "doc_id bigint, text string, band string, node string, id int, found string"


def table(spark, rows, parts=3):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], DOCS).repartition(parts)


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- near duplicates -----------------------------------------------------------------------------------------

def shingles(text, width):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def components_of(rows, width):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=6, copies=8):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 40, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 12))):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            rows.append(" ".join(text))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = near_copies(width) + [(100, ""), (101, None), (102, " \t\n"), (103, "one"), (104, "ONE"), (105, "one two"),
                                 (106, "Ä b"), (107, "ä b"), (108, "w " * 30_000), (109, "w " * 20_000)]
    found = minhash.near_duplicates(table(spark, rows + [(None, "one"), (103, "one")]), minhash.NearDuplicates(width=width))
    wanted = components_of(rows, width)
    ours = collected(found)
    assert ours == sorted([(i, n, c, i == c) for i, (n, c) in wanted.items()] + [(None, 1, None, False)]
                          + [(103, 1, 103, True)], key=str)


@pytest.mark.parametrize("block, most, bits", [(4, 1 << 20, 32), (100, 900, 32), (8, 1 << 20, 13)])
def test_near_duplicates_in_blocks(spark, monkeypatch, block, most, bits):
    """Bands larger than a block in nodes or bytes, and digests so short that links fail on the whole sets."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", most)
    tried = []
    shorts = minhash._shorts
    monkeypatch.setattr(minhash, "_shorts", lambda *args: tried.append(1) or shorts(*args))
    rows = near_copies(3, groups=2, copies=25)
    found = minhash.near_duplicates(table(spark, rows), minhash.NearDuplicates(width=2, bits=bits))
    wanted = components_of(rows, 2)
    assert len(tried) == 1 if bits == 32 else len(tried) >= 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == wanted


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [(1, "a")]).limit(0)).count() == 0
    assert collected(minhash.near_duplicates(table(spark, [(1, None), (2, "")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_digests_never_underrate():
    draw = np.random.default_rng(4)
    for _ in range(200):
        whole = draw.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = (np.unique(draw.choice(whole, 40)) for _ in range(2))
        short = [minhash._short(x, 3, 7) for x in (a, b)]
        spare = min(len(a) - len(short[0]), len(b) - len(short[1]))
        assert len(np.intersect1d(*short)) + spare >= len(np.intersect1d(a, b))


def test_bayesian_bounds():
    """A pair at the threshold fails the whole sequence of tests less often than the stated chance per test."""
    p = minhash.NearDuplicates()
    for hashes, share in ((p.hashes, 0.6), (1000, 0.7)):
        bounds = minhash.least_matches(p, hashes)
        assert [n for n, _ in bounds] == [*range(p.batch, hashes + 1, p.batch)]
        assert all(0 <= m < 0.8 * n for n, m in bounds) and bounds[-1][1] > share * hashes


# -- repeated byte strings -----------------------------------------------------------------------------------

def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k:k + length]] += 1
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                covered[k:k + length] = True
        kept = bytes(b for b, c in zip(d, covered, strict=True) if not c)
        runs = int((covered & ~np.append(False, covered[:-1])[:len(d)]).sum())
        out.append((len(d), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


SHORT = suffixes.Repeats(length=40, anchor=9, run_bytes=4000, range_anchors=16)


def test_repeated_spans(spark):
    draw = random.Random(4)
    passages = ["".join(draw.choices("abcdé ", k=draw.randint(20, 120))) for _ in range(12)]
    texts = ["".join(draw.choice([*passages, "".join(draw.choices("abcdé ", k=30))]) for _ in range(draw.randint(0, 6)))
             for _ in range(60)]
    texts += [None, "", "short", "a" * 3000, "ab" * 700, "x" * 40, "x" * 39, texts[0], texts[0], "é" * 30]
    rows = [*enumerate(texts), (None, texts[1]), (2, texts[2])]
    found = suffixes.repeated_spans(table(spark, rows), SHORT, carry=["band"])
    ours = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"],
                   sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]),
                   hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect())
    wanted = sorted((i if i is not None else -1, *w) for (i, _), w in
                    zip(rows, brute_spans([t for _, t in rows], 40), strict=True))
    assert ours == wanted
    assert found.columns == ["doc_id", "text", "n_bytes", "spans", "kept", "kept_text", "repeats", "band"]


def test_repeated_spans_of_nothing(spark):
    assert suffixes.repeated_spans(table(spark, [(1, "a")]).limit(0)).count() == 0
    row = suffixes.repeated_spans(table(spark, [(1, "a" * 399)])).first()
    assert (row["n_bytes"], row["spans"], bytes(row["kept"]), row["kept_text"]) == (399, [], b"a" * 399, None)


def test_kept_text_leaves_split_characters_out(spark):
    texts = ["é" * 20 + "a" + "q", "è" + ("é" * 20)[1:] + "a" + "r"]
    found = suffixes.repeated_spans(table(spark, list(enumerate(texts))), SHORT).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in found] == ["q", "r"] or all("�" not in (r["kept_text"] or "") for r in found)


def word_spans(texts, length, words):
    """Bytes that must be covered (whole words on both sides) and that may be (words cut by an end count too)."""
    data = [t.encode() for t in texts]
    must, may = defaultdict(set), defaultdict(set)
    for n, d in enumerate(data):
        found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        for k in range(len(found) - words + 1):
            must[d[found[k][0]:found[k + words - 1][1]]].add((n, found[k][0]))
        for k in range(len(d) - length + 1):
            must[d[k:k + length]].add((n, k))
            may[d[k:k + length]].add((n, k))
        for k in range(len(d)):
            ahead = [a for a, _ in found if a > k]
            cut = any(a <= k < b for a, b in found)
            if len(ahead) >= words - cut:
                may[d[k:ahead[words - cut - 1] + 1]].add((n, k))
    out = []
    for windows in (must, may):
        covered = [np.zeros(len(d), bool) for d in data]
        for window, places in windows.items():
            if len(places) > 1:
                for n, k in places:
                    more = max(_common(data[n][k:], data[m][j:]) for m, j in places if (m, j) != (n, k))
                    covered[n][k:k + (more if windows is may else len(window))] = True
        out.append(covered)
    return out


def test_repeated_words(spark, monkeypatch):
    draw = random.Random(5)
    passages = [" ".join(draw.choices(["a", "bcd", "éf", "ghijk", "l\n"], k=draw.randint(6, 14))) for _ in range(10)]
    passages += ["x" * 50, "日" * 20]
    texts = ["".join(draw.choice([*passages, "".join(draw.choices("abcdé  ", k=30))]) + draw.choice(["", " ", " z "])
                     for _ in range(draw.randint(0, 6))) for _ in range(60)]
    texts += ["", "q", "1 2 3 4 5 6 7 8", "0 1 2 3 4 5 6 7 8 9", texts[0], "m n " * 40]
    p = suffixes.Repeats(length=40, anchor=9, run_bytes=4000, range_anchors=16, words=8)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    got = {r["doc_id"]: r["spans"] for r in suffixes.repeated_spans(table(spark, list(enumerate(texts))), p).collect()}
    must, may = word_spans(texts, p.length, p.words)
    for i, text in enumerate(texts):
        ours = np.zeros(len(text.encode()), bool)
        for s in got[i]:
            ours[s["start"]:s["end"]] = True
        assert (must[i] <= ours).all() and (ours <= may[i]).all(), text
    assert sum(m.sum() for m in must) > sum(n for _, n, _, _ in brute_spans(texts, p.length))
    # Reported only: what is cut are repeats of 40 bytes to the byte, and the mark follows the words as well.
    marked = {r["doc_id"]: r for r in suffixes.repeated_spans(
        table(spark, list(enumerate(texts))), replace(p, cut_words=False)).collect()}
    for i, (n_bytes, n, k, digest) in enumerate(brute_spans(texts, p.length)):
        row = marked[i]
        assert (row["n_bytes"], sum(s["end"] - s["start"] for s in row["spans"]), len(row["spans"])) == (n_bytes, n, k)
        assert hashlib.sha256(row["kept"]).hexdigest() == digest and row["repeats"] == bool(got[i])
    assert any(r["repeats"] and not r["spans"] for r in marked.values()) and not all(r["repeats"] for r in marked.values())


def test_loser_tree():
    draw = random.Random(1)
    for _ in range(100):
        blocks, everything = [], []
        for _ in range(draw.randint(1, 7)):
            entries = sorted({(bytes(draw.choices(b"ab", k=draw.randint(0, 6))), bytes(draw.choices(b"xy", k=2)))
                              for _ in range(draw.randint(1, 20))})
            blocks.append(front_coded([(r, l, 1) for r, l in entries]))
            assert [(r, l) for _, r, l, _ in decoded(blocks[-1])] == entries
            everything += [r for r, _ in entries]
        out = list(merged(blocks))
        assert [r for _, r, _, _ in out] == sorted(everything)
        assert all(b[0] == _common(a[1], b[1]) for a, b in zip(out, out[1:]))


def test_agreements():
    draw = random.Random(2)
    for _ in range(300):
        pairs = sorted({(b"AAA" + bytes(draw.choices(b"ab", k=draw.randint(0, 7))),
                         bytes(draw.choices(b"ab", k=draw.randint(0, 6)))) for _ in range(draw.randint(1, 12))})
        entries, before = [], b""
        for r, l in pairs:
            entries.append((_common(before, r), r, l, draw.choice([1, 1, 2])))
            before = r
        low, high = agreements(entries, 8)
        for i, (_, r, l, n) in enumerate(entries):
            best = [(len(l), len(r))] if n > 1 and len(l) + len(r) >= 8 else []
            best += [x for j, (_, r2, l2, _) in enumerate(entries) if i != j
                     for x in [(_common(l[::-1], l2[::-1]), _common(r, r2))] if sum(x) >= 8]
            assert (low[i], high[i]) == (max((x for x, _ in best), default=0), max((y for _, y in best), default=0))


# -- benchmark passages --------------------------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute_leaks(docs, items, span=13, misses=2, shortest=8):
    out = {}
    for item_id, item in items:
        w = words_of(item)
        if item_id is None or len(w) < shortest:
            continue
        size, least = (span, span - misses) if len(w) >= span else (len(w), len(w))
        for doc_id, text in docs:
            d = words_of(text)
            at = [k for k in range(len(d) - size + 1)
                  if any(sum(a == b for a, b in zip(d[k:k + size], w[j:j + size])) >= least
                         for j in range(len(w) - size + 1))]
            if at:
                n, lo, hi = out.get((doc_id, item_id), (0, 10**9, -1))
                out[doc_id, item_id] = (n + len(at), min(lo, at[0]), max(hi, at[-1] + size - 1))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_leaks(spark):
    draw = random.Random(6)
    vocabulary = ["the", "of", "Été", *[f"v{k}" for k in range(80)]]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([5, 8, 12, 13, 20, 60])))) for k in range(25)]
    docs = []
    for i in range(60):
        words = draw.choices(vocabulary, k=draw.randint(0, 80))
        if i % 2:
            passage = draw.choice(items)[1].upper().split()
            cut = passage[draw.randint(0, 3):]
            for _ in range(draw.randint(0, 4)):
                cut[draw.randrange(len(cut))] = draw.choice(vocabulary)
            words[len(words) // 2:len(words) // 2] = cut
        docs.append((i, ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "the " * 40_000 + items[-1][1]), (103, docs[1][1]), (None, docs[1][1])]
    items += [(90, None), (91, ""), (None, items[0][1]), (92, items[6][1])]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, words int")
    wanted = brute_leaks(docs, items)
    assert collected(leaks.leaks(table(spark, docs), bench)) == wanted
    # The same in several blocks.
    assert collected(leaks.leaks(table(spark, docs), bench, leaks.Seeds(block=100))) == wanted


def test_leaks_of_short_items(spark):
    """Items of any length, words changed in those from eight words on, and scripts without spaces, by brute force."""
    draw = random.Random(7)
    vocabulary = [f"v{k}" for k in range(60)]
    zh, th = "机器学习模型需要大量数据才能表现良好", "ภาษาไทยไม่มีช่องว่าง"
    items = [(k, " ".join(draw.choices(vocabulary, k=1 + k % 14))) for k in range(42)] + [(90, zh), (91, th), (92, "数据"),
                                                                                        (93, "?!"), (94, None)]
    docs = []
    for i in range(80):
        words = draw.choices(["x", "y", *vocabulary[:5]], k=draw.randint(0, 20))
        passage = draw.choice(items[:42])[1].split()
        for _ in range(draw.randint(0, 2)):
            passage[draw.randrange(len(passage))] = "other"
        words[len(words) // 2:len(words) // 2] = passage
        docs.append((i, " ".join(words)))
    docs += [(100, "前" + zh[:7] + "型" + zh[8:] + "后"), (101, "x" + th + "y"), (102, "数 据"), (103, None), (104, zh[:5])]

    def split(text):
        return words_of(re.sub("([\u0e00-\u0e7f\u4e00-\u9fff])", r" \1 ", text or ""))

    wanted = []
    for item_id, item in items:
        w = split(item)
        size = min(len(w), 13)
        least = size - (2 if size == 13 else 1 if size >= 8 else 0)
        for doc_id, text in docs if w else []:
            d = split(text)
            at = [k for k in range(len(d) - size + 1) if any(
                sum(a == b for a, b in zip(d[k:k + size], w[j:j + size])) >= least for j in range(len(w) - size + 1))]
            if at:
                wanted.append((doc_id, item_id, len(at), at[0], at[-1] + size - 1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert collected(leaks.leaks(table(spark, docs), bench, leaks.EVERY_ITEM)) == sorted(wanted, key=str)
    assert {(100, 90), (101, 91), (102, 92)} <= {(d, i) for d, i, *_ in wanted}


def test_leaks_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert leaks.leaks(table(spark, [(1, "a b")]), bench).count() == 0
    assert leaks.leaks(table(spark, [(1, "a b")]).limit(0), bench.limit(0)).count() == 0


# -- licences ------------------------------------------------------------------------------------------------

def brute_licences(docs, least=0.9):
    def pairs(words):
        return set(zip(words, words[1:])) if len(words) != 1 else {tuple(words)}

    templates = [(n, pairs(words_of(t))) for n, t in licences.TEMPLATES]
    out = []
    for doc_id, text in docs:
        text = text or ""
        lines = text.split("\n")
        blocks, block = [], []
        for line in lines:
            block.append(line)
            if line == "" and len(block) > 1:
                blocks.append(block)
                block = []
        units = {}
        at = 0
        offsets = []
        for line in lines:
            offsets.append((at, at + len(words_of(line))))
            at = offsets[-1][1]
        spans = set(offsets) | {(0, at)}
        begin = 0
        for k, line in enumerate(lines):
            if k and line == "":
                spans.add((begin, offsets[k][0]))
                begin = offsets[k][0]
        spans.add((begin, at))
        everything = words_of(text)
        for a, b in spans:
            best = {}
            for name, t in templates:
                own = pairs(everything[a:b])
                dice = 2 * len(own & t) / max(1, len(own) + len(t))
                if dice >= least:
                    best[name] = max(best.get(name, 0), dice)
            for name, d in best.items():
                old = units.get(name, (0, 0))
                units[name] = (max(old[0], d), old[1] + 1)
        out += [(doc_id, name, round(d, 9), n) for name, (d, n) in units.items()]
    return sorted(out, key=str)


def test_licences(spark):
    notices = [t for _, t in licences.TEMPLATES]
    docs = [(0, None), (1, ""), (2, "Nothing here.\n\nAt all."), (3, notices[0]), (4, f"a b\n{notices[4]}\nc d"),
            (5, notices[3].replace(". ", ".\n")), (6, f"x\n\n{notices[8]}\n\ny z"), (7, notices[0].upper() + "!!"),
            (8, "\n".join(notices[:6])), (9, f"{notices[0]}\n" * 3), (10, "word " * 50_000 + "\n" + notices[14]),
            (11, "MIT"), (3, notices[0]), (None, notices[1]), (12, "Licensed under the MIT License in part")]
    ours = sorted(((r[0], r[1], round(r[2], 9), r[3]) for r in licences.licences(table(spark, docs)).collect()), key=str)
    assert ours == brute_licences(docs)
    assert licences.licences(table(spark, docs).limit(0)).count() == 0


def test_licences_anywhere(spark):
    """Real files and notices among other words, against all runs of words of a template's size."""
    mit, share, warranty = [t for n, t in licences.TEMPLATES[19:] if n == "MIT"]
    header, unless = [t for n, t in licences.TEMPLATES[19:] if n == "Apache-2.0"]
    docs = [(0, f"MIT License\n\nCopyright (c) 2020 Jane\n\n{mit}\n\n{share}\n\n{warranty}\n"),
            (1, f"   {header}\r\n \r\n  http://www.apache.org/licenses/LICENSE-2.0\r\n\r\n{unless}".replace(", ", ",\n * ")),
            (2, "Copyright 2020 Jane. Released under the MIT License."), (3, "Licensed under the MIT License in part"),
            (4, "x y z\nthis is\nlicensed under the\nBSD 3-Clause License. And more of it, licensed under the BSD 3-Clause "
                "License"), (5, "under the License and the MIT"), (6, "Released under the"), (7, "MIT License."), (8, None)]
    scan = licences.LicenceScan(anywhere=True)
    ours = {(r[0], r[1]): (round(r[2], 9), r[3]) for r in licences.licences(table(spark, docs), scan).collect()}
    wanted = {}
    for name, template in licences.TEMPLATES:
        own = words_of(template)
        own_pairs = set(zip(own, own[1:]))
        for doc_id, text in docs:
            w = words_of(text)
            pairs = list(zip(w, w[1:]))
            best = max((2 * len(own_pairs & set(pairs[a:b])) / (len(own_pairs) + len(set(pairs[a:b])))
                        for a in range(len(pairs)) if pairs[a] in own_pairs
                        for b in range(a + 1, min(len(pairs), a + 2 * len(own)) + 1)), default=0)
            if best >= 0.9:
                wanted[doc_id, name] = max(wanted.get((doc_id, name), 0), round(best, 9))
    assert {k: d for k, (d, _) in ours.items()} == wanted
    assert {(0, "MIT"), (1, "Apache-2.0"), (2, "MIT"), (3, "MIT"), (4, "BSD-3-Clause")} <= set(ours)
    assert ours[4, "BSD-3-Clause"] == (1.0, 2) and not {k for k in ours if k[0] > 4}


# -- shards --------------------------------------------------------------------------------------------------

def test_shards(spark, tmp_path):
    rows = [(i, f"text {i % 7}" * (i % 50)) for i in range(1003)] + [(None, None), (5, None), (5, None), (6, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id bigint, text string, slot int").repartition(5)
    p = shards.Sharding(shards=8, bucket_bytes=20_000)
    found = shards.write_shards(docs, str(tmp_path / "a"), p)
    by = defaultdict(list)
    for r in found.collect():
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(8)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(((r[0], r[1]) for r in found.select("doc_id", "text").collect()), key=str) == sorted(rows, key=str)
    again = shards.shuffled(docs.repartition(2), p).select("doc_id", "text", "shard", "slot").distinct()
    assert collected(again) == collected(found.select("doc_id", "text", "shard", "slot"))
    other = shards.shuffled(docs, shards.Sharding(shards=8, bucket_bytes=20_000, seed=12))
    assert collected(other.select("doc_id", "shard")) != collected(found.select("doc_id", "shard"))
    empty = shards.shuffled(docs.limit(0), p)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "shard", "slot"]


def test_fisher_yates_is_uniform():
    counts = defaultdict(int)
    for seed in range(6000):
        counts[tuple(shards.fisher_yates(3, [seed]))] += 1
    assert len(counts) == 6 and all(850 < n < 1150 for n in counts.values())


def test_row_size(spark):
    sizes = table(spark, [(1, None), (2, ""), (3, "é")]).select("doc_id", shards.row_size(shards.Sharding()).alias("n"))
    assert collected(sizes.orderBy(F.col("doc_id"))) == [(1, 16), (2, 16), (3, 18)]
