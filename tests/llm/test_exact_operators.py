"""Manifest trees, vector codes and top-k search against brute force in plain Python."""
import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import codes, entries, integers, maxscore, merkle

NAN, INF = float("nan"), float("inf")


# -- manifest ------------------------------------------------------------------------------------------------

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, at int, n int, digest string, path string"


def digest(row):
    def one(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha256("".join(one(row.get(f)) for f in FIELDS).encode()).hexdigest()


def lower(row):
    text = row.get("text")
    return row | {"text": None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)}


def climb(nodes, fanout):
    """(root, path of every leaf as pairs of digest lists)."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, spot in enumerate(spots):
            run, own = spot // fanout * fanout, spot % fanout
            paths[leaf] += ["".join(nodes[run:run + own]), "".join(nodes[run + own + 1:run + fanout])]
        nodes = [sha256("".join(nodes[k:k + fanout]).encode()).hexdigest() for k in range(0, len(nodes), fanout)]
        spots = [s // fanout for s in spots]
    return nodes[0], paths


def manifest_by_hand(rows, fanout=16):
    """Sorted rows of an audit."""
    groups = {}
    for row in rows:
        picked = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        claim = digest(lower(row)) if picked else digest(row)
        groups.setdefault(row["source"], []).append((row["doc_id"], digest(row), claim))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees[name] = climb([r[1] for r in groups[name]], fanout)
    if not names:
        return []
    root, upper = climb([trees[name][0] for name in names], fanout)
    found = []
    for name, above in zip(names, upper):
        subroot, paths = trees[name]
        for (key, leaf, claim), path in zip(groups[name], paths):
            whole, node = path + above, claim
            for k in range(0, len(whole), 2):
                node = sha256((whole[k] + node + whole[k + 1]).encode()).hexdigest()
            found.append((key, leaf, subroot, root, sha256("".join(whole).encode()).hexdigest(), node, node == root))
    return sorted(found, key=repr)


def documents(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in FIELDS[:1] + ["text", "lang", "source", "n_chars"]) + ("g", 1, 2, "d", "p")
                                  for r in rows], DOCS).repartition(3)


def audit(spark, rows, tree):
    df = documents(spark, rows)
    tampered = merkle.row_digest([*FIELDS[:-1], merkle.ascii_lower(F.col("text"))])
    made = merkle.Manifest(df, FIELDS, "source", "doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered), tree)
    return made, sorted(map(tuple, made.audit().collect()), key=repr)


@pytest.mark.parametrize("tree", [merkle.Tree(2, 4), merkle.Tree(3, 2), merkle.Tree(16, 3)])
def test_manifest_by_hand(spark, tree):
    rng = random.Random(5)
    sources = ["hot"] * 6 + ["a", None, "", "-", "é", "z", *(f"s{k}" for k in range(20))]
    rows = [{"doc_id": k, "source": rng.choice(sources), "lang": rng.choice(["en", None, ""]), "n_chars": rng.choice([None, 0, -5, 10**12]),
             "text": rng.choice([None, "", "ABC déjà ÀÉ", "abc", f"Text {k}", "x" * 5 + "漢字", "Wort " * 20_000])} for k in range(160)]
    rows += [rows[3], rows[3], rows[7], {"doc_id": None, "source": "a"}, {"doc_id": None, "source": "a", "text": "B"},
             {"doc_id": 7, "source": "hot", "text": "another of id 7"}]
    made, found = audit(spark, rows, tree)
    assert found == manifest_by_hand(rows, tree.fanout)
    assert not all(r[-1] for r in found) and sum(r[-1] for r in found) > 100
    assert {(r["source"], r["subroot"]) for r in made.subroots().collect()} == {
        (next(x["source"] for x in rows if digest(x) == r[1]), r[2]) for r in found}
    for row in made.proofs().collect():
        assert merkle.folded(row["leaf"].encode(), [t.encode() for t in row["path"]]).decode() == made.root


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [{"doc_id": k, "source": "one", "text": "T"} for k in range(n)]
    assert audit(spark, rows, merkle.Tree(16, 1))[1] == manifest_by_hand(rows)


def test_manifest_of_nothing(spark):
    made, found = audit(spark, [], merkle.Tree())
    assert found == [] and made.root is None and made.subroots().count() == 0


def test_addresses_are_dense_and_halved():
    for fanout, levels in ((2, 1), (2, 2), (2, 5), (3, 4), (16, 4)):
        tree = merkle.Tree(fanout, levels - 1)
        for n in {1, 2, fanout, fanout + 1, tree.span - 1, tree.span} & set(range(1, tree.span + 1)):
            count, found = n, []
            for level in range(levels):
                found.append(tree.address(levels, n, level, np.arange(count)))
                count = -(-count // fanout)
            assert sorted(np.concatenate(found).tolist()) == list(range(tree.size(levels, n)))
            assert found[-1].tolist() == [0]
    # Five levels of two: the upper two first, then each subtree of three, which begins with its root.
    tree = merkle.Tree(2, 4)
    assert tree.address(5, 16, 3, np.arange(2)).tolist() == [1, 2]
    assert tree.address(5, 16, 2, np.arange(4)).tolist() == [3, 10, 17, 24]
    assert tree.address(5, 16, 0, np.arange(4)).tolist() == [5, 6, 8, 9]


def test_manifest_notices_every_change(spark, small):
    found = entries.op11_merkle(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for row in found:
        text = docs[row["doc_id"]]
        changed = zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert row["verified"] != changed


# -- codes ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, v string, code string, size int"


def exact_floor(x, scale):
    return math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale


def codes_by_hand(rows, p):
    kept = [(i, [exact_floor(x, p.scale) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for size in {len(v) for _, v, _ in kept}:
        own = [r for r in kept if len(r[1]) == size]
        cuts = p.bounds(size)
        ids = {}
        for i, v, _ in sorted((r for r in own if r[0] is not None), key=lambda r: r[:2]):
            ids.setdefault(i, v)
        first = [ids[i] for i in sorted(ids)[:p.entries]]
        books = [[v[cuts[k]:cuts[k + 1]] for v in first] for k in range(p.parts)]

        def assign():
            return [[min((sum((a - b) ** 2 for a, b in zip(v[cuts[k]:cuts[k + 1]], e)), n) for n, e in enumerate(books[k]))
                     for k in range(p.parts)] for _, v, _ in own]
        if not first:
            out += [(i, None, None, label, None) for i, _, label in own]
            continue
        for _ in range(p.rounds):
            nearest = assign()
            for k in range(p.parts):
                for n in range(len(books[k])):
                    members = [own[r][1][cuts[k]:cuts[k + 1]] for r in range(len(own)) if nearest[r][k][1] == n]
                    if members:
                        books[k][n] = [sum(xs) // len(members) for xs in zip(*members)]
        digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        out += [(i, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best), label, digest)
                for (i, _, label), best in zip(own, assign())]
    most = 2**63 - 1
    out = [(i, c, None if e is None else min(e, most), label, d) for i, c, e, label, d in out]
    total = {}
    for _, _, e, label, _ in out:
        if e is not None:
            total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, None if label not in total else min(total[label], most), d) for i, c, e, label, d in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "v", "c", 9) for r in rows], VECTORS).repartition(3)


def test_codes_by_hand(spark):
    rng = random.Random(3)
    near = [[rng.gauss(0, 0.1) for _ in range(24)] for _ in range(6)]
    rows = [(k, [x + rng.gauss(0, 0.02) for x in rng.choice(near)], rng.choice([1, 2, None])) for k in range(200)]
    rows += [(500, None, 1), (501, [1.0] * 23 + [None], 1), (502, [NAN] * 24, 2), (503, [INF] * 24, 2), rows[1], rows[1], rows[150],
             (3, [0.0] * 24, None), (None, [-0.5] * 24, 1), (504, [0.25] * 24, 7), (505, [-1 / 4096] * 24, 7)]
    p = codes.CodeParameters()
    found = codes.coded(vectors(spark, rows), p)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == codes_by_hand(rows, p)


def test_codes_of_odd_vectors(spark):
    """Other sizes, few vectors, no components, numbers of any magnitude, only null ids in a size, more than 64 entries."""
    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(5)], 1) for k in range(10)]
    rows += [(k, [rng.gauss(0, 10.0 ** rng.choice([0, 3, 30, 300])) for _ in range(16)], 2) for k in range(20, 60)]
    rows += [(70, [], None), (71, [], None), (72, [1.5], 3), (None, [1.0, 2.0], 3), (None, [3.0, 2.0], None)]
    p = codes.CodeParameters(rounds=3)
    assert sorted(map(tuple, codes.coded(vectors(spark, rows), p).collect()), key=repr) == codes_by_hand(rows, p)
    many = codes.CodeParameters(entries=130, rounds=1, parts=2)
    rows = [(k, [rng.random() for _ in range(6)], k % 3) for k in range(150)]
    assert sorted(map(tuple, codes.coded(vectors(spark, rows), many).collect()), key=repr) == codes_by_hand(rows, many)
    assert codes.coded(vectors(spark, rows[:0])).collect() == []


def test_candidates_are_the_box():
    rng = np.random.default_rng(1)
    entries_ = rng.integers(-40, 40, (100, 4))
    index = codes.Slices(entries_)
    parts, radius = rng.integers(-40, 40, (50, 4)), rng.integers(0, 60, 50)
    masks = index.candidates(parts, radius)
    for part, r, mask in zip(parts, radius, masks):
        inside = {e for e in range(100) if (np.abs(entries_[e] - part) <= r).all()}
        assert inside == {e for e in range(100) if int(mask[e // 64]) >> e % 64 & 1}
    best, squares = index.nearest(parts)
    every = ((parts[:, None] - entries_) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()


# -- search --------------------------------------------------------------------------------------------------

def search_by_hand(rows, k, every, scale=256):
    kept = [(i, [exact_floor(x, scale) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, integers.as_long(-s)) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("p", [maxscore.SearchParameters(), maxscore.SearchParameters(shard_bytes=4096, block_bytes=1024, tasks=6)])
def test_search_by_hand(spark, p):
    rng = random.Random(8)
    near = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.03) for x in rng.choice(near)], 0) for k in range(300)]
    rows += [(k, [rng.choice([0.0] * 6 + [0.5, -0.25, 1 / 256]) for _ in range(16)], 0) for k in range(300, 400)]
    rows += [(k, [0.5] * 16, 0) for k in range(400, 420)] + [(420, [-0.5] * 16, 0), (430, [0.0] * 16, 0)]
    rows += [(440, None, 0), (450, [None] * 16, 0), (460, [NAN] * 16, 0), (470, [INF] * 16, 0), (None, [0.3] * 16, 0), rows[10], rows[10],
             (480, [1.0, 2.0], 0), (481, [1.0, 2.0], 0), (490, [], 0), (491, [], 0), (500, [3.0] * 7, 0)]
    found = maxscore.highest(vectors(spark, rows), F.col("vec_id") % 10 == 0, p)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == search_by_hand(rows, 5, 10)


def test_search_at_any_magnitude(spark):
    rng = random.Random(9)
    rows = [(k, [rng.choice([-1, 1]) * 10.0 ** rng.choice([-3, 0, 9, 30, 300]) for _ in range(6)], 0) for k in range(60)]
    found = maxscore.highest(vectors(spark, rows), F.col("vec_id") % 10 == 0, maxscore.SearchParameters(shard_bytes=480, tasks=2))
    assert sorted(map(tuple, found.collect())) == search_by_hand(rows, 5, 10)


def test_search_of_nothing(spark):
    rows = [(k, [1.0, 2.0], 0) for k in range(1, 4)]
    for given in (rows, rows[:0], [(10, [1.0], 0)]):
        assert maxscore.highest(vectors(spark, given), F.col("vec_id") % 10 == 0).collect() == []


def test_terms_without_essential_postings_are_skipped():
    """A row found in non-essential lists only is never scored; one that ties is."""
    weights = np.array([[9, 0, 0], [0, 2, 1], [0, 0, 3], [8, 2, 0]])
    shard = maxscore.Shard(np.arange(4), np.arange(4), weights)
    at, scores = shard.competing(np.array([10, 1, 1]), 80)
    assert at.tolist() == [0, 3] and scores.tolist() == [90, 82]
    at, scores = shard.competing(np.array([10, 1, 1]), 90)
    assert at.tolist() == [0] and scores.tolist() == [90]


def test_blocks_do_not_pass_the_driver(spark):
    """However small the files of the blocks, what they are multiplied to meets the shards by exchange."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=4)], 0) for k in range(60)]
    found = maxscore.highest(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert len(found.collect()) == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
