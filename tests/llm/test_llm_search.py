"""Ranked search, vector codes and SimHash classes against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempest.llm import ranked, simhash, vectorcode
from tempest.session import run_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ------------------------------------------------------------------ ranked search

def plain_search(docs, items, k=10):
    found = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(TERM.findall(lower(text or ""))) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


ITEMS = [(1, "This LINE is shared by many documents"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (None, "été 日本語 abc"),
         (5, "own line of seven own"), (5, "own line of seven own"), (6, "a b c d e f g h i j bad cab fad")]


def ranked_rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("shard_terms", [50, 1 << 20])
@pytest.mark.parametrize("query_terms", [3, 1 << 18])
def test_search_equals_brute_force(spark, odd_docs, odd_rows, shard_terms, query_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.search(odd_docs, items, query_terms=query_terms, shard_terms=shard_terms)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert ranked_rows(got) == plain_search([(r[0], r[1]) for r in odd_rows], ITEMS)


def test_search_items_of_the_texts_themselves(spark, odd_docs, odd_rows):
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text", F.lit("x").alias("terms"), F.lit("y").alias("q"))
    want = plain_search([(r[0], r[1]) for r in odd_rows], [(r[0], r[1]) for r in odd_rows], 3)
    assert ranked_rows(ranked.search(odd_docs, items, 3, shard_terms=500)) == want


def test_search_empty_tables(spark, odd_docs, no_docs, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(no_docs, items).count() == 0
    assert ranked.search(odd_docs, items.limit(0)).count() == 0
    assert ranked.search(odd_docs.where("doc_id = 5"), items).count() == 0
    assert ranked_rows(ranked.search(clashing, items)) == ranked_rows(ranked.search(odd_docs, items))


def test_best_equals_dense_and_skips():
    rng = np.random.default_rng(1)
    n, n_blocks = 5000, -(-5000 // ranked.BLOCK)
    added = 0
    for case in range(60):
        lists, dense = [], np.zeros(n, np.int64)
        for size in rng.choice([1, 3, 20, 200, 2500, 5000], 8):
            docs = np.sort(rng.choice(n, size, replace=False)).astype(np.int32)
            scores = rng.integers(0, 1 + 20000 // size + case % 3, size)
            dense[docs] += scores
            lists.append(ranked._List(docs, scores.astype(np.int64), n_blocks))
        docs, scores = ranked.best(lists, n, 10)
        order = sorted(np.flatnonzero(dense > 0), key=lambda i: (-dense[i], i))[:10]
        assert docs.tolist() == order and scores.tolist() == dense[order].tolist()
        added += len(order)
    assert added


def test_best_leaves_blocks_unread():
    """A rare term decides: blocks of the common list that cannot reach the tenth score are not touched."""
    n = 64 * ranked.BLOCK
    touched = []

    class Watched(ranked._List):
        def __getattribute__(self, name):
            if name == "docs":
                touched.append(1)
            return super().__getattribute__(name)

    common = Watched(np.arange(n, dtype=np.int32), np.ones(n, np.int64), 64)
    rare = ranked._List(np.arange(20, dtype=np.int32) * 3, np.full(20, 100, np.int64), 64)
    touched.clear()
    docs, scores = ranked.best([common, rare], n)
    assert docs.tolist() == [3 * i for i in range(10)] and set(scores) == {101}
    assert len(touched) < 10


def test_length_norm_beyond_64_bits():
    n = np.array([1, 10 ** 9], np.int64)
    assert ranked.length_norm(n, 10 ** 12, 10 ** 15).tolist() == [8 * (10 + 90 * int(x) * 10 ** 12 // 10 ** 15) for x in n]


# ------------------------------------------------------------------ vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd in Python integers; rows (vec_id, vector, label) of one length."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * x) for x in v[p * d:(p + 1) * d]] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            to = [k for _, k in assign(p)]
            for k in range(len(books[p])):
                members = [c[p] for c, t in zip(cut, to, strict=True) if t == k]
                if members:
                    books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(last[p][i][0] for p in range(parts)) for i in range(len(kept))]
    label = Counter()
    for r, e in zip(kept, error, strict=True):
        label[r[2]] += e
    return Counter((r[0], "".join(f"{last[p][i][1]:02x}" for p in range(parts)), error[i], label[r[2]], digest) for i, r in enumerate(kept))


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n, dim=16, seed=5):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i * 3, [f32(rng.gauss(i % 5, 1)) for _ in range(dim)], i % 4) for i in range(n)]
    rows += rows[:3] + rows[:1]  # repeated rows
    rows += [(rows[7][0], rows[8][1], 1), (None, rows[9][1], None), (None, None, 1), (5, [None] * dim, 2), (7, [float("nan")] * dim, 2),
             (11, [float("inf")] + [0.0] * (dim - 1), 2), (13, [0.0] * dim, None), (14, rows[20][1], None)]
    rng.shuffle(rows)
    return rows


def code_rows(df):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("members", [7, 1 << 16])
def test_codes_equal_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(vectorcode, "BLOCK_MEMBERS", members)
    rows = vector_rows(120)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    extra = [F.lit(f"mine-{c}").alias(c) for c in ("row", "code", "error", "position", "entry", "salt", "vector", "n")]
    got = vectorcode.compress(table.select("*", *extra))
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    assert code_rows(got) == plain_codes(rows)


def test_codes_of_few_rows(spark):
    assert vectorcode.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vectorcode.compress(spark.createDataFrame([(1, None, 2)], VECTORS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [r for r in vector_rows(25) if r[0] in (0, 3, 6)]
    assert code_rows(vectorcode.compress(spark.createDataFrame(rows, VECTORS))) == plain_codes(rows)


def test_odd_vectors(spark):
    rows = [(1, [], 0), (2, [1.0] * 5, 0), (3, [1.0] * 9, 0), (4, [1e30] * 9, 0), (5, [-1e30] * 9, None)]
    got = {r["vec_id"]: r for r in vectorcode.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == 5 and all(r["error"] == 0 for r in got.values())  # each is its own entry
    assert got[1]["code"] == "00" * 8 and got[2]["code"] != got[3]["code"]
    x = vectorcode.to_integers([[-0.0001, 0.0001]], 8)
    assert x[0].tolist() == [-1, 0, 0, 0, 0, 0, 0, 0]


def test_only_movers_are_shuffled(spark):
    """A part that keeps its entry stays in its block; the packets of a round hold those that change."""
    rng = np.random.default_rng(2)
    books = rng.integers(-50, 50, (8, 4, 2))
    parts = rng.integers(-50, 50, (500, 2))
    start = vectorcode.nearest(parts, books[0])[0]
    block = vectorcode._record_batch([vectorcode._block(0, int(e), 0, False, np.flatnonzero(start == e), parts[start == e]) for e in np.unique(start)])
    moved = books + rng.integers(-9, 9, books.shape)
    out = [r for b in vectorcode._assign(moved)([block]) for r in b.to_pylist()]
    end = vectorcode.nearest(parts, moved[0])[0]
    assert sum(r["n"] for r in out) == 500
    assert sum(r["n"] for r in out if r["moved"]) == int((start != end).sum()) > 0
    for r in out:
        ids = np.frombuffer(r["rows"], np.int64)
        assert (end[ids] == r["entry"]).all() and r["sums"] == parts[ids].sum(axis=0).tolist()


# ------------------------------------------------------------------ SimHash

def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    """Root index of each fingerprint (all pairs)."""
    x = np.array(fps, np.uint64)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def plain_near(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root, least = plain_components(fps), {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root, strict=True))


def near_rows(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def test_near_duplicates_equal_brute_force(spark, odd_docs, odd_rows, clashing, no_docs):
    want = plain_near([(r[0], r[1]) for r in odd_rows])
    assert near_rows(simhash.near_duplicates(odd_docs)) == want
    assert near_rows(simhash.near_duplicates(clashing.withColumn("fp", F.lit("mine")))) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert near_rows(simhash.near_duplicates(docs)) == plain_near(rows)


def test_fingerprint_is_the_engines_hash(spark):
    """Spark's xxhash64 of strings is XXH64 with seed 42: one-shingle texts show the hash itself."""
    df = spark.createDataFrame([("One two\tthree",), ("x" * 500,), ("日本 Été z",)], "text string")
    rows = df.select("text", F.hex(F.xxhash64(F.regexp_replace(F.translate("text", "OETZ", "oetz"), r"\s+", " "))).alias("h")).collect()
    assert f"{simhash.fingerprint(rows[0][0]):X}" == rows[0][1] and f"{simhash.fingerprint(rows[1][0]):X}" == rows[1][1]


def flip(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


@pytest.mark.parametrize("unit", [16, 1024])
def test_classes_of_dense_and_sparse_fingerprints(spark, monkeypatch, unit):
    """Random ones, chains at distance exactly 4 and 5, one dense group, and a group that shares half its bits."""
    monkeypatch.setattr(simhash.verify, "__defaults__", (unit, simhash.RADIUS))
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(400)]
    for d in (4, 5):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            x = flip(x, rng.sample(range(64), d))
    centre = rng.getrandbits(64)
    fps += [flip(centre, rng.sample(range(64), rng.randint(0, 7))) for _ in range(500)]
    fps += [centre >> 32 << 32 ^ rng.getrandbits(32) for _ in range(500)]
    fps = list(dict.fromkeys(fps))
    rng.shuffle(fps)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    rows += [(10_000 + i, f) for i, f in rows[:50]]
    got = {r["fp"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long"), run_folder(spark, "t")).collect()}
    assert [got[f] for _, f in rows[:len(fps)]] == plain_components(fps)


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_thresholds_meet_every_link(m):
    """The units add up, every pair within the radius shares a probed key, and common values are probed less."""
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    base[:150] = base[0] ^ (base[:150] & np.uint64(0xFFFFF))  # a common upper part
    bits = simhash.bits_of(base)
    together = (bits.astype(float).T @ bits).astype(float)
    g = simhash.Groups(simhash.group_bits(together, len(base), m), len(base))
    assert sorted(b for x in g.groups for b in x) == list(range(64)) and len(g.groups) == m
    g.set_counts([np.bincount(g.pick(bits, w), minlength=1 << len(w)) for _, w in g.chunks])
    t = g.thresholds(bits)
    assert ((t + 1).sum(axis=1) == simhash.RADIUS + 1).all() and t.min() >= -1
    assert len(np.unique(t, axis=0)) > 1 or m == 5
    for x, tx in zip(base[::10], t[::10], strict=True):
        for _ in range(40):
            y = np.uint64(flip(int(x), rng.choice(64, rng.integers(0, 5), replace=False).tolist()))
            two = simhash.bits_of(np.array([x, y]))
            assert any((two[0, w] != two[1, w]).sum() <= r for w, r in zip(g.groups, tx, strict=True))


def test_allocation_is_the_least(monkeypatch):
    rng = np.random.default_rng(4)
    costs = [np.vstack([np.zeros(20), np.sort(rng.integers(1, 100, (4, 20)), axis=0)]) for _ in range(3)]
    t, cost = simhash.allocate(costs)
    for i in range(20):
        every = [costs[0][a][i] + costs[1][b][i] + costs[2][5 - a - b][i]
                 for a in range(5) for b in range(5) if 0 <= 5 - a - b < 5]
        assert cost[i] == min(every) == sum(c[t[i, k] + 1][i] for k, c in enumerate(costs))


def test_spheres_count_neighbours():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 5, 1 << 8)
    s = simhash.spheres(counts, 8)
    for v in (0, 77, 255):
        d = np.bitwise_count(np.arange(256) ^ v)
        assert [s[t][v] for t in range(5)] == [counts[d == t].sum() for t in range(5)]
