"""Tokeniser fertility, toxicity and the pipeline against plain versions and held-out rows."""

import base64
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tempest.llm import fertility, toxicity

RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ------------------------------------------------------------------ fertility


@pytest.fixture(scope="module")
def libraries():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return (tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}),
            sentencepiece.SentencePieceProcessor(model_file=PIECES))


def plain_repeats(w, n=8):
    at = defaultdict(list)
    for i in range(len(w) - n + 1):
        at[tuple(w[i:i + n])].append(i)
    return len({k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + n)})


def plain_figures(text, bpe, sp):
    text = text or ""
    w = WORD.findall(text)
    ids = [i for x in w for i in bpe.encode_ordinary(" " + x)]
    pieces = [i for x in w for i in sp.encode(x)]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values())
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, plain_repeats(w), len(ids), len(pieces),
            sum(sp.is_byte(i) for i in pieces), entropy)


def test_figures_are_those_of_the_libraries(libraries, odd_rows):
    with open(RANKS, "rb") as a, open(PIECES, "rb") as b:
        enc = fertility.Encoders(a.read(), b.read(), public_tokenizers.PATTERN)
    texts = [t or "" for _, t, *_ in odd_rows]
    texts += ["a b c d e f g h " * 3, "x " * 40, "a b c d e f g h i a b c d e f g h", "# * | <>&$%\n# * | <>&$%\n\n\n \n ", "日本 　 x y"]
    got = list(zip(*fertility.measure(texts, enc), strict=True))
    for g, t in zip(got, texts, strict=True):
        want = plain_figures(t, *libraries)
        assert tuple(map(int, g[:-1])) == want[:-1] and g[-1] == pytest.approx(want[-1], abs=1e-9)


def test_judgements_are_those_of_plain_bands(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("entropy", F.lit("mine"))
    got = {r.doc_id: r for r in fertility.judged(docs, RANKS, PIECES, public_tokenizers.PATTERN).collect()}
    rows = {}
    for r in docs.collect():
        f = plain_figures(r.text, *libraries)
        base = f[0] < 20 or 100 * f[4] > 30 * f[0]
        n = max(f[5], 1)
        rows[r.doc_id] = (r.lang, f, base, {"a": f[1] / n, "b": f[1] / max(f[6], 1), "e": f[8]}, math.floor(math.log2(n)))
    groups = defaultdict(list)
    for lang, _, base, m, k in rows.values():
        if not base:
            groups[lang, "a"].append(m["a"])
            groups[lang, "b"].append(m["b"])
            groups[lang, "e", k].append(m["e"])
    bands = {}
    for g, v in groups.items():
        v = sorted(math.floor(x * 200 + 0.5) for x in v)
        med = v[(len(v) - 1) // 2]
        d = sorted(abs(x - med) for x in v)
        bands[g] = med / 200, d[(len(d) - 1) // 2] / 200 * 1.4826
    wrong = 0
    for i, (lang, f, base, m, k) in rows.items():
        keep = not base
        for g in ((lang, "a"), (lang, "b")):
            if keep and g in bands:
                med, dev = bands[g]
                keep = abs(m[g[1]] - med) <= max(6 * dev, 0.03 * med) * math.sqrt(1 + 50 / max(f[5], 1))
        if keep and (lang, "e", k) in bands:
            med, dev = bands[lang, "e", k]
            keep = med - m["e"] <= max(5 * dev, 0.7)
        keep = keep and f[7] <= 0.3 * f[6]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f[:5] and r.base_failed == base
        wrong += r.kept != keep
    assert wrong == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed]
    assert sum(kept) / len(kept) > 0.97


def test_fertility_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = fertility.judged(odd_docs, RANKS, PIECES, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert fertility.judged(no_docs, RANKS, PIECES, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ toxicity

@pytest.mark.parametrize("few", [0, 4])
def test_block_max_search_is_exact(monkeypatch, few):
    monkeypatch.setattr(toxicity, "FEW_POSTINGS", few)
    rng, terms, n = np.random.default_rng(1), 60, 1500
    vectors = []
    for _ in range(n):
        t = sorted(rng.choice(terms, rng.integers(0, 7), replace=False).tolist())
        vectors.append((t, [int(x) for x in rng.integers(1, 4, len(t))]))
    idf = rng.uniform(1, 8, terms)
    ix = toxicity.BlockMaxIndex(list(range(n)), [int(x) for x in rng.integers(0, 2, n)], vectors, idf, block=16)
    full = np.zeros((n, terms))
    for i, (t, c) in enumerate(vectors):
        full[i, t] = toxicity.weights(np.array(t, int), np.array(c, float), idf)
    for i in range(200):
        t, c = vectors[i]
        at, cosine = ix.search(t, c, 15, without=i)
        want = full @ full[i]
        want[i] = 0
        order = np.argsort(-want)[:15]
        assert np.allclose(np.sort(want[order][want[order] > 0]), np.sort(cosine))
        assert np.allclose(want[ix.ids[at]], cosine) and i not in ix.ids[at]


@pytest.mark.parametrize("few", [0, 4, 10 ** 6])
def test_search_with_long_lists_reads_less_than_all(monkeypatch, few):
    """Examples in groups with words of their own and common words: exact, and few postings are read."""
    rng, words, n = np.random.default_rng(2), 400, 3000
    vectors = []
    for i in range(n):
        own = 100 + (i % 30) * 10 + rng.choice(10, 6, replace=False)
        t = np.unique(np.concatenate([rng.choice(100, 40, replace=False), own]))
        vectors.append((t, np.where(t >= 100, rng.integers(2, 5, len(t)), 1)))
    idf = np.where(np.arange(words) < 100, rng.uniform(0.2, 0.5, words), rng.uniform(5, 8, words))
    monkeypatch.setattr(toxicity, "FEW_POSTINGS", few)
    ix = toxicity.BlockMaxIndex(list(range(n)), [i % 2 for i in range(n)], vectors, idf)
    full = np.zeros((n, words))
    for i, (t, c) in enumerate(vectors):
        full[i, t] = toxicity.weights(t, c.astype(float), idf)
    postings = 0
    for i in range(0, n, 30):
        at, cosine = ix.search(*vectors[i], 15, without=i)
        want = full @ full[i]
        want[i] = 0
        assert np.allclose(np.sort(want)[::-1][:15], cosine) and np.allclose(want[ix.ids[at]], cosine)
        postings += int(np.diff(ix.ptr)[vectors[i][0]].sum())
    assert ix.touched == postings if few == 10 ** 6 else ix.touched < 0.4 * postings


def test_calibration_rises_with_the_vote():
    counts = np.zeros((toxicity.BINS + 1, 2))
    counts[0], counts[3], counts[9], counts[20] = (90, 10), (5, 20), (30, 10), (1, 40)
    p = toxicity.calibrate(counts, np.array([1.0, 1.0]))
    assert (np.diff(p[1:]) >= 0).all() and ((0 < p) & (p < 1)).all() and p[20] > 0.9 > p[0]
    assert (toxicity.calibrate(np.zeros((toxicity.BINS + 1, 2)), np.array([1.0, 1.0])) == 0.25).all()


def auc(y, s):
    _, where, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[where]
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score(docs.drop("lang"), labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in toxic if got[i].held_out]
    assert auc([toxic[i] for i in held], [got[i].score for i in held]) > 0.93
    shown = [e for r in got.values() for e in r.evidence]
    assert shown and all(not got[e.doc_id].held_out and toxic[e.doc_id] == e.toxic for e in shown)


def test_copies_of_one_text_teach_no_words(spark):
    """All the words of a toxic text with many copies are not signs of toxicity."""
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    copied = "special " * 3 + noise(20) + " insult " + noise(5)
    rows = [(copied, 1)] * 60 + [(noise(20) + " insult " + noise(20), 1) for _ in range(60)] + [(noise(40), 0) for _ in range(400)]
    chosen = toxicity.choose_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert "=insult" in chosen and "=special" not in chosen


def test_copies_of_a_long_text_leave_room_for_words(spark):
    """A long toxic text with many copies has more terms than are ever chosen; real signs are still found."""
    rng = np.random.default_rng(5)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    rare = ["".join(x) for x in rng.choice(list("abcdefghij"), (3000, 9))]
    rows = [(" ".join(rare), 1)] * 300 + [(noise(20) + " insult " + noise(20), 1) for _ in range(60)] + [(noise(40), 0) for _ in range(400)]
    chosen = toxicity.choose_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert "=insult" in chosen and not {"=" + w for w in rare} & set(chosen)


def test_all_significant_terms_are_chosen(spark):
    """Neither their number nor a lift below 2 keeps terms out."""
    rng = np.random.default_rng(7)
    signs = ["".join(x) for x in rng.choice(list("abcdefghij"), (400, 9))]
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    often = lambda share: " common " if rng.random() < share else " "
    rows = [(noise(20) + often(0.8) + " ".join(rng.choice(signs, 100, replace=False)), 1) for _ in range(300)]
    rows += [(noise(20) + often(0.5) + noise(20), 0) for _ in range(300)]
    chosen = set(toxicity.choose_terms(spark.createDataFrame(rows, "text string, toxic int")))
    assert {"=" + w for w in signs} <= chosen and "=common" in chosen


def test_toxicity_of_odd_tables(spark, clashing, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(clashing, labels).collect()
    assert len(got) == clashing.count() and {r.held_out for r in got if r.doc_id is None} == {True}
    kept = toxicity.reject(clashing, labels)
    assert kept.columns == clashing.columns
    assert {r.score for r in toxicity.score(clashing, labels.limit(0)).collect()} == {0.25}
    assert toxicity.score(no_docs, labels).count() == 0 and toxicity.reject(no_docs, labels).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    from .test_llm_dedup import grams
    from .test_llm_native import plain_lines

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = {"in": docs.collect()}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns or k == 4
        seen[name] = docs.collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect() if r.predicted}
    assert bad and {r.doc_id for r in seen["toxicity"]} == {r.doc_id for r in seen["in"]} - bad
    import hashlib
    lines = {i: sha for (i, _, _, sha) in plain_lines([tuple(r) for r in seen["toxicity"]])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in seen["line dedup"]} == lines
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"])
    sets = {r.doc_id: grams(r.text) for r in seen["line dedup"]}
    left = {r.doc_id for r in seen["near duplicates"]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * (both := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert left == {find(i) for i in sets} and len(left) < len(sets)
    times = Counter(r.doc_id for r in seen["mixing"])
    assert set(times) <= left and max(times.values()) <= 3
    ids = {r.doc_id: (r.text, r.token_ids) for r in seen["tokens"]}
    assert Counter(r.doc_id for r in seen["tokens"]) == times
    with open(RANKS, "rb") as f:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    assert all(b"".join(tokens[i] for i in x) == t.encode() for t, x in ids.values())


def test_pipeline_runs_on_odd_documents(spark, clashing, odd_rows):
    import corpus_pipeline

    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == clashing.columns
    out = corpus_pipeline.to_tokens(spark, docs, "/root/testdata/sf0.001")
    assert out.count() <= 3 * len(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), "/root/testdata/sf0.001").count() == 0
