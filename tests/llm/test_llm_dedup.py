"""Exact dedup and the n-gram join against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempest.llm import exactdedup, ngramjoin
from tempest.llm.components import components
from tempest.session import run_folder


def written(df, parts=3):
    path = run_folder(df.sparkSession, "test") + "/documents.parquet"
    df.repartition(parts).write.parquet(path)
    return path


def plain_groups(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    big = lambda v: max((x for x in v if x is not None), default=None)
    return Counter((i, big(v), len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in by.items() for i in v)


@pytest.mark.parametrize("digest,files", [(exactdedup.sha256_digest, None), (lambda t: F.length(t) % 3, 1)])
def test_exact_groups(spark, odd_docs, odd_rows, digest, files):
    got = exactdedup.dedup(spark, written(odd_docs), digest=digest, max_files=files).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_groups(odd_rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t, *_ in odd_rows})
    assert all(r.at == r.keep_at for r in got if r.kept)


def test_a_stream_goes_on_where_it_stopped(spark, odd_docs, odd_rows):
    path, folder = written(odd_docs), run_folder(spark, "test")
    exactdedup.build_state(spark, path, folder)
    more = odd_docs.withColumn("doc_id", F.col("doc_id") + 1000)
    more.write.mode("append").parquet(path)
    got = exactdedup.dedup(spark, path, folder=folder).collect()
    rows = odd_rows + [(None if i is None else i + 1000, t) for i, t, *_ in odd_rows]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_groups(rows)


def test_exact_dedup_of_an_empty_table(spark, no_docs):
    assert exactdedup.dedup(spark, written(no_docs)).count() == 0


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def plain_join(rows, one_each=False):
    sets = [grams(t) for _, t, *_ in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    by = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        by[find(i)].append(d)
    low = {r: min((x for x in v if x is not None), default=None) for r, v in by.items()}
    if one_each:
        return Counter(low.values())
    return Counter((d, low[find(i)], len(by[find(i)]), n[i]) for i, (d, *_) in enumerate(rows))


def test_linked_is_the_plain_join(odd_docs, odd_rows):
    got = Counter(tuple(r) for r in ngramjoin.linked(odd_docs).collect())
    assert got == plain_join(odd_rows)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_NODES", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 80, 2):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngramjoin.linked(d).collect()) == plain_join(rows)


def test_one_of_each_class_stays(odd_docs, clashing, odd_rows, no_docs):
    kept = ngramjoin.keep_one(clashing).collect()
    assert Counter(r.doc_id for r in kept) == plain_join(odd_rows, one_each=True)
    assert ngramjoin.keep_one(clashing).columns == clashing.columns
    assert ngramjoin.keep_one(no_docs).count() == 0 and ngramjoin.linked(no_docs).count() == 0


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.9999), (0.9, 0.999), (0.5, 0.99)):
        bands, rows = ngramjoin.choose_bands(t, r, 256)
        assert 1 - (1 - t ** rows) ** bands >= r and bands * rows <= 256
    with pytest.raises(ValueError):
        ngramjoin.choose_bands(0.01, 0.9999, 8)


def test_measured_recall_of_the_bands():
    """Pairs at the threshold share a band as often as the recall says."""
    words, miss = ngramjoin._Words(), 0
    for k in range(300):
        a = [f"w{k}-{i}" for i in range(100)]
        b = a[:96] + [f"v{k}-{i}" for i in range(4)]  # 92 of 100 grams in common
        h, n = ngramjoin.grams([" ".join(a), " ".join(b)], words)
        x = ngramjoin.band_hashes(h, n, *ngramjoin.choose_bands())
        miss += not (x[0] == x[1]).any()
    assert miss <= 1


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(10 ** 9), rng.randrange(10 ** 9)) for _ in range(50)]
    ids = [x for e in edges for x in e]
    edges += [(ids[i], ids[i + 1]) for i in range(0, 60)] + [(7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), run_folder(spark, "test")).collect()}
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        root[find(a)] = find(b)
    assert set(got) == set(ids)
    assert len(set(got.values())) == len({find(x) for x in ids})
    assert all((got[a] == got[b]) for a, b in edges[:-1])
