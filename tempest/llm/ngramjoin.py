"""Similarity join of documents on word n-grams: MinHash banding, then exact verification.

Two documents are linked if the Jaccard similarity of their sets of ``N`` consecutive lower-cased
words is at least ``THRESHOLD``.  Bands and rows follow from the recall wanted at the threshold
(``choose_bands``).

How it runs:
1. Equal texts collapse to one node with a count.  Each node gets its band hashes.
2. Shuffle on band hashes, pre-aggregated to (hash, smallest node, count).  Nodes that meet in a
   bucket are linked to the bucket's smallest node: edges grow with the nodes, not with the pairs.
3. The components of these edges hold every pair that shares a band.  Only their nodes' full n-gram
   sets are built.  A component larger than a block is dealt into blocks by hash and each pair of
   blocks is one unit of work, so no task gets a whole large group.
4. Within a unit all pairs are verified on the full sets by matrix products; pairs never become
   rows: a node leaves with the number of documents it is linked to there and with the root of its
   links there.
5. The components of the verified links are the classes.

Every pair of a component is verified, also such as share no band, so recall is at least that of
the bands.  There is no cap on buckets, blocks or partners.

n-grams are 64-bit hashes of the words.  Defined results: a text with fewer than ``N`` words has its
words as one n-gram; texts without a word (null, empty, white space) are equal to each other and to
nothing else; rows that repeat a document are documents of their own; class_id is the smallest
doc_id of the class (null ids are larger than all others); an empty table gives an empty result;
further columns are not read by ``linked`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches, settings
from tempest.llm.components import components
from tempest.llm.text import WORD, whole
from tempest.session import materialise, run_folder

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK_NODES = 512
BLOCK_GRAMS = 1 << 21

#: Spark puts a Bloom filter of the wanted keys (8 MB at most) before the shuffle of the texts.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
         "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
         "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}

_WORD = re.compile(WORD)
_CACHE = 1 << 17


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose bands reach
    ``recall`` at ``threshold`` within ``max_hashes`` hash functions."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hash functions")
    return best


# ------------------------------------------------------------------ n-grams in arrays

class _Words(dict):
    """Word to 64-bit hash; starts anew when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(texts: list[str], words: _Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts one after the other, and each text's number of them."""
    split = [_WORD.findall(t.lower()) for t in texts]
    m = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((words[w] for s in split for w in s), np.uint64, int(m.sum()))
    factor = _odd(n, n)
    total = len(flat)
    h = np.zeros(total, np.uint64)
    for k in range(n):  # position by position; what runs past the end of a text goes below
        h[:total - k] += flat[k:] * factor[k]
    ends = np.cumsum(m)
    starts = ends - m
    good = np.ones(total, bool)
    for k in range(1, n):
        good[(ends - k)[m >= k]] = False
    for i in np.flatnonzero((m > 0) & (m < n)):  # all the words are one gram
        h[starts[i]] = (flat[starts[i]:ends[i]] * factor[:m[i]]).sum(dtype=np.uint64) + np.uint64(m[i])
        good[starts[i]] = True
    return _mix(h[good]), np.where(m >= n, m - n + 1, np.minimum(m, 1))


def band_hashes(h: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row per text with grams: its ``bands`` band hashes."""
    counts = counts[counts > 0]
    out = np.zeros((len(counts), bands), np.uint64)
    if not len(counts):
        return out.astype(np.int64)
    starts = np.cumsum(counts) - counts
    a, b, c = _odd(bands * rows, 1), _odd(bands * rows, 2), _odd(rows, 3)
    for k in range(bands * rows):
        least = np.minimum.reduceat((h * a[k] + b[k]) >> np.uint64(32), starts)
        out[:, k // rows] += least * c[k % rows]
    return _mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def link_block(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verify the pairs of a unit: (documents linked to, root's position) of each set.

    ``side``: 0 everywhere verifies all pairs; 0 and 1, only pairs across.
    """
    t = Fraction(threshold).limit_denominator(1000)
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    across = bool(side.any())
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(n), np.arange(n))
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1  # a gram of one set is in no intersection
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(first), len(second)), np.float32)
    width, last = 4096, int(code[-1]) + 1 if len(code) else 0
    for c in range(0, last, width):
        lo, hi = np.searchsorted(code, [c, c + width])
        x = np.zeros((n, min(width, last - c)), np.float32)
        x[owner[lo:hi], code[lo:hi] - c] = 1
        both += x[first] @ x[second].T
    both = both.astype(np.int64)
    union = size[first][:, None] + size[second][None, :] - both
    hit = both * t.denominator >= union * t.numerator
    link = np.zeros((n, n), bool)
    link[np.ix_(first, second)] = hit
    link |= link.T
    np.fill_diagonal(link, False)
    links = link @ weight
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            seen, new = link[i].copy(), link[i]
            seen[i] = True
            while new.any():
                new = link[new].any(axis=0) & ~seen
                seen |= new
            root[seen] = i
    return links, root


# ------------------------------------------------------------------ the join

def _key():
    """Names a text by 128 bits; all texts without a word are the empty text."""
    text = whole(F.col("text"))
    return F.substring(F.unhex(F.sha2(F.encode(F.when(text.rlike(WORD), text).otherwise(""), "utf-8"), 256)), 1, 16)


def nodes(docs: DataFrame, folder: str, bands: int, rows: int, n: int = N) -> DataFrame:
    """One row per different text: id, key, n_docs, min_doc, n_grams, bands."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            h, counts = grams(b.column("text").to_pylist(), words, n)
            got = band_hashes(h, counts, bands, rows)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(counts), lists], ["key", "doc_id", "n_grams", "bands"])

    signed = (docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
              .mapInArrow(sign, "key binary, doc_id long, n_grams long, bands array<bigint>"))
    one = signed.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"),
                                    F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    return run_batches(one.withColumn("id", F.monotonically_increasing_id()), folder, "nodes")


def candidate_edges(node: DataFrame, folder: str) -> DataFrame:
    """(a, b): node and smallest node of a bucket that it shares."""
    banded = node.select("id", F.explode("bands").alias("h"))
    bucket = (banded.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("h").alias("b_h"), "least"))
    bucket = materialise(bucket, folder, "buckets")
    return (banded.join(bucket, F.col("h") == F.col("b_h")).where("id <> least")
            .select(F.col("id").alias("a"), F.col("least").alias("b")))


def gram_sets(docs: DataFrame, wanted: DataFrame, folder: str, n: int = N) -> DataFrame:
    """``wanted`` (key, min_doc, id, label, blocks, n_docs) with ``grams``, the sorted set as bytes."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            h, counts = grams(b.column("text").to_pylist(), words, n)
            parts = [np.unique(x).tobytes() for x in np.split(h, np.cumsum(counts)[:-1])] if len(counts) else []
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "label", "blocks", "n_docs")] + [pa.array(parts, pa.binary())],
                                             ["id", "label", "blocks", "n_docs", "grams"])

    # written, so that its keys can filter the texts before these are shuffled
    w = materialise(wanted.select(F.col("key").alias("w_key"), "min_doc", "id", "label", "blocks", "n_docs"), folder, "wanted").where("blocks > 0")
    text = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    # one row of each text: of its copies the one with the smallest id, so copies spread over the tasks
    rows = text.join(w, (F.col("key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("min_doc")))
    rows = rows.select("id", "label", "blocks", "n_docs", "text")
    sets = rows.mapInArrow(build, "id long, label long, blocks int, n_docs long, grams binary").dropDuplicates(["id"])
    with settings(docs.sparkSession, BLOOM):
        return run_batches(sets, folder, "sets")


def verify(sets: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """id, root, links: per unit of work and node."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    units = (sets.withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "id", "n_docs", "grams"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            side = np.array([r["side"] for r in held])
            ids = np.array([r["id"] for r in held], np.int64)
            links, root = link_block([np.frombuffer(r["grams"], np.uint64) for r in held],
                                     np.array([r["n_docs"] for r in held], np.int64), side, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(links)], ["id", "root", "links"])

        at = None
        for b in batches:
            for r in b.to_pylist():
                if (here := (r["label"], r["i"], r["j"])) != at:
                    if held:
                        yield done()
                    held, at = [], here
                held.append(r)
        if held:
            yield done()

    units = units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "id")
    return run_batches(units.mapInArrow(check, "id long, root long, links long"), folder, "verified")


def classes(docs: DataFrame, folder: str, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """One row per different text: key, class_id, class_key, class_size, n_links."""
    bands, rows = choose_bands(threshold, recall)
    node = nodes(docs, folder, bands, rows, n)
    label = components(candidate_edges(node, folder), f"{folder}/candidates")
    c = node.drop("bands").join(label, "id")
    c = materialise(c, folder, "labelled")
    sizes = c.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    sizes = materialise(sizes, folder, "sizes").withColumnRenamed("label", "s_label")
    wanted = c.join(sizes, F.col("label") == F.col("s_label"))
    found = verify(gram_sets(docs, wanted, folder, n), folder, threshold)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), f"{folder}/classes")
    links = links.select(F.col("id").alias("l_id"), "links")
    root = root.select(F.col("id").alias("r_id"), F.col("label").alias("root"))
    t = (node.drop("bands").join(links, F.col("id") == F.col("l_id"), "left").join(root, F.col("id") == F.col("r_id"), "left")
         .select("key", "min_doc", "n_docs", F.coalesce("root", "id").alias("root"),
                 (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")))
    t = materialise(t, folder, "linked")
    best = F.min(F.struct(F.col("min_doc").isNull().alias("none"), "min_doc", "key"))
    of = t.groupBy("root").agg(best.alias("best"), F.sum("n_docs").alias("class_size"))
    of = materialise(of.select(F.col("root").alias("o_root"), "best", "class_size"), folder, "of")
    t = t.join(of, F.col("root") == F.col("o_root"))
    return materialise(t.select("key", F.col("best.min_doc").alias("class_id"), F.col("best.key").alias("class_key"), "class_size", "n_links"),
                       folder, "result")


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """doc_id, class_id, class_size, n_links (documents whose similarity reaches the threshold)."""
    t = classes(docs, run_folder(docs.sparkSession, "ngrams"), threshold, recall, n)
    t = t.withColumnRenamed("key", "t_key")
    return (docs.select("doc_id", _key().alias("key")).join(t, F.col("key") == F.col("t_key"))
            .select("doc_id", "class_id", "class_size", "n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest doc_id."""
    t = classes(docs, run_folder(docs.sparkSession, "ngrams"), threshold, recall, n)
    t = t.where(F.col("key") == F.col("class_key")).select(F.col("key").alias("t_key"), "class_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key().alias("key"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(t, (F.col("key") == F.col("t_key")) & F.col("id").eqNullSafe(F.col("class_id")))
    # repeated rows of that id and text
    return kept.groupBy("key", "id").agg(F.first("doc").alias("doc")).select("doc.*")
