"""Ranked lexical search: the best documents of every item, by hybrid TAAT-DAAT over a sharded index.

A term is a maximal run of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased.  A
document scores, over the different terms of the item, the sum of ``w * ((10^9 * tf) div (1000 * tf + 8 * m))``
with ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 10 + (90 * n * N) div L``: N documents
with a term, L terms in them, n terms in the document, df documents with the term, tf its occurrences.

How it runs:
1. One pass over the texts makes shards: each task closes a shard at ``SHARD_TERMS`` terms and writes
   one row per term with its posting list (documents in the order of their ids, tf), and one row with
   the shard's ids and lengths.  No list and no shard grows with the table; a common term has a piece in
   every shard.
2. N, L and the df of the items' terms are sums over these rows.
3. The items go over the shards in blocks of bounded size.  A shard gets the lists of the block's terms
   only (one shuffle by shard) and answers each item of the block:
   * term at a time: the shortest lists, at most ``SHORT_SHARE`` of the shard's documents together, are
     summed to accumulators, sorted by document;
   * document at a time: the accumulators are one more iterator beside the long lists, each with its
     greatest score per ``BLOCK`` documents.  The k-th accumulator is the first score to beat.  Blocks whose
     bounds do not reach it are skipped; inside a block, lists are added whole only while documents unseen
     so far could still reach it, and after that only looked up for the documents that can.
4. Each shard returns at most k rows an item; a limited window keeps the k best.

All decisions are by bounds, so results are exact.  Scores are 64-bit integers.

Defined results: null or empty texts have no terms and appear in no result; an item without terms, or
whose terms are in no document, returns no rows; each row of ``items`` is ranked on its own, also where
ids repeat or are null; rows that repeat a document are documents of their own; equal scores go by
ascending doc_id (null last); empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches
from tempest.llm.text import whole
from tempest.session import materialise, run_folder

TOP = 10
SHARD_TERMS = 1 << 22
SHARD_DOCS = 1 << 16
SHORT_SHARE = 0.25
BLOCK = 256
#: Terms of the items that go over the shards at a time.
QUERY_TERMS = 1 << 18

# Bytes of UTF-8: separators become blanks, A-Z lower case; all bytes of non-ASCII characters stay.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode("utf-8").translate(_TABLE).split()


# ------------------------------------------------------------------ the index

class _Shard:
    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.found: list[np.ndarray] = []
        self.n_terms = 0

    def add(self, doc_id: int | None, text: str) -> None:
        words = terms(text)
        if words:
            known = self.vocabulary
            self.found.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            self.ids.append(doc_id)
            self.n_terms += len(words)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's header (null term), then its lists."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        length = np.array([len(self.found[i]) for i in order], np.int64)
        n = len(order)
        yield _batch([shard], [None], [n], [length.tobytes()], [None], [[self.ids[i] for i in order]])
        key = np.concatenate([self.found[i] for i in order]) * n + np.repeat(np.arange(n), length)
        key, tf = np.unique(key, return_counts=True)
        docs, tf = (key % n).astype(np.int32), tf.astype(np.int32)
        ends = np.searchsorted(key, (np.arange(len(self.vocabulary)) + 1) * n)
        names = list(self.vocabulary)
        for at in range(0, len(names), 1 << 14):
            span = range(at, min(at + (1 << 14), len(names)))
            cuts = [(int(ends[i - 1]) if i else 0, int(ends[i])) for i in span]
            yield _batch([shard] * len(span), [names[i].decode("utf-8") for i in span], [b - a for a, b in cuts],
                         [docs[a:b].tobytes() for a, b in cuts], [tf[a:b].tobytes() for a, b in cuts], [None] * len(span))


INDEX = "shard long, term string, df long, docs binary, tf binary, ids array<bigint>"


def _batch(shard, term, df, docs, tf, ids) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((shard, term, df, docs, tf, ids), kinds, strict=True)],
                                      ["shard", "term", "df", "docs", "tf", "ids"])


def index(docs: DataFrame, folder: str, shard_terms: int = SHARD_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The sharded inverted index of ``docs``, written below ``folder``.

    A row per (shard, term): df, docs (int32 positions in the shard), tf (int32); a row per shard with a
    null term: df (its documents), docs (int64 lengths), ids.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.n_terms >= shard_terms or len(shard.ids) >= shard_docs:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return run_batches(rows.mapInArrow(build, INDEX), folder, "index")


# ------------------------------------------------------------------ one shard

class _List:
    """Postings of a term, or accumulators, in a shard: documents, scores, offsets and greatest score by block."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, n_blocks: int) -> None:
        self.docs, self.scores = docs, scores
        self.cuts = np.searchsorted(docs, np.arange(n_blocks + 1) * BLOCK)
        self.bound = np.zeros(n_blocks, np.int64)
        some = np.flatnonzero(np.diff(self.cuts))
        if len(some):
            self.bound[some] = np.maximum.reduceat(scores, self.cuts[some])


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """8 * m of documents with ``n`` terms."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:  # beyond 64 bits before the division
        n = n.astype(object)
    return (8 * (10 + 90 * n * n_docs // n_terms)).astype(np.int64)


def accumulate(lists: list[_List], n_blocks: int) -> _List:
    """Term at a time: the sum of short lists."""
    docs = np.concatenate([x.docs for x in lists]) if lists else np.empty(0, np.int32)
    scores = np.concatenate([x.scores for x in lists]) if lists else np.empty(0, np.int64)
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return _List(docs[first], np.add.reduceat(scores, first) if len(first) else scores, n_blocks)


def best(lists: list[_List], n_docs: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best documents (score above 0), best first, ties by position."""
    n_blocks = -(-n_docs // BLOCK)
    lists = sorted(lists, key=lambda x: len(x.docs))
    size, cut = np.cumsum([len(x.docs) for x in lists]), 0
    while cut < len(lists) and size[cut] <= SHORT_SHARE * n_docs:
        cut += 1
    acc, long = accumulate(lists[:cut], n_blocks), lists[cut:]
    floor = 1  # the least score that counts: the k-th accumulator, as no document scores less than its own
    if len(acc.scores) >= k:
        floor = max(floor, int(np.partition(acc.scores, -k)[-k]))
    top_doc, top_score = np.empty(0, np.int64), np.empty(0, np.int64)
    bound = acc.bound + sum((x.bound for x in long), np.zeros(n_blocks, np.int64))
    for b in np.flatnonzero(bound >= floor):
        if bound[b] < floor:
            continue
        seen = np.zeros(BLOCK, np.int64)
        base = int(b) * BLOCK
        lo, hi = acc.cuts[b], acc.cuts[b + 1]
        seen[acc.docs[lo:hi] - base] = acc.scores[lo:hi]
        rest = int(bound[b] - acc.bound[b])
        for x in sorted((x for x in long if x.bound[b]), key=lambda x: -x.bound[b]):
            lo, hi = x.cuts[b], x.cuts[b + 1]
            if rest >= floor:  # a document unseen so far could reach the floor
                seen[x.docs[lo:hi] - base] += x.scores[lo:hi]
            else:
                able = np.flatnonzero(seen + rest >= floor)
                if not len(able):
                    break
                here = x.docs[lo:hi]
                at = np.minimum(np.searchsorted(here, able + base), hi - lo - 1)
                hit = here[at] == able + base
                seen[able[hit]] += x.scores[lo:hi][at[hit]]
            rest -= int(x.bound[b])
        able = np.flatnonzero(seen >= floor)
        if len(able):
            docs, scores = np.concatenate([top_doc, able + base]), np.concatenate([top_score, seen[able]])
            order = np.lexsort((docs, -scores))[:k]
            top_doc, top_score = docs[order], scores[order]
            if len(top_doc) == k:  # later documents lose ties
                floor = max(floor, int(top_score[-1]) + 1)
    return top_doc, top_score


# ------------------------------------------------------------------ the search

def _items(items: DataFrame, folder: str) -> DataFrame:
    """q (unique), item_id, terms: the different terms of each row with some."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t.decode("utf-8") for t in terms(x)}) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole(F.col("text")).alias("text"))
    rows = rows.mapInArrow(cut, "item_id long, terms array<string>").where(F.size("terms") > 0)
    return run_batches(rows.select(F.monotonically_increasing_id().alias("q"), "item_id", "terms"), folder, "items")


def _answer(block: list[tuple[int, list[str]]], weight: dict[str, int], n_docs: int, n_terms: int, k: int):
    """Task function: answers the items of ``block`` in every shard of its partition (rows sorted by shard, header first)."""
    def answer(header: dict, lists: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        norm = length_norm(np.frombuffer(header["docs"], np.int64), n_docs, n_terms)
        n_blocks = -(-len(norm) // BLOCK)
        made = {}
        for t, (docs, tf) in lists.items():
            tf = tf.astype(np.int64)
            made[t] = _List(docs, weight[t] * (1_000_000_000 * tf // (1000 * tf + norm[docs])), n_blocks)
        out_q, out_doc, out_score = [], [], []
        for q, words in block:
            docs, scores = best([made[t] for t in words if t in made], len(norm), k)
            out_q += [q] * len(docs)
            out_doc += [header["ids"][i] for i in docs]
            out_score.append(scores)
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_doc, pa.int64()),
                                           pa.array(np.concatenate(out_score) if out_score else [], pa.int64())], ["q", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, lists = None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["term"] is None:
                    if lists:
                        yield answer(header, lists)
                    header, lists = r, {}
                else:
                    lists[r["term"]] = (np.frombuffer(r["docs"], np.int32), np.frombuffer(r["tf"], np.int32))
        if lists:
            yield answer(header, lists)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS,
           shard_terms: int = SHARD_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of ``items``."""
    spark = docs.sparkSession
    folder = run_folder(spark, "ranked")
    idx = index(docs, folder, shard_terms)
    heads = idx.where("term is null")

    # sums of the lengths stay in Spark: a header's lengths add up to the shard's occurrences of terms
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(np.frombuffer(x, np.int64).sum()) for x in b.column("docs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("df"), pa.array(n, pa.int64())], ["n_docs", "n_terms"])

    total = heads.select("df", "docs").mapInArrow(lengths, "n_docs long, n_terms long").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    asked = _items(items, folder)
    n_asked = asked.agg(F.sum(F.size("terms"))).first()[0]
    schema = "q long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    n_blocks = -(-(n_asked or 0) // query_terms) if total["shards"] else 0
    for i in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == i)
        words = block.select(F.explode("terms").alias("t")).distinct()
        hits = materialise(idx.join(words, F.col("term") == F.col("t")).drop("t"), folder, f"hits-{i}")
        df = hits.groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most a block's terms
        weight = {r["term"]: math.floor(1000 * math.log((2 * total["n_docs"] + 2) / (2 * r["df"] + 1))) for r in df}
        ask = [(r["q"], [t for t in r["terms"] if t in weight]) for r in block.select("q", "terms").collect()]
        ask = [(q, t) for q, t in ask if t]
        shards = hits.unionByName(heads.where(F.lit(bool(ask)))).repartition(min(total["shards"], 20_000), "shard")
        shards = shards.sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        got = shards.mapInArrow(_answer(ask, weight, total["n_docs"], total["n_terms"], k), schema)
        found = found.unionByName(run_batches(got, folder, f"found-{i}"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    kept = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return (kept.join(asked.select(F.col("q").alias("a_q"), "item_id"), F.col("q") == F.col("a_q"))
            .select("item_id", "rank", "doc_id", "score"))
