"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and the first 4, 5 and 6 letters of longer ones (inflected forms share
them).  From the labelled examples all terms that speak for the label are chosen: those more
frequent in toxic examples, with a log-likelihood ratio above ``2 ln(number of candidate terms)``, at
which about one term would pass by chance, counted so that copies of a text count once.  Document
frequencies are those of the whole corpus; cosines are those over the chosen terms.

A document's neighbours are the ``K`` examples of largest cosine.  The index has two tiers.  Short lists are
summed over all their postings.  Long lists (terms in more than 1 of ``LONG_SHARE`` examples) have their
largest weight per block of examples.  Where a query's long lists hold at most ``FEW_POSTINGS`` postings per
example, they are summed as well, as bounds would cost more than they save.  Else the block weights add up to
what a block can still gain (not more than the norm of the query's long terms): while many examples could
reach the K-th best, the long list that weighs most is summed and the bounds are taken again; then the rest is
computed for those that can, from the most promising block down.  The result is that of comparing with every
example.  Neighbours vote with weight ``1 / (SOFT + 1 - cosine)``; the
vote becomes a probability by the share of toxic labels at that vote among the examples themselves,
each queried without itself (monotone, with the classes weighted as in all labels).  The neighbours
come back as evidence.

What is bounded: the classifier is fitted on at most ``MAX_EXAMPLES`` labelled documents of each class
(chosen by a hash of the id).  Index and broadcast hold the chosen terms of these, a posting for each
term of an example.  Texts are read once, whole.

Only rows out of the held-out fold (crc32 of the id as text, mod 5, not 0) are examples.  The id picks
fold and sample and never enters a score, nor do labels of the document, language or source.

Defined results: null and empty texts, and all without a chosen term, have no neighbour and get the
share of toxic labels among such examples; without usable labels every score is that of the prior,
``PRIOR``; several label rows of an id count as toxic if one does; of several texts of a labelled id
the smallest is the example; a null id is held out; an empty table gives an empty result; further
columns are not read by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches, slices
from tempest.llm.text import whole
from tempest.session import materialise, run_folder

FOLDS = 5
K = 15
MAX_EXAMPLES = 10_000
MIN_DOCS = 3
PREFIXES = (4, 5, 6)
SOFT = 0.05
BINS = 20
BLOCK = 64
LONG_SHARE = 64
FIRST = 64  # examples scored before the first bound
FIRST_BLOCKS = 16
FEW_POSTINGS = 16  # postings per example that are summed without bounds
DENSE_SHARE = 8  # lists of more than 1 of so many examples are held as one weight per example
ROWS_PER_TASK = 8192
EXAMPLES_PER_TASK = 512
EVIDENCE = 5
PRIOR = (0.5, 2.0)  # toxic examples and examples that a share starts from
_CACHE = 1 << 17
_COUNTED = 1 << 19
_WORD = re.compile(r"\w+")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


# ------------------------------------------------------------------ terms

def terms_of(word: str) -> list[str]:
    """``=word`` and the beginnings of the word."""
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]


class _Terms(dict):
    """Word to the numbers of its chosen terms."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        got = self[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return got


def vector(text: str, terms: _Terms) -> tuple[list[int], list[int]]:
    """Chosen terms of a text, ascending, and how often each occurs."""
    c = Counter(i for got in map(terms.__getitem__, _WORD.findall(text.lower())) if got for i in got)
    order = sorted(c)
    return order, [c[i] for i in order]


def sample(labels: DataFrame, folder: str, max_examples: int = MAX_EXAMPLES) -> tuple[DataFrame, list[int]]:
    """(doc_id, toxic) of the examples; the number of usable labels of class 0 and 1."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    return materialise(by_hash[0].unionByName(by_hash[1]), folder, "sample"), [counts.get(y, 0) for y in (0, 1)]


def _ratio(n0: float, n1: float):
    """Log-likelihood ratio of counts a0 of n0 and a1 of n1; 0 for terms that don't speak for the label."""
    a0, a1 = F.col("a0"), F.col("a1")
    both, toxic = a0 + a1, n1 / (n0 + n1)

    def part(seen, expected):
        return F.when((seen > 0) & (expected > 0), seen * F.ln(seen / expected)).otherwise(0.0)

    g = 2 * (part(a1, both * toxic) + part(a0, both * (1 - toxic)) + part(n1 - a1, n1 - both * toxic) + part(n0 - a0, n0 - both * (1 - toxic)))
    return F.when(a1 / n1 > a0 / n0, g).otherwise(0.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(terms, context, toxic): the words around the first occurrence of every term in each text."""
    def rows(found: set) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())],
                                          ["terms", "context", "toxic"])

    for b in batches:
        found: set[tuple[tuple[str, ...], str, int]] = set()
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = ["", *_WORD.findall(text.lower()), ""]
            known: set[str] = set()
            for i, w in enumerate(words[1:-1], 1):
                if "=" + w not in known:
                    mine = tuple(t for t in terms_of(w) if t not in known)
                    known.update(mine)
                    found.add((mine, f"{words[i - 1]} {w} {words[i + 1]}", y))
            if len(found) > _COUNTED:
                yield rows(found)
                found.clear()
        yield rows(found)


def choose_terms(examples: DataFrame, folder: str | None = None) -> list[str]:
    """The terms that speak for the label, from (text, toxic).

    Every word of a toxic text with many copies and near copies seems to: so all terms are counted by
    contexts (the words around a term's first occurrence in a document), in which copies agree, out of
    the distinct texts of the class.
    """
    folder = folder or run_folder(examples.sparkSession, "toxicity")
    texts = examples.select("toxic", F.sha2(F.encode("text", "utf-8"), 256).alias("digest")).distinct()
    total = {r["toxic"]: float(r["n"]) for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(0, 0.0), total.get(1, 0.0)
    if not n0 or not n1:
        return []
    c = (examples.select("text", "toxic").mapInArrow(_contexts, "terms array<string>, context string, toxic int")
         .select(F.explode("terms").alias("term"), "context", "toxic").distinct()
         .groupBy("term").agg(F.sum(1 - F.col("toxic")).alias("a0"), F.sum("toxic").alias("a1")).where(F.col("a0") + F.col("a1") >= MIN_DOCS))
    c = run_batches(c.select("term", _ratio(n0, n1).alias("g")), folder, "terms")
    least = float(2 * np.log(max(c.count(), 2)))
    return [r["term"] for r in c.where(F.col("g") >= least).orderBy(F.desc("g"), "term").collect()]


# ------------------------------------------------------------------ index

def weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights of one vector."""
    w = (1.0 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    size = stop - start
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Inverted index over examples in blocks of ``BLOCK``; examples with a strongest term in common lie together.

    ``idf``: weight of each term.
    """

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple], idf: np.ndarray, block: int = BLOCK,
                 long_share: int = LONG_SHARE):
        n = len(ids)
        size = np.array([len(v[0]) for v in vectors], np.int64)
        term = np.concatenate([np.asarray(v[0], np.int32) for v in vectors] or [np.zeros(0, np.int32)])
        w = np.concatenate([weights(np.asarray(v[0], np.int64), np.asarray(v[1], float), idf) for v in vectors] or [np.zeros(0)])
        owner = np.repeat(np.arange(n), size)
        strongest = np.full(n, len(idf), np.int64)
        by_weight = np.lexsort((term, -w, owner))
        strongest[size > 0] = term[by_weight[(np.cumsum(size) - size)[size > 0]]]
        order = np.lexsort((np.array(ids, np.int64), strongest))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        owner = place[owner]
        self.idf, self.block = idf, block
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, np.int64)[order]
        self.place = {int(x): p for p, x in enumerate(self.ids)}
        self.blocks = -(-n // block)
        #: postings by term, examples ascending
        by_term = np.lexsort((owner, term))
        self.at, self.weight = owner[by_term].astype(np.int32), w[by_term]
        self.ptr = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
        #: long terms: number among them or -1, and their largest weight by block
        is_long = np.diff(self.ptr) * long_share > max(n, 2 * long_share)
        self.long = np.where(is_long, np.cumsum(is_long) - 1, -1)
        self.most = np.zeros((int(is_long.sum()), self.blocks))
        mine = is_long[term]
        np.maximum.at(self.most, (self.long[term[mine]], owner[mine] // block), w[mine])
        #: the long terms of each example
        by_example = np.flatnonzero(mine)[np.argsort(owner[mine], kind="stable")]
        self.own, self.own_weight = self.long[term[by_example]].astype(np.int32), w[by_example]
        self.own_ptr = np.searchsorted(owner[by_example], np.arange(n + 1))
        self.own_mean = len(self.own) / max(n, 1)
        #: the longest lists once more, a weight per example
        thick = np.flatnonzero(np.diff(self.ptr) * DENSE_SHARE > n)
        self.dense_row = np.full(len(idf), -1)
        self.dense_row[thick] = np.arange(len(thick))
        self.dense = np.zeros((len(thick), n))
        for i, x in enumerate(thick):
            self.dense[i, self.at[self.ptr[x]:self.ptr[x + 1]]] = self.weight[self.ptr[x]:self.ptr[x + 1]]
        self.touched = 0  # postings read by all searches

    def search(self, terms, counts, k: int = K, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best examples with a common term; ties go to the earlier place."""
        t = np.asarray(terms, np.int64)
        q, n = weights(t, np.asarray(counts, float), self.idf), len(self.ids)
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(t) or not n:
            return none
        number = self.long[t]
        known = self._sum(t[number < 0], q[number < 0])
        seen = np.zeros(n, bool)
        skip = self.place.get(without, -1)
        if skip >= 0:
            seen[skip] = True
        long, lists, ql = number[number >= 0], t[number >= 0], q[number >= 0]
        if (self.ptr[lists + 1] - self.ptr[lists]).sum() <= FEW_POSTINGS * n:  # bounds would cost more than they save
            known += self._sum(lists, ql)
            found = np.flatnonzero((known > 0) & ~seen)
            if len(found) > k:
                least = np.partition(known[found], -k)[-k]
                found = found[known[found] >= least - 1e-9]
            top = np.lexsort((found, -np.round(known[found], 9)))[:k]
            return found[top], known[found[top]]
        # long terms still to come, the heaviest in the query first
        heavy = np.argsort(-ql, kind="stable")
        long, lists, ql = long[heavy], lists[heavy], ql[heavy]
        dense = np.zeros(len(self.most))
        dense[long] = ql
        at, best = none

        def exact(found: np.ndarray) -> None:
            nonlocal at, best
            seen[found] = True
            own = _spans(self.own_ptr[found], self.own_ptr[found + 1])
            size = self.own_ptr[found + 1] - self.own_ptr[found]
            gain = np.bincount(np.repeat(np.arange(len(found)), size), dense[self.own[own]] * self.own_weight[own], len(found))
            self.touched += len(own)
            score = known[found] + gain
            hit = score > 0
            at, best = np.concatenate([at, found[hit]]), np.concatenate([best, score[hit]])
            top = np.lexsort((at, -np.round(best, 9)))[:k]
            at, best = at[top], best[top]

        def least() -> float:
            return best[-1] - 1e-9 if len(best) == k else 0.0

        first = min(max(FIRST, k), n)
        while True:
            start = np.argpartition(-known, first - 1)[:first]
            exact(start[(known[start] > 0) & ~seen[start]])
            rest = np.minimum(np.sqrt((ql * ql).sum()), ql @ self.most[long]) if len(long) else np.zeros(self.blocks)
            can = known + np.repeat(rest, self.block)[:n]  # what an example can reach
            can[seen] = 0
            open_ones = int(((can > 0) & (can >= least())).sum())
            sizes = self.ptr[lists + 1] - self.ptr[lists]
            if 2 * open_ones * self.own_mean <= sizes.sum() or not len(long):
                break
            # too many could still get in: sum the next long lists for all examples, and bound again
            take = int(np.searchsorted(np.cumsum(sizes), sizes.sum() / 4)) + 1
            known += self._sum(lists[:take], ql[:take])
            dense[long[:take]] = 0
            long, lists, ql = long[take:], lists[take:], ql[take:]
        bound = np.maximum.reduceat(can, np.arange(0, n, self.block))
        blocks, at_once = np.argsort(-bound, kind="stable"), FIRST_BLOCKS
        while len(blocks):
            # the most promising blocks, until no other can hold a better example
            blocks = blocks[(bound[blocks] > 0) & (bound[blocks] >= least())]
            now, blocks, at_once = blocks[:at_once], blocks[at_once:], 4 * at_once
            inside = _spans(now * self.block, np.minimum((now + 1) * self.block, n))
            inside = inside[(can[inside] > 0) & (can[inside] >= least())]
            if len(inside):
                exact(inside)
        return at, best

    def _sum(self, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Part of every example's cosine by whole lists."""
        row = self.dense_row[terms]
        thin, q_thin = terms[row < 0], q[row < 0]
        size = self.ptr[thin + 1] - self.ptr[thin]
        at = _spans(self.ptr[thin], self.ptr[thin + 1])
        out = np.bincount(self.at[at], self.weight[at] * np.repeat(q_thin, size), len(self.ids)).astype(float)
        for i, w in zip(row[row >= 0], q[row >= 0], strict=True):
            out += w * self.dense[i]
        self.touched += int((self.ptr[terms + 1] - self.ptr[terms]).sum())
        return out

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float | None:
        if not len(at):
            return None
        w = 1.0 / (SOFT + 1.0 - np.minimum(cosine, 1.0))
        return float((w * self.labels[at]).sum() / w.sum())


def bin_of(vote: float | None) -> int:
    """0: no neighbour; 1 to BINS by the vote."""
    return 0 if vote is None else 1 + min(int(vote * BINS), BINS - 1)


def calibrate(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Probability by bin from counts (bin, label): shares with the prior, not falling with the vote.

    ``factor``: how many labels stand behind one example of each class.
    """
    c = counts * factor
    share = lambda x: (x[1] + PRIOR[0]) / (x.sum() + PRIOR[1])
    out = np.empty(len(c))
    out[0] = share(c[0])
    pools: list[list] = []  # neighbouring bins are pooled until shares rise
    for b in range(1, len(c)):
        pools.append([c[b], [b]])
        while len(pools) > 1 and (share(pools[-2][0]) >= share(pools[-1][0]) or not pools[-1][0].sum()):
            x, bins = pools.pop()
            pools[-1] = [pools[-1][0] + x, pools[-1][1] + bins]
    for x, bins in pools:
        out[bins] = share(x)
    return out


# ------------------------------------------------------------------ scores

def score(docs: DataFrame, labels: DataFrame, k: int = K, max_examples: int = MAX_EXAMPLES,
          folder: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_id, cosine, toxic of the nearest) of every row."""
    return _scored(docs.select("doc_id", F.lit(None).cast("int").alias("payload"), "text"), labels, k, max_examples,
                   folder or run_folder(docs.sparkSession, "toxicity"), spread=True).drop("payload")


def _scored(docs: DataFrame, labels: DataFrame, k: int, max_examples: int, folder: str, spread: bool = False) -> DataFrame:
    """``spread``: rows without a payload are dealt to tasks by their number, as a few bytes stand for a whole text."""
    spark = docs.sparkSession
    ids, usable = sample(labels, folder, max_examples)
    # the sample's size is bounded, so it may be broadcast at any size of the corpus
    ids = F.broadcast(ids.withColumnRenamed("doc_id", "s_id"))
    examples = (docs.select(F.col("doc_id").cast("long").alias("id"), whole(F.col("text")).alias("text")).join(ids, F.col("id") == F.col("s_id"))
                .groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("e")).select("id", "e.text", "e.toxic"))
    examples = materialise(examples, folder, "examples")
    chosen = choose_terms(examples, folder)
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(chosen)})

    def vectors(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = _Terms(number.value)
            for b in batches:
                got = [vector(t, terms) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(column), b.column("payload"), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                                                  pa.array([g[1] for g in got], pa.list_(pa.int32()))], [column, "payload", "terms", "counts"])
        return run

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = f"{{}} {{}}, payload {{}}, terms array<int>, counts array<int>"
    rows = docs.select("doc_id", "payload", whole(F.col("text")).alias("text"))
    # the text (and what is to be kept of a document) is read once; all that follows reads this table
    rows = run_batches(rows.mapInArrow(vectors("doc_id"), out.format("doc_id", kinds["doc_id"], kinds["payload"])), folder, "vectors")
    total, size = rows.count(), len(chosen)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["term", "n"])

    seen = {} if not size else {r["term"]: r["n"] for r in rows.select("terms").mapInArrow(frequencies, "term int, n long")
                                .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1.0 + total) / (1.0 + seen.get(i, 0))) + 1.0 for i in range(size)])
    fitted = run_batches(examples.select("id", F.col("toxic").alias("payload"), "text").mapInArrow(vectors("id"), out.format("id", "long", "int")),
                         folder, "example-vectors").collect()
    fitted.sort(key=lambda r: r["id"])
    index = spark.sparkContext.broadcast(BlockMaxIndex([r["id"] for r in fitted], [r["payload"] for r in fitted],
                                                       [(r["terms"], r["counts"]) for r in fitted], idf))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            bins = [bin_of(ix.vote(*ix.search(t, c, k, without=i)) if t else None)
                    for i, t, c in zip(*(b.column(x).to_pylist() for x in ("id", "terms", "counts")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), b.column("payload")], ["bin", "toxic"])

    counts = np.zeros((BINS + 1, 2))
    # tasks by rows: a row of few numbers stands for a whole text and its search
    vectors_of = spark.read.parquet(f"{folder}/example-vectors").repartition(max(1, -(-len(fitted) // EXAMPLES_PER_TASK)), "id")
    for r in vectors_of.mapInArrow(alone, "bin int, toxic int").groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["bin"], r["toxic"]] = r["n"]
    used = counts.sum(axis=0)
    probability = calibrate(counts, np.array([usable[y] / used[y] if used[y] else 1.0 for y in (0, 1)]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, known = index.value, {}

        def of(terms: list[int], n: list[int]) -> tuple[float, list[dict]]:
            key = (*terms, -1, *n)
            if key not in known:
                if len(known) >= _CACHE >> 3:
                    known.clear()
                at, cosine = ix.search(terms, n, k) if terms else (np.zeros(0, np.int64), np.zeros(0))
                near = [{"doc_id": int(ix.ids[p]), "cosine": float(c), "toxic": int(ix.labels[p])} for p, c in zip(at[:EVIDENCE], cosine, strict=False)]
                known[key] = (float(probability[bin_of(ix.vote(at, cosine))]), near)
            return known[key]

        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in slices(batches):
            got = [of(t, c) for t, c in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("payload"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)],
                                             ["doc_id", "payload", "score", "evidence"])

    if spread:
        rows = rows.repartition(max(1, -(-total // ROWS_PER_TASK)))
    scored = rows.mapInArrow(judge, f"doc_id {kinds['doc_id']}, payload {kinds['payload']}, score double, "
                             "evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")
    return scored.select("doc_id", "payload", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    options = {"k": K, "max_examples": MAX_EXAMPLES} | options
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    folder = run_folder(docs.sparkSession, "toxicity")
    return (_scored(docs.select("doc_id", whole_row.alias("payload"), "text"), labels, folder=folder, **options)
            .where(F.col("predicted") == 0).select("payload.*"))
