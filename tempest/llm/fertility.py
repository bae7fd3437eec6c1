"""Quality rules by tokeniser fertility.

Every word of a text is encoded by two public vocabularies, a byte-level one and one with byte
fallback.  Measured per document: characters per token of each, the share of byte-fallback pieces,
and the entropy of the token distribution.  A document is rejected if a figure lies outside the band
of its language:

* characters per token (both vocabularies): within ``WIDTH`` robust standard deviations of the
  language's median, wider for texts of few tokens, at least ``LEAST_SHARE`` of the median;
* token entropy: not below the median of the language's documents of similar length (same power of
  two of tokens) by more than ``ENTROPY_WIDTH`` robust standard deviations and ``ENTROPY_LEAST`` bits;
* byte-fallback share: at most ``MAX_BYTES``.

Medians and deviations are those of all documents of the language: they are read off exact counts of
values rounded to ``1 / STEPS``, a table whose size follows from the range of the figures and not
from the number of documents.

The base rules (fewer than ``MIN_WORDS`` words, or more than 30 % of the words in repeated 8-word
windows) reject by themselves and their documents stay out of the bands.

Defined results: null texts are empty, have no words and fail the base rules; a null language is a
language of its own; rows that repeat an id are documents of their own; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches
from tempest.llm.text import WHITE, WORD, whole
from tempest.session import materialise, run_folder

# Fixed values of the task.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

WIDTH = 6.0
SHORT = 50
LEAST_SHARE = 0.03
ENTROPY_WIDTH = 5.0
ENTROPY_LEAST = 0.7
MAX_BYTES = 0.3
STEPS = 200
TO_SIGMA = 1.4826  # median absolute deviation of a normal distribution to its standard deviation

_WORD = re.compile(WORD)
_CACHE = 1 << 19
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_pieces long, n_bytes long, entropy double"
NAMES = FIGURES.replace(",", "").split()[::2]


class Encoders:
    """Word to number, and per number what the vocabularies make of the word."""

    def __init__(self, ranks: bytes, pieces: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.size = max(table.values()) + 1
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens: list[list[int]] = []
        self.pieces: list[int] = []
        self.bytes: list[int] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > _CACHE:
            self.clear()
        known = self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        for w, ids in zip(new, self.sp.encode(new) if new else [], strict=True):
            known[w] = len(known)
            self.tokens.append(self.bpe.encode_ordinary(" " + w))
            self.pieces.append(len(ids))
            self.bytes.append(int(self.is_byte[ids].sum()))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


_LIVE: dict[str, object] = {}


def _encoders(files: tuple[bytes, bytes], pattern: str) -> Encoders:
    """The worker's encoders: tasks that follow each other in a worker share what they know."""
    if _LIVE.get("files") is not files:
        _LIVE.update(files=files, encoders=Encoders(*files, pattern))
    return _LIVE["encoders"]


def repeated_words(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text: words in windows that occur twice or more in it (``window``: a power of two).

    Windows are compared by the exact ranks of their halves, of these halves' halves and so on.
    """
    total = len(ids)
    if total < window:
        return np.zeros(len(counts), np.int64)
    rank, width = ids, 1
    while width < window:
        pair = rank[:-width] * np.int64(int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[:len(rank)] == doc[window - 1:window - 1 + len(rank)]
    at = np.flatnonzero(inside)
    key = rank[at] * np.int64(len(counts)) + doc[at]
    _, where, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[n[where] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts)).astype(np.int64)


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            n += line in seen
            seen.add(line)
    return n


def measure(texts: list[str], enc: Encoders) -> list[np.ndarray]:
    """The columns ``NAMES`` of the texts."""
    words = [_WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(counts) - counts
    flat = [w for ws in words for w in ws]
    ids = enc.numbers(flat)
    doc = np.repeat(np.arange(len(texts)), counts)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=len(texts)).astype(np.int64)

    used, where = np.unique(ids, return_inverse=True)
    tokens = [enc.tokens[i] for i in used]
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    first = np.cumsum(length) - length
    table = np.fromiter((x for t in tokens for x in t), np.int64, int(length.sum()))
    n = length[where]  # tokens of each word of the texts
    total = int(n.sum())
    token = table[np.repeat(first[where] - (np.cumsum(n) - n), n) + np.arange(total)]
    key, c = np.unique(np.repeat(doc, n) * np.int64(enc.size) + token, return_counts=True)
    n_tokens = per_doc(n)
    some = np.maximum(n_tokens, 1)
    entropy = np.log2(some) - np.bincount(key // enc.size, weights=c * np.log2(c), minlength=len(texts)) / some
    pieces = np.fromiter((enc.pieces[i] for i in used), np.int64, len(used))
    fallback = np.fromiter((enc.bytes[i] for i in used), np.int64, len(used))
    return [counts, per_doc(np.fromiter(map(len, flat), np.int64, len(flat))),
            np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64), np.array([dup_lines(t) for t in texts], np.int64),
            repeated_words(ids, starts, counts), n_tokens, per_doc(pieces[where]), per_doc(fallback[where]), np.maximum(entropy, 0.0)]


def figures(docs: DataFrame, folder: str, ranks_path: str, pieces_path: str, pattern: str) -> DataFrame:
    """doc_id, lang and ``FIGURES`` of every document.  The vocabularies travel with the job: their
    size is that of the two files."""
    with open(ranks_path, "rb") as a, open(pieces_path, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders(files.value, pattern)
        for b in batches:
            cols = measure(b.column("text").to_pylist(), enc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *map(pa.array, cols)], ["doc_id", "lang", *NAMES])

    rows = docs.select("doc_id", "lang", whole(F.col("text")).alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return run_batches(rows.mapInArrow(run, f"doc_id {kind['doc_id']}, lang {kind['lang']}, {FIGURES}"), folder, "figures")


# ------------------------------------------------------------------ bands

def _median(hist: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Lower median of ``value`` with counts ``n`` by ``by``."""
    upto = Window.partitionBy(*by).orderBy(value)
    h = hist.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return h.where(2 * F.col("upto") >= F.col("total")).groupBy(*by).agg(F.min(value).alias(out))


def bands(rows: DataFrame, metric: Column, by: list[str]) -> DataFrame:
    """``by``, median and deviation (robust standard deviation) of ``metric``, over all ``rows``."""
    hist = rows.select(*by, F.floor(metric * STEPS + 0.5).alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    med = _median(hist, "bin", by, "med").select(*[F.col(c).alias(f"m_{c}") for c in by], "med")
    on = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in by]
    dev = hist.join(med, on).withColumn("dev", F.abs(F.col("bin") - F.col("med"))).groupBy(*by, "med", "dev").agg(F.sum("n").alias("n"))
    mad = _median(dev, "dev", [*by, "med"], "mad")
    return mad.select(*by, (F.col("med") / STEPS).alias("median"), (F.col("mad") / STEPS * TO_SIGMA).alias("deviation"))




def judged(docs: DataFrame, ranks_path: str, pieces_path: str, pattern: str, folder: str | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed, the fertility figures, reasons (of the method), kept."""
    folder = folder or run_folder(docs.sparkSession, "fertility")
    f = figures(docs, folder, ranks_path, pieces_path, pattern)
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f = f.select("*", per("word_chars", "n_tokens").alias("chars_per_token"), per("word_chars", "n_pieces").alias("chars_per_piece"),
                 per("n_bytes", "n_pieces").alias("byte_share"),
                 F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))).cast("int").alias("length_class"),
                 ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))
    sound = f.where(~F.col("base_failed"))
    out = f
    for name, by in (("chars_per_token", ["lang"]), ("chars_per_piece", ["lang"]), ("entropy", ["lang", "length_class"])):
        b = materialise(bands(sound, F.col(name), by), folder, f"bands-{name}")
        b = b.select(*[F.col(c).alias(f"{name}_{c}") for c in by], F.col("median").alias(f"{name}_median"), F.col("deviation").alias(f"{name}_deviation"))
        out = out.join(b, [F.col(c).eqNullSafe(F.col(f"{name}_{c}")) for c in by], "left")
    few = F.sqrt(1.0 + SHORT / F.greatest("n_tokens", F.lit(1)))

    def outside(name: str) -> Column:
        half = F.greatest(WIDTH * F.col(f"{name}_deviation"), LEAST_SHARE * F.col(f"{name}_median")) * few
        return F.abs(F.col(name) - F.col(f"{name}_median")) > half

    low = F.col("entropy_median") - F.col("entropy") > F.greatest(ENTROPY_WIDTH * F.col("entropy_deviation"), F.lit(ENTROPY_LEAST))
    rules = {"characters per token": outside("chars_per_token"), "characters per piece": outside("chars_per_piece"),
             "token entropy": low, "byte fallback": F.col("byte_share") > MAX_BYTES}
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return out.withColumn("reasons", reasons).select(
        "doc_id", *NAMES[:5], "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"),
        "n_tokens", "chars_per_token", "chars_per_piece", "byte_share", "entropy", "reasons")
