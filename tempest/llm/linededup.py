"""Line dedup across documents (DataFrame functions only).

A line's key is the line without white space at its ends, A-Z in lower case.  A key of at least
``MIN_CHARS`` code points that occurs in at least ``MIN_DOCS`` documents keeps its lines only in the
document with the largest id that holds it; everywhere else all its lines go.

How it runs: the text is read once to give one row per (key hash, document) with the positions of
the key, pre-aggregated where the lines are.  These rows are range-partitioned by (hash, salt) and
sorted within a partition by document, largest first: the first row of a run is the run's first
occurrence, so a run is reduced to (first document, number of documents) as it streams by.  The salt
splits a line that a third of all documents share over ``SALTS`` runs; their few partial results are
merged by hash.  What comes back is no text but one compressed keep bitmap per document: the runs of
dropped lines, (start, length), next to the number of lines.  ``apply_bitmaps`` cuts the texts.

Hashes are 128 bits (two xxhash64 with different seeds).

Defined results: a null or empty text is one empty line; rows with the same id and the same text
are one document (each gets the same bitmap), rows with the same id and different texts are two, both
"largest" if their id is; null ids sort below all others; an empty table gives an empty result.
Further columns are kept by ``apply_bitmaps``, of which only ``text`` changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.text import WHITE, lower_ascii, whole
from tempest.session import materialise, run_folder

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 64


def split_lines(text):
    return F.split(whole(text), "\n", -1)


def doc_mark(text):
    """Tells texts of the same id apart."""
    return F.xxhash64(whole(text))


def key_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per (key hash, document): h1, h2, doc_id, mark, positions."""
    # the mark is made before the lines are dealt out: the text itself stays behind
    texts = docs.select("doc_id", doc_mark(F.col("text")).alias("mark"), split_lines(F.col("text")).alias("lines"))
    lines = texts.select("doc_id", "mark", F.posexplode("lines").alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(WHITE))
    keys = (lines.select("doc_id", "mark", "pos", line.alias("line")).where(F.char_length("line") >= min_chars)
            .select("doc_id", "mark", "pos", lower_ascii(F.col("line")).alias("key"))
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "mark", "pos"))
    # rows that repeat a document give each position twice: a set keeps one
    return keys.groupBy("h1", "h2", "doc_id", "mark").agg(F.collect_set("pos").alias("positions"))


def repeated_keys(positions: DataFrame, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """(h1, h2, keep_id) of the keys that lose lines."""
    salted = positions.select("h1", "h2", "doc_id", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).alias("salt"))
    runs = (salted.repartitionByRange("h1", "h2", "salt")
            .sortWithinPartitions("h1", "h2", "salt", F.col("doc_id").desc_nulls_last()))
    # the range partitioning already brings a run together and the sort puts its first occurrence
    # first: no further shuffle, rows stream in order (a struct makes this a sort-based aggregate)
    first = runs.groupBy("h1", "h2", "salt").agg(F.first(F.struct("doc_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    return (first.groupBy("h1", "h2").agg(F.max("first").alias("first"), F.sum("n").alias("n"))
            .where(F.col("n") >= min_docs).select("h1", "h2", F.col("first.doc_id").alias("keep_id")))


def dropped_runs(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, n_dropped, runs) of the documents that lose lines."""
    folder = run_folder(docs.sparkSession, "lines")
    positions = materialise(key_positions(docs, min_chars), folder, "positions")
    hits = materialise(repeated_keys(positions, min_docs), folder, "hits")
    drops = (positions.join(hits, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .select("doc_id", "mark", F.explode("positions").alias("pos")))
    # neighbouring positions have the same difference to their rank
    in_order = Window.partitionBy("doc_id", "mark").orderBy("pos")
    runs = (drops.withColumn("island", F.col("pos") - F.row_number().over(in_order))
            .groupBy("doc_id", "mark", "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length")))
    return runs.groupBy("doc_id", "mark").agg(
        F.sum("length").cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, mark, n_lines, n_dropped, runs (dropped runs; empty: all kept)."""
    rows = docs.select("doc_id", doc_mark(F.col("text")).alias("mark"),
                       F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"))
    return _with_runs(rows, dropped_runs(docs, min_chars, min_docs))


def _with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and mark) with n_dropped and runs of their document."""
    r = runs.select(F.col("doc_id").alias("r_doc_id"), F.col("mark").alias("r_mark"), "n_dropped", "runs")
    on = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("mark") == F.col("r_mark"))
    return (rows.join(r, on, "left").drop("r_doc_id", "r_mark")
            .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))
            .withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType))))


def kept_text(text, runs):
    """The text without the lines in ``runs``."""
    upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(
        F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"])
    flags = F.flatten(F.transform(runs, lambda r, i: F.concat(
        F.array_repeat(F.lit(True), (r["start"] - upto(i)).cast("int")), F.array_repeat(F.lit(False), r["length"]))))
    kept = F.filter(split_lines(text), lambda line, i: F.coalesce(F.get(flags, i), F.lit(True)))
    return F.when(F.size(runs) == 0, whole(text)).otherwise(F.array_join(kept, "\n"))


def apply_bitmaps(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines (null stays null); ``runs`` as from ``dropped_runs``."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text",
                    doc_mark(F.col("text")).alias("mark"))
    cut = F.when(F.col("text").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("runs")))
    j = _with_runs(d, runs).select("doc", cut.alias("kept"))
    return j.select(*[F.col("kept").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document, by its keep bitmap."""
    rows = docs.select("doc_id", "text", doc_mark(F.col("text")).alias("mark"))
    j = _with_runs(rows, dropped_runs(docs, min_chars, min_docs))
    return j.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped",
                    F.sha2(F.encode(kept_text(F.col("text"), F.col("runs")), "utf-8"), 256).alias("kept_sha256"))
