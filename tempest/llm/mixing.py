"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target number of words.  A document is first taken as many whole times as its
source's target holds its source (the certain copies); the rest of the target is a fixed-size
sample without replacement: documents are ranked by random odds divided by inclusion odds,

    q = (u / (1 - u)) / (p / (1 - p)),    p = (target - certain words) / words of the source,

and taken in the order of ``q`` until the words taken are as near to the target as they get.
The size of the sample is fixed in words, so a source misses its target by no more than half of
one document.

How it runs: one pass reduces the corpus to narrow rows (no text); sums by (source, bucket of u)
are pre-aggregated map-side; prefix sums over the buckets find the one bucket per source that holds
the cut; only that bucket's rows (one in ``BUCKETS`` of the source) are ordered.  The decisions are
a table with one row per source, applied to the documents without shuffling them.  A source with a
third of all rows therefore costs what any other source costs.

Defined results: null text has size 0; null is a source of its own, the last; documents of size 0
are never sampled or copied beyond their certain copies, and have ``taken`` 0; rows of equal id
draw the same number and share their fate; a null id draws by the text; an empty table gives an
empty result; an empty corpus (no words) has targets 0.  Further columns of the input are kept by
``pareto_mix`` unless their name is one of ``ADDED``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.text import whole, word_count
from tempest.session import materialise, run_folder

WEIGHTS = (1, 2, 3)
MAX_TIMES = 3
SEED = "mix-1"
BUCKETS = 1024
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def draw(seed: str = SEED):
    """Uniform number in (0, 1) by the id: 52 bits of an MD5, so reruns and other engines agree."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(whole(F.col("text")), "utf-8")))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2 ** 52))


def narrow_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed).alias("u"))


def source_targets(rows: DataFrame, weights=WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """(source, source_size, target): shares by weight, filled up to ``max_times`` source sizes.

    The work after the first aggregation is on one row per source: its windows without a partition
    key order the sources, never the documents.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_times)
    # sources in the order in which they reach their cap as the level of words per weight rises
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything))
          .withColumn("all_w", F.sum("w").over(everything))
          .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("at"), "source", "level"))).over(everything)
    s = s.withColumn("lambda", final["level"])
    return s.select("source", "source_size",
                    F.when(F.col("full"), F.col("cap").cast("double"))
                     .otherwise(F.col("lambda") * F.col("w")).alias("target"))


def odds_ratio(u, p):
    return (u / (1.0 - u)) * ((1.0 - p) / p)


def mixing_plan(docs: DataFrame, weights=WEIGHTS, max_times: int = MAX_TIMES, seed: str = SEED,
                rows: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """One row per source: source, source_size, target, whole (certain copies), p, cut.

    A document gets one more copy than ``whole`` if its ``q`` is not above ``cut`` (null: never).
    """
    folder = folder or run_folder(docs.sparkSession, "mix")
    if rows is None:
        rows = materialise(narrow_rows(docs, seed), folder, "rows")
    t = source_targets(rows, weights, max_times)
    size, target = F.col("source_size"), F.col("target")
    t = t.withColumn("whole", F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", target - (F.col("whole") * size).cast("double"))
    t = t.withColumn("p", F.when(size > 0, F.col("rest") / size).otherwise(F.lit(0.0)))
    t = materialise(t, folder, "targets").withColumnRenamed("source", "t_source")

    bucket = F.floor(F.col("u") * BUCKETS).cast("int")
    sums = (rows.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
            .join(t, F.col("source").eqNullSafe(F.col("t_source"))))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("end", F.sum("words").over(upto)).withColumn("start", F.col("end") - F.col("words"))
    at_cut = (sums.where((F.col("p") > 0) & (F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("end")))
              .select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "start", "rest", "p"))
    at_cut = materialise(at_cut, folder, "at_cut")
    near = rows.join(at_cut, F.col("source").eqNullSafe(F.col("c_source")) & (bucket == F.col("c_bucket")))
    near = near.withColumn("q", odds_ratio(F.col("u"), F.col("p")))
    tied = near.groupBy("c_source", "c_bucket", "q", "start", "rest", "p").agg(F.sum("size").alias("words"))
    ranked = Window.partitionBy("c_source").orderBy("q")
    upto_q = F.col("start") + F.sum("words").over(ranked)
    tied = tied.withColumn("upto", upto_q)
    # below the cut while one more document brings the sum nearer to the rest
    cut = (tied.groupBy("c_source", "c_bucket", "p")
           .agg(F.max(F.when((F.col("upto") * 2 - F.col("words")).cast("double") < 2.0 * F.col("rest"), F.col("q"))).alias("q_in")))
    # nothing of the bucket taken: every q of the buckets before it is below this bucket's lower edge
    cut = cut.withColumn("cut", F.coalesce("q_in", odds_ratio(F.greatest(F.col("c_bucket") / float(BUCKETS), F.lit(1e-300)), F.col("p"))))
    return (t.join(cut.select("c_source", "cut"), F.col("t_source").eqNullSafe(F.col("c_source")), "left")
            .select(F.col("t_source").alias("plan_source"), "source_size", "target", "whole", "p", "cut"))


def times(u, plan):
    """Copies of a document that draws ``u``; ``plan`` gives the plan's columns by name."""
    q = F.when(plan("p") > 0, odds_ratio(u, plan("p")))
    return (plan("whole") + F.when(q <= plan("cut"), 1).otherwise(0)).cast("long")


def pareto_mix(docs: DataFrame, weights=WEIGHTS, max_times: int = MAX_TIMES, seed: str = SEED) -> DataFrame:
    """``docs`` with the columns ``ADDED``: words, words of the source, target, copies to take."""
    folder = run_folder(docs.sparkSession, "mix")
    plan = materialise(mixing_plan(docs, weights, max_times, seed, folder=folder), folder, "plan")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    d = docs.select(F.struct(*kept).alias("doc"), "source", word_count(F.col("text")).alias("size"), draw(seed).alias("u"))
    j = d.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    return j.select("doc.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"),
                    F.col("target").alias("mix_target"), times(F.col("u"), F.col).alias("mix_copies"))


def taken(docs: DataFrame, weights=WEIGHTS, max_times: int = MAX_TIMES, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: the mix in figures, from the narrow rows alone."""
    folder = run_folder(docs.sparkSession, "mix")
    rows = materialise(narrow_rows(docs, seed), folder, "rows")
    plan = materialise(mixing_plan(docs, weights, max_times, seed, rows=rows, folder=folder), folder, "plan")
    j = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    return j.select("doc_id", "size", "source_size", "target", (times(F.col("u"), F.col) * F.col("size")).alias("taken"))
