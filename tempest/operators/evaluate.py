"""Evaluation of a probability score against a binary label.

Every metric here needs the rows in score order (AUC, ROC/PR curves, mid-ranks,
DeLong).  A window with ``orderBy`` and no ``partitionBy`` would move the whole
table into one task, so ordering goes through two steps that stay distributed:

1. rows are first reduced to one row per *distinct* score with positive and
   negative counts (partial aggregation map-side, so a hot score value costs
   one row, not a third of the table);
2. ``prefix_sums`` assigns the distinct scores to range buckets cut at
   approximate quantiles (JVM-side ``Bucketizer``, binary search), takes the
   running sum inside each bucket with a window partitioned by bucket, and adds
   the exclusive running total of all earlier buckets (a table with one row per
   bucket).  Bucket count grows with the data (``rows_per_bucket``), so no task
   holds more than about that many distinct scores.

Curves and thresholds follow the conventions of the method's metrics library:
thresholds are the distinct scores; a point at threshold ``t`` counts the rows
with score ``>= t``; argmin / argmax take the first point in ascending
threshold order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import quantiles as Q
from tempest.session import cut_lineage

ROWS_PER_BUCKET = 2_000_000
LEAST_BUCKETS = 8
SPLIT_ROWS_PER_BUCKET = 20_000
Z_975 = 1.959963984540054  # standard normal quantile at 0.975 (95 % interval)


# ---------------------------------------------------------------------------
# Distributed ordering
# ---------------------------------------------------------------------------
def range_bucket(df: DataFrame, order_col: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                 out: str = "_bucket") -> DataFrame:
    """Add a bucket id that is monotone in ``order_col`` (numeric, non-null).

    Bucket edges are approximate quantiles of the column, so buckets hold about
    the same number of rows; their number is ``ceil(rows / rows_per_bucket)``,
    ``LEAST_BUCKETS`` at least, so the plan is the same at every size.
    """
    n = df.count()
    k = max(LEAST_BUCKETS, math.ceil(n / max(1, rows_per_bucket)))
    probs = [i / k for i in range(1, k)]
    cuts = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10 * k).alias("q")).first()[0]
    splits = [-math.inf] + sorted({float(x) for x in cuts or []}) + [math.inf]
    if len(splits) == 2:  # no rows
        return df.withColumn(out, F.lit(0.0))
    keyed = df.withColumn("_bk_in", F.col(order_col).cast("double"))
    return Bucketizer(splits=splits, inputCol="_bk_in", outputCol=out).transform(keyed).drop("_bk_in")


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], partition_cols: Sequence[str] = (),
                rows_per_bucket: int = ROWS_PER_BUCKET, tie_col: str | None = None) -> DataFrame:
    """Exclusive running sums ``<c>_before`` of ``sum_cols`` in ``order_col`` order.

    ``<c>_before`` is the sum of ``c`` over the rows of the same partition that
    come earlier in (``order_col``, ``tie_col``) order.  The keys should be
    unique within a partition (e.g. one row per distinct score); ``tie_col``
    makes the order total otherwise.
    """
    parts = list(partition_cols)
    b = range_bucket(df, order_col, rows_per_bucket)
    totals = b.groupBy(*parts, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_tot = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(w_tot), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    joined = b.join(offsets, parts + ["_bucket"], "inner")
    order = [F.col(order_col)] + ([F.col(tie_col)] if tie_col else [])
    w_in = Window.partitionBy(*parts, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *[c for c in df.columns],
        *[(F.coalesce(F.sum(c).over(w_in), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sum_cols],
    )


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score: (score, n_pos, n_neg); rows with a missing score or label are left out.

    The table is checkpointed into the session's checkpoint folder: the
    ordering steps read it several times (count, quantiles, sums), and after
    the checkpoint none of them goes back to the scored rows.
    """
    y = F.col(label).cast("long")
    return cut_lineage(df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                       .groupBy(F.col(score).cast("double").alias("score"))
                       .agg(F.sum(y).alias("n_pos"), F.sum(F.lit(1) - y).alias("n_neg")))


def curve_counts(df: DataFrame, label: str = "label", score: str = "score",
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per distinct score ``t``: tp / fp = positives / negatives with score >= t, plus totals."""
    sc = score_counts(df, label, score)
    P = sc.agg(F.sum("n_pos")).scalar()  # scalar subqueries over the (checkpointed) distinct-score table
    N = sc.agg(F.sum("n_neg")).scalar()
    pre = prefix_sums(sc, "score", ["n_pos", "n_neg"], rows_per_bucket=rows_per_bucket)
    return pre.select(
        "score", "n_pos", "n_neg", P.alias("P"), N.alias("N"), "n_pos_before", "n_neg_before",
        (F.col("P") - F.col("n_pos_before")).alias("tp"),
        (F.col("N") - F.col("n_neg_before")).alias("fp"),
    )


# ---------------------------------------------------------------------------
# Ranking metrics
# ---------------------------------------------------------------------------
def auc(df: DataFrame, label: str = "label", score: str = "score",
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """ROC AUC by the rank-sum rule, ties counted one half.  One row: auc, n_pos, n_neg."""
    cc = curve_counts(df, label, score, rows_per_bucket)
    num = F.sum(F.col("n_pos") * (F.col("n_neg_before") + F.col("n_neg") * 0.5))
    return cc.agg(
        (num / (F.first("P") * F.first("N"))).cast("double").alias("auc"),
        F.first("P").cast("long").alias("n_pos"), F.first("N").cast("long").alias("n_neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    cc = curve_counts(df, label, score, rows_per_bucket)
    return cc.select(F.col("score").alias("threshold"),
                     (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))


def pr_points(df: DataFrame, label: str = "label", score: str = "score",
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(threshold, precision, recall) at every distinct score; only points with a threshold."""
    cc = curve_counts(df, label, score, rows_per_bucket)
    return cc.select(F.col("score").alias("threshold"),
                     (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     (F.col("tp") / F.col("P")).alias("recall"))


def cost_threshold(pr: DataFrame, fn_cost: float = config.FN_COST, fp_cost: float = config.FP_COST) -> DataFrame:
    """Threshold minimising fn_cost*(1-recall) + fp_cost*(1-precision); ties -> lowest threshold."""
    cost = C.lit_d(fn_cost) * (1 - F.col("recall")) + C.lit_d(fp_cost) * (1 - F.col("precision"))
    best = pr.agg(F.min(F.struct(cost.alias("cost"), F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost"))


def f1_threshold(pr: DataFrame) -> DataFrame:
    """Threshold maximising F1 = 2pr/(p+r+1e-8); ties -> lowest threshold."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + C.lit_d(1e-8))
    best = pr.agg(F.min(F.struct((-f1).alias("neg_f1"), F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), (-F.col("b.neg_f1")).alias("f1"))


def midrank(df: DataFrame, value: str, id_cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """1-based rank with ties sharing the average rank, for every row."""
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v"))
                         .agg(F.count(F.lit(1)).alias("n")))
    pre = prefix_sums(counts, "_v", ["n"], rows_per_bucket=rows_per_bucket)
    ranks = pre.select("_v", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("midrank"))
    rows = df.select(*id_cols, F.col(value).cast("double").alias("_v"))
    return rows.join(ranks, "_v").select(*id_cols, F.col("_v").alias(value), "midrank")


def average_rank_desc(df: DataFrame, metric: str, partition_cols: Sequence[str] = ()) -> Column:
    """Pandas ``rank(ascending=False)`` (average of tied ranks), truncated to int.

    Meant for small result tables (one row per model); ``partition_cols`` bound
    the window.
    """
    w = Window.partitionBy(*partition_cols).orderBy(F.col(metric).desc())
    wt = Window.partitionBy(*partition_cols, metric)
    return (F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0).cast("int")


# ---------------------------------------------------------------------------
# Threshold metrics
# ---------------------------------------------------------------------------
def brier(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean squared difference of score and label."""
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label).cast("double"), 2)).alias("brier"))


def confusion(df: DataFrame, threshold, label: str = "label", score: str = "score") -> DataFrame:
    """Counts of (label, prediction) with prediction = score >= threshold; all four cells."""
    t = threshold if isinstance(threshold, Column) else C.lit_d(threshold)
    pred = (F.col(score) >= t).cast("int")
    y = F.col(label).cast("int")
    return df.agg(*[
        F.count_if((y == a) & (pred == b)).alias(f"n_{a}{b}") for a in (0, 1) for b in (0, 1)
    ]).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(f"n_{a}{b}").alias("n"))
        for a in (0, 1) for b in (0, 1)])).alias("c")).select("c.*")


def class_report(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class plus accuracy, macro and weighted averages.

    Undefined ratios (no predicted / no actual rows) are 0, as with
    ``zero_division=0``.
    """
    piv = conf.agg(*[F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("n")))
                     .alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])

    def ratio(a, b):
        return F.when(b == 0, C.lit_d(0.0)).otherwise(a.cast("double") / b)

    n00, n01, n10, n11 = (F.col(x) for x in ("n00", "n01", "n10", "n11"))
    rows = []
    for cls, tp, fp, fn in ((0, n00, n10, n01), (1, n11, n01, n10)):
        p = ratio(tp, tp + fp)
        rc = ratio(tp, tp + fn)
        f1 = F.when((p + rc) == 0, C.lit_d(0.0)).otherwise(2 * p * rc / (p + rc))
        rows.append((F.lit(str(cls)), p, rc, f1, (tp + fn).cast("double")))
    total = (n00 + n01 + n10 + n11).cast("double")
    acc = (n00 + n11).cast("double") / total
    body = piv.select(*[F.struct(n.alias("class"), p.alias("precision"), rc.alias("recall"),
                                 f.alias("f1"), s.alias("support")).alias(f"r{i}")
                        for i, (n, p, rc, f, s) in enumerate(rows)], total.alias("total"), acc.alias("acc"))
    r0, r1 = F.col("r0"), F.col("r1")
    macro = F.struct(F.lit("macro avg").alias("class"),
                     ((r0["precision"] + r1["precision"]) / 2).alias("precision"),
                     ((r0["recall"] + r1["recall"]) / 2).alias("recall"),
                     ((r0["f1"] + r1["f1"]) / 2).alias("f1"), F.col("total").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("class"), *[
        ((r0[m] * r0["support"] + r1[m] * r1["support"]) / F.col("total")).alias(m)
        for m in ("precision", "recall", "f1")], F.col("total").alias("support"))
    accuracy = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                        F.col("total").alias("support"))
    return body.select(F.explode(F.array(r0, r1, accuracy, macro, weighted)).alias("r")).select("r.*")


def rate_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Percentile ``100*(1-rate)`` of the scores, rate = share of positives.

    Two steps: the share is needed before the quantile.
    """
    rate = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    q = (100.0 * (1.0 - rate)) / 100.0
    return Q.quantiles(df, score, [q]).select(F.lit(rate).alias("default_rate"), F.col("q")[0].alias("threshold"))


# ---------------------------------------------------------------------------
# Calibration
# ---------------------------------------------------------------------------
def linspace(start: float, stop: float, num: int) -> list[float]:
    """Edges as the method builds them: ``start + i*step`` and the exact stop (0.30000000000000004 kept)."""
    step = (stop - start) / (num - 1)
    return [start + i * step for i in range(num - 1)] + [stop]


def ece(df: DataFrame, n_bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Expected calibration error over equal-width bins ``[e_i, e_i+1)``.

    A score of exactly 1.0 (or outside [0, 1)) lands in no bin but still counts
    in the total, as in the method.
    """
    edges = linspace(0.0, 1.0, n_bins + 1)
    p = F.col(score)
    b = None
    for i in range(n_bins):
        cond = (p >= C.lit_d(edges[i])) & (p < C.lit_d(edges[i + 1]))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    binned = df.select(b.alias("bin"), F.col(label).cast("double").alias("y"), p.alias("p"))
    total = binned.agg(F.count(F.lit(1))).scalar()
    per_bin = binned.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("frac_pos"), F.avg("p").alias("mean_pred"))
    return per_bin.agg(
        F.sum(F.col("n") / total * F.abs(F.col("frac_pos") - F.col("mean_pred"))).alias("ece"))


def reliability(df: DataFrame, n_bins: int = 15, label: str = "label", score: str = "score") -> DataFrame:
    """Quantile-bin reliability curve.

    Edges are exact percentiles of the scores at ``linspace(0, 1, n_bins+1)``;
    a score's bin is the number of inner edges strictly below it; empty bins
    are dropped.  Output: bin, n, mean_pred, frac_pos.
    """
    probs = [(q * 100.0) / 100.0 for q in linspace(0.0, 1.0, n_bins + 1)]
    edges = Q.quantiles(df, score, probs).scalar()
    below = [F.when(edges[i] < F.col(score), F.lit(1)).otherwise(F.lit(0)) for i in range(1, n_bins)]
    binned = df.select(
        sum(below[1:], below[0]).alias("bin"),
        F.col(label).cast("double").alias("y"), F.col(score).alias("p"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"),
                                     F.avg("y").alias("frac_pos"))


# ---------------------------------------------------------------------------
# DeLong comparison of two correlated AUCs
# ---------------------------------------------------------------------------
def delong(df: DataFrame, score_a: str, score_b: str, label: str = "label", id_col: str = "id",
           rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """AUCs of two scores on the same rows, their DeLong covariance, z and 95 % intervals.

    Structural components per row: for a positive with score s,
    v01 = (#neg < s + #neg = s / 2) / N; for a negative, v10 = (#pos > s + #pos = s / 2) / P.
    The covariance is cov(v01)/P + cov(v10)/N (sample covariances).  All
    counts come from the distinct-score tables; each row picks its
    components up with one lookup join per score.
    """
    comps = []
    for s in (score_a, score_b):
        cc = curve_counts(df.select(F.col(label).alias("label"), F.col(s).alias("score")),
                          rows_per_bucket=rows_per_bucket)
        comps.append(cc.select(
            F.col("score").alias(f"_s_{s}"),
            ((F.col("n_neg_before") + F.col("n_neg") * 0.5) / F.col("N")).alias(f"v01_{s}"),
            ((F.col("P") - F.col("n_pos_before") - F.col("n_pos") + F.col("n_pos") * 0.5) / F.col("P"))
            .alias(f"v10_{s}")))
    rows = df.where(F.col(label).isNotNull() & F.col(score_a).isNotNull() & F.col(score_b).isNotNull()) \
        .select(id_col, F.col(label).cast("int").alias("y"),
                F.col(score_a).cast("double").alias(f"_s_{score_a}"),
                F.col(score_b).cast("double").alias(f"_s_{score_b}"))
    for s, comp in zip((score_a, score_b), comps):
        rows = rows.join(comp, f"_s_{s}")
    va = F.when(F.col("y") == 1, F.col(f"v01_{score_a}")).otherwise(F.col(f"v10_{score_a}"))
    vb = F.when(F.col("y") == 1, F.col(f"v01_{score_b}")).otherwise(F.col(f"v10_{score_b}"))
    comp_rows = rows.select("y", va.alias("va"), vb.alias("vb"))
    stats = comp_rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"),
        F.var_samp("va").alias("saa"), F.var_samp("vb").alias("sbb"), F.covar_samp("va", "vb").alias("sab"))
    # one row per class: pivot the two rows into one with conditional aggregates
    def pick(c, y):
        return F.max(F.when(F.col("y") == y, F.col(c)))
    j = stats.agg(*[pick(c, y).alias(f"{c}_{y}") for c in ("n", "ma", "mb", "saa", "sbb", "sab") for y in (0, 1)])
    auc_a, auc_b = F.col("ma_1"), F.col("mb_1")
    var_a = F.col("saa_1") / F.col("n_1") + F.col("saa_0") / F.col("n_0")
    var_b = F.col("sbb_1") / F.col("n_1") + F.col("sbb_0") / F.col("n_0")
    cov = F.col("sab_1") / F.col("n_1") + F.col("sab_0") / F.col("n_0")
    out = j.select(auc_a.alias("auc_a"), auc_b.alias("auc_b"), var_a.alias("var_a"), var_b.alias("var_b"),
                   cov.alias("cov_ab"))
    z = F.abs(F.col("auc_a") - F.col("auc_b")) / F.sqrt(F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"))
    return out.select("*", z.alias("z"),
                      (F.col("auc_a") - Z_975 * F.sqrt("var_a")).alias("ci_a_low"),
                      (F.col("auc_a") + Z_975 * F.sqrt("var_a")).alias("ci_a_high"),
                      (F.col("auc_b") - Z_975 * F.sqrt("var_b")).alias("ci_b_low"),
                      (F.col("auc_b") + Z_975 * F.sqrt("var_b")).alias("ci_b_high"))


#: Coefficients of the Chebyshev fit of erfc (relative error below 1.2e-7), constant first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_p(z: Column) -> Column:
    """P-value 2*(1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = C.lit_d(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = C.lit_d(c) + t * poly
    return t * F.exp(-x * x + poly)


# ---------------------------------------------------------------------------
# Split and weights
# ---------------------------------------------------------------------------
def split_hash(id_col: str, seed: int = config.RANDOM_STATE) -> Column:
    """A reproducible 60-bit pseudo-random key per row: first 15 hex digits of md5(id || seed)."""
    h = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 15)
    return F.conv(h, 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id", test_size: float = config.TEST_SIZE,
                     calib_size: float = 0.25, seed: int = config.RANDOM_STATE,
                     rows_per_bucket: int = SPLIT_ROWS_PER_BUCKET) -> DataFrame:
    """M1: stratified 60/20/20 split with exact per-class shares.

    Rows of each class are ordered by a seeded hash, ties by id; the first
    ``ceil(test_size * n_c)`` are ``test``, of the rest the first
    ``ceil(calib_size * rest_c)`` are ``calib``, the others ``train``.  Rows
    without an id or a label are left out.

    Only the two keys (hash, id) of a class at which a part ends are looked
    for: counts per range of the hash tell in which range they lie, and only
    the rows of those ranges are put in order.  The split itself is then a
    comparison in the scan of ``df``; no row of it is shuffled.
    """
    ranges = max(LEAST_BUCKETS, math.ceil(df.count() / max(1, rows_per_bucket)))
    h = split_hash(id_col, seed)
    narrow = df.select(F.col(label).alias("_c"), F.col(id_col).alias("_id"), h.alias("_h")).where(F.col("_c").isNotNull())
    # the hash has 60 bits; its upper 53 are exact in a double
    narrow = narrow.withColumn("_r", F.floor(F.shiftright("_h", 7).cast("double") / float(1 << 53) * ranges))
    counts = narrow.groupBy("_c", "_r").agg(F.count(F.lit(1)).alias("_w"))
    by_class = Window.partitionBy("_c")
    before = by_class.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    n_test = F.ceil(F.col("_n") * C.lit_d(test_size))
    n_cal = F.ceil((F.col("_n") - F.col("_ends")[0]) * C.lit_d(calib_size))
    placed = counts.withColumn("_n", F.sum("_w").over(by_class)).where(F.col("_r").isNotNull()) \
        .withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0))) \
        .withColumn("_ends", F.array(n_test)).withColumn("_ends", F.array(F.col("_ends")[0], F.col("_ends")[0] + n_cal))
    here = placed.select("_c", "_r", "_before", "_w", F.posexplode("_ends").alias("_part", "_end")) \
        .where((F.col("_before") <= F.col("_end")) & (F.col("_end") < F.col("_before") + F.col("_w")))
    inside = narrow.join(F.broadcast(here), ["_c", "_r"])
    place = F.row_number().over(Window.partitionBy("_c", "_part").orderBy("_h", "_id")) - 1 + F.col("_before")
    tied = F.min("_place").over(Window.partitionBy("_c", "_part", "_h", "_id"))
    ends = inside.withColumn("_place", place).withColumn("_first", tied).where(F.col("_place") == F.col("_end"))
    # a row a class and part; a class whose part ends behind its last row has none
    found = ends.select("_c", "_part", "_h", "_id", (F.col("_end") - F.col("_first")).alias("_over"))
    keys = found.groupBy("_c").agg(*[F.max(F.when(F.col("_part") == i, F.struct("_h", "_id", "_over"))).alias(f"_k{i}") for i in (0, 1)])
    known = keys.toArrow()  # two keys a class
    cuts = F.broadcast(df.sparkSession.createDataFrame(known, keys.schema))
    joined = df.withColumn("_h", h).where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).join(cuts, F.col(label) == F.col("_c"), "left")
    equal = [(F.col("_h") == F.col(f"_k{i}._h")) & (F.col(id_col) == F.col(f"_k{i}._id")) for i in (0, 1)]
    if any(k is not None and k["_over"] for r in known.to_pylist() for k in (r["_k0"], r["_k1"])):
        # equal rows on both sides of an end: numbered among themselves
        some = F.coalesce(equal[0], F.lit(False)) | F.coalesce(equal[1], F.lit(False))
        nth = F.row_number().over(Window.partitionBy(label, id_col).orderBy("_h"))
        joined = joined.where(~some).withColumn("_nth", F.lit(0)).unionByName(joined.where(some).withColumn("_nth", nth))
    else:
        joined = joined.withColumn("_nth", F.lit(1))

    def ahead(i: int) -> Column:
        k = F.col(f"_k{i}")
        less = (F.col("_h") < k["_h"]) | ((F.col("_h") == k["_h"]) & (F.col(id_col) < k["_id"]))
        return k.isNull() | less | (equal[i] & (F.col("_nth") <= k["_over"]))

    part = F.when(ahead(0), F.lit("test")).when(ahead(1), F.lit("calib")).otherwise(F.lit("train"))
    return joined.select(label, *[c for c in df.columns if c != label], part.alias("split"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts, default rate, positive weight neg/pos and 'balanced' weights n/(2 n_c)."""
    y = F.col(label).cast("double")
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"))
    n, p = F.col("n").cast("double"), F.col("n_pos")
    return agg.select(F.col("n").cast("long").alias("n"), p.cast("long").alias("n_pos"),
                      (n - p).cast("long").alias("n_neg"), (p / n).alias("default_rate"),
                      ((n - p) / p).alias("scale_pos_weight"),
                      (n / (2 * (n - p))).alias("weight_neg"), (n / (2 * p)).alias("weight_pos"))


def with_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """M2: per-row weight column (neg/pos on positives, 1 on negatives) for ``weightCol``."""
    w = class_weights(df, label).select("scale_pos_weight").scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, w).otherwise(C.lit_d(1.0)))
