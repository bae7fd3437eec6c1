"""Drift (PSI), feature statistics and profiling.

Everything works on a long form ``(feature, value)`` produced by one
``unpivot``, so 38 features cost one scan and one grouped pass instead of
38 jobs.  Bin edges are one small row per feature (bounded by the number
of features) and are broadcast to the value rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import quantiles as Q
from tempest.session import cut_lineage

STAT_PERCENTILES = [("p10", 0.10), ("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p90", 0.90)]


def long_form(df: DataFrame, features: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """Wide feature columns to (id..., feature, value DOUBLE); missing values dropped."""
    feats = [f for f in features if f in df.columns]
    wide = df.select(*id_cols, *[F.col(f).cast("double").alias(f) for f in feats])
    return wide.unpivot(list(id_cols), feats, "feature", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))


def feature_stats(long_df: DataFrame, percentiles=STAT_PERCENTILES) -> DataFrame:
    """Count, mean, sample std, min, percentiles, max per feature (transposed describe)."""
    probs = [p for _, p in percentiles]
    stats = long_df.groupBy("feature").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ).join(Q.quantiles(long_df, "value", probs, ["feature"], "_q"), "feature")
    return stats.select("feature", "count", "mean", "std", "min",
                        *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(percentiles)], "max")


def edges_at_or_below(edges: Column, v: Column, max_edges: int) -> Column:
    """Number of edges <= v for an edge array of at most ``max_edges`` entries.

    A fixed sum of comparisons (``try_element_at`` is NULL past the end), so it
    stays in generated code, unlike a lambda over the array.
    """
    terms = [F.when(F.try_element_at(edges, F.lit(i + 1)) <= v, F.lit(1)).otherwise(F.lit(0))
             for i in range(max_edges)]
    return sum(terms[1:], terms[0])


def psi(expected: DataFrame, actual: DataFrame, n_bins: int = config.PSI_BINS) -> DataFrame:
    """PSI per feature between two long-form samples.

    Edges: percentiles 0, 1/n, ..., 1 of the expected sample, deduplicated,
    ends widened by 1e-8; fewer than 2 edges -> PSI 0.  Bins are half-open
    with a closed last bin; values outside the edges fall in no bin but
    still count in the denominator; empty bins take share 1e-4.
    """
    return psi_with_counts(expected, actual, n_bins).select("feature", "psi")


def psi_with_counts(expected: DataFrame, actual: DataFrame, n_bins: int = config.PSI_BINS) -> DataFrame:
    """``psi`` plus ``n_actual`` (rows of the feature in the actual sample, NULL when none).

    Each sample is read once: one grouped count per (feature, bin), where
    rows outside the edges (or of a feature with fewer than two edges) go to
    bin -1; totals and presence come from that small table.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = (Q.quantiles(expected, "value", probs, ["feature"])
             .join(expected.groupBy("feature").agg(F.count(F.lit(1)).alias("n_expected")), "feature")
             .select("feature", F.array_sort(F.array_distinct("q")).alias("e"), "n_expected"))
    k = F.size("e")
    widened = F.when(k >= 2, F.concat(
        F.array(F.col("e")[0] - C.lit_d(1e-8)),
        F.slice("e", 2, F.greatest(k - 2, F.lit(0))),
        F.array(F.element_at("e", -1) + C.lit_d(1e-8)),
    ))
    # one row per feature: bounded by the number of features; read five times below
    edges = F.broadcast(cut_lineage(edges.select("feature", "n_expected", widened.alias("edges"))))

    def binned(sample: DataFrame, side: str) -> DataFrame:
        e = F.col("edges")
        last = F.element_at(e, -1)
        idx = F.when(
            e.isNotNull() & (F.col("value") >= e[0]) & (F.col("value") <= last),
            F.least(edges_at_or_below(e, F.col("value"), n_bins + 1) - 1, F.size(e) - 2),
        ).otherwise(F.lit(-1))
        return sample.join(edges.select("feature", "edges"), "feature") \
            .groupBy("feature", idx.alias("bin")).agg(F.count(F.lit(1)).alias(f"n_{side}"))

    exp_counts = binned(expected, "exp")
    act_counts = binned(actual, "act")
    n_actual = act_counts.groupBy("feature").agg(F.sum("n_act").alias("n_actual"))
    bins = edges.where(F.size("edges") >= 2).select(
        "feature", "n_expected", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    counts = (bins.join(exp_counts, ["feature", "bin"], "left")
              .join(act_counts, ["feature", "bin"], "left")
              .join(n_actual, "feature", "left"))
    e_pct = F.when(F.coalesce("n_exp", F.lit(0)) == 0, C.lit_d(1e-4)) \
        .otherwise(F.col("n_exp") / F.col("n_expected"))
    a_pct = F.when(F.coalesce("n_act", F.lit(0)) == 0, C.lit_d(1e-4)) \
        .otherwise(F.col("n_act") / F.greatest(F.coalesce("n_actual", F.lit(0)), F.lit(1)))
    per_feature = counts.groupBy("feature").agg(F.sum((a_pct - e_pct) * F.log(a_pct / e_pct)).alias("psi"),
                                                F.first("n_actual").alias("n_actual"))
    # features with fewer than two distinct edges have PSI 0
    degenerate = edges.where(F.size("edges").isNull() | (F.size("edges") < 2)).select(
        "feature", C.lit_d(0.0).alias("psi")).join(n_actual, "feature", "left")
    return per_feature.unionByName(degenerate)


def reference_sample(stats: DataFrame) -> DataFrame:
    """Synthetic reference values per feature from stored statistics
    (min, p10, p25, p50, p75, p90, max repeated 6, 12, 18, 25, 18, 12, 6 times)."""
    parts = [F.array_repeat(F.col(name), n) for name, n in config.PSI_REFERENCE_REPEATS]
    return stats.select("feature", F.explode(F.flatten(F.array(*parts))).alias("value"))


def drift_status(psi_col: Column) -> Column:
    return (F.when(psi_col >= config.PSI_CRITICAL, F.lit("DRIFT"))
            .when(psi_col >= config.PSI_MODERATE, F.lit("MODERATE")).otherwise(F.lit("OK")))


def feature_drift(new_data: DataFrame, stats: DataFrame, features: Sequence[str] = config.ALL_FEATURES) -> DataFrame:
    """PSI of every model feature present in both the data and the stats.

    Status uses the unrounded PSI; the output PSI is rounded to 5 decimals.
    Features with no non-missing value in the new data are skipped.
    """
    feats = [f for f in features if f in new_data.columns]
    actual = long_form(new_data, feats)
    stats = stats.where(F.col("feature").isin(*feats))
    ref = reference_sample(stats)
    # Only features present in the new data (and in the stats)
    out = psi_with_counts(ref, actual).where(F.col("n_actual") > 0)
    return out.select("feature", F.round("psi", 5).alias("psi"), drift_status(F.col("psi")).alias("status"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """Number of features per status."""
    return drift.groupBy("status").agg(F.count(F.lit(1)).alias("n_features"))


def missing_profile(df: DataFrame) -> DataFrame:
    """A15 + F7: missing count and share per column, only columns with missing values."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long_df = counts.unpivot(["_n"], cols, "column", "missing_count")
    return long_df.where(F.col("missing_count") > 0).select(
        "column", "missing_count", (F.col("missing_count") / F.col("_n") * 100.0).alias("missing_pct"))


def correlations(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete rows), one pass.

    Each row is exploded into one (pair, x, y) record per pair inside the scan
    stage and ``corr`` runs per pair: a narrow hash aggregate (partial
    aggregation leaves one row per pair and task) instead of one aggregate
    with six buffer fields per pair, which would be too wide for generated code.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if target:
        pairs += [(c, target) for c in cols if c != target]
    recs = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"),
                              F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])
    per_pair = df.select(F.explode(recs).alias("r")).select("r.*") \
        .groupBy("pair").agg(F.corr("x", "y").alias("corr"))
    names_a = F.array(*[F.lit(a) for a, _ in pairs])
    names_b = F.array(*[F.lit(b) for _, b in pairs])
    return per_pair.select(F.element_at(names_a, F.col("pair") + 1).alias("col_a"),
                           F.element_at(names_b, F.col("pair") + 1).alias("col_b"), "corr")


def group_rates(df: DataFrame, keys: Sequence[str], label: str = "default") -> DataFrame:
    """Per key value: count and default rate (missing keys dropped)."""
    long_df = df.select(F.col(label).cast("double").alias("_y"), *[F.col(k).cast("string").alias(k) for k in keys]) \
        .unpivot(["_y"], list(keys), "dimension", "group_value").where(F.col("group_value").isNotNull())
    return long_df.groupBy("dimension", "group_value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("default_rate")) \
        .select("group_value", "n", "default_rate", "dimension")


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Min, quartiles, max per class."""
    q = Q.quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [by])
    return q.select(by, *[F.col("q")[i].alias(name) for i, name in enumerate(("min", "q1", "median", "q3", "max"))])


def clip_at_percentile(df: DataFrame, value: str, q: float = 0.99, out: str | None = None) -> DataFrame:
    """Clip a column at its q-th percentile (scalar subquery + null-safe clip)."""
    cap = Q.quantile(df, value, q)
    x = F.col(value)
    return df.withColumn(out or value, F.when(x.isNull(), x).otherwise(F.least(x, cap)))
