"""Portfolio aggregates, top-k and profiling.

All group-bys here are over low-cardinality keys (state, sector, tier) or
global.  Spark runs them as partial (map-side) aggregation followed by a
small final aggregation, so a key that holds a third of all loans costs no
more than any other key: only one partial row per key and task is shuffled.
Grouping keys that are NULL are dropped first, like pandas ``groupby``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tempest import config
from tempest.functions import columns as C
from tempest.sources import dims


def _hc(cat: str = "Risk_Category") -> Column:
    return F.count_if(C.is_high_or_critical(cat))


def batch_summary(scored: DataFrame, n_input: Column | int | None = None) -> DataFrame:
    """A1: n_scored, averages of PD / CPD / uplift, total expected loss."""
    aggs = [
        F.count(F.lit(1)).alias("n_scored"),
        F.avg("Baseline_PD").alias("avg_baseline_pd"),
        F.avg("CPD").alias("avg_cpd"),
        F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
        F.sum("Expected_Loss").alias("total_expected_loss"),
    ]
    out = scored.agg(*aggs)
    if n_input is not None:
        out = out.withColumn("n_input", n_input if isinstance(n_input, Column) else F.lit(n_input))
    return out


def overview(scored: DataFrame) -> DataFrame:
    """A2 (+A25): averages and the High/Critical count."""
    return scored.agg(
        F.avg("Baseline_PD").alias("avg_baseline_pd"),
        F.avg("CPD").alias("avg_cpd"),
        F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
        F.avg(F.col("CPD") - F.col("Baseline_PD")).alias("avg_pd_increase"),
        _hc().alias("high_critical"),
    )


def tier_counts(scored: DataFrame, all_tiers: bool = True) -> DataFrame:
    """A3: loans per risk tier; with ``all_tiers`` every tier appears (0 if empty)."""
    counts = scored.where(F.col("Risk_Category").isNotNull()).groupBy("Risk_Category") \
        .agg(F.count(F.lit(1)).alias("loan_count"))
    if not all_tiers:
        return counts
    tiers = dims.tier_dim(scored.sparkSession)
    return tiers.join(counts, "Risk_Category", "left").select(
        "Risk_Category", "tier_order", F.coalesce("loan_count", F.lit(0).cast("bigint")).alias("loan_count"))


def state_risk(scored: DataFrame, state_col: str = "addr_state", having: Column | None = None) -> DataFrame:
    """A4 + J7: per state averages, count, exposure, High/Critical count and share, static hazard.

    The state key is stripped (P15) before grouping; NULL states are dropped, and so are those
    for which the aggregate ``having`` is not true.
    """
    keyed = scored.withColumn("state", C.strip_key(state_col)).where(F.col("state").isNotNull())
    agg = keyed.groupBy("state").agg(
        F.avg("CPD").alias("avg_cpd"),
        F.avg("Baseline_PD").alias("avg_baseline_pd"),
        F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
        F.count("CPD").alias("loan_count"),
        F.sum("EAD").alias("total_exposure"),
        _hc().alias("high_critical"),
        *([] if having is None else [having.alias("_having")]),
    ).withColumn("high_critical_pct", F.col("high_critical") / F.col("loan_count") * 100.0)
    if having is not None:
        agg = agg.where("_having").drop("_having")
    dim = dims.state_dim(scored.sparkSession).select(
        F.col("state_key").alias("state"), F.col("physical_risk"))
    return agg.join(dim, "state", "left").withColumn(
        "physical_risk", F.coalesce("physical_risk", C.lit_d(0.45)))


def state_map_points(state_agg: DataFrame) -> DataFrame:
    """J6 + P37: states with coordinates (others dropped) and a bubble radius."""
    coords = dims.state_dim(state_agg.sparkSession).where(F.col("lat").isNotNull()) \
        .select(F.col("state_key").alias("state"), "lat", "lon")
    return state_agg.join(coords, "state", "inner").withColumn("radius", C.bubble_radius("loan_count"))


def states_with_tiers(scored: DataFrame, tiers: Sequence[str], state_col: str = "addr_state") -> DataFrame:
    """Per-state aggregate restricted to states with a loan in the chosen tiers, in one pass."""
    return state_risk(scored, state_col, having=F.max(F.col("Risk_Category").isin(*tiers)))


def sector_risk(scored: DataFrame, key: str = "purpose") -> DataFrame:
    """A5: per purpose/sector averages and count."""
    return scored.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg("Baseline_PD").alias("avg_baseline_pd"),
        F.avg("CPD").alias("avg_cpd"),
        F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
        F.count("CPD").alias("loan_count"),
    )


def el_by_tier(scored: DataFrame) -> DataFrame:
    """Expected loss by tier with EL rate."""
    return scored.where(F.col("Risk_Category").isNotNull()).groupBy("Risk_Category").agg(
        F.count("Expected_Loss").alias("loan_count"),
        F.sum("EAD").alias("total_ead"),
        F.sum("Expected_Loss").alias("total_el"),
        F.avg("CPD").alias("avg_cpd"),
    ).withColumn("el_rate", F.col("total_el") / (F.col("total_ead") + C.lit_d(1e-8)))


def el_by_sector(scored: DataFrame, key: str = "purpose") -> DataFrame:
    """A7."""
    return scored.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("Expected_Loss").alias("total_el"),
        F.avg("CPD").alias("avg_cpd"),
        F.count("Expected_Loss").alias("loan_count"),
    )


def el_totals(scored: DataFrame) -> DataFrame:
    """A8."""
    return scored.agg(
        F.sum("EAD").alias("total_ead"),
        F.sum("Expected_Loss").alias("total_el"),
    ).withColumn("avg_el_rate", F.col("total_el") / (F.col("total_ead") + C.lit_d(1e-8)))


def report_headline(scored: DataFrame) -> DataFrame:
    """Share High/Critical and the uplift of the averages (not the average uplift)."""
    return scored.agg(
        F.avg("Baseline_PD").alias("avg_baseline_pd"),
        F.avg("CPD").alias("avg_cpd"),
        (_hc() / F.count(F.lit(1)) * 100.0).alias("high_critical_share_pct"),
    ).withColumn("portfolio_uplift_pct",
                 (F.col("avg_cpd") - F.col("avg_baseline_pd")) / (F.col("avg_baseline_pd") + C.lit_d(1e-8)) * 100.0)


def map_extents(state_agg: DataFrame) -> DataFrame:
    """A10: state count, loan total, max average CPD, metric range."""
    return state_agg.agg(
        F.count(F.lit(1)).alias("n_states"),
        F.sum("loan_count").alias("total_loans"),
        F.max("avg_cpd").alias("max_avg_cpd"),
        F.min("avg_cpd").alias("min_avg_cpd"),
    )


def class_balance(df: DataFrame, label: str = "default") -> DataFrame:
    """Counts per class, default rate, positive weight neg/pos."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
        F.avg(F.col(label).cast("double")).alias("default_rate"),
    ).withColumn("pos_weight", F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive")))


def top_n(df: DataFrame, metric: str, n: int, tiebreak: str | Sequence[str] | None = None,
          ascending: bool = False) -> DataFrame:
    """``orderBy(...).limit(n)`` (planned as TakeOrderedAndProject:
    each task keeps its own n best rows, only n rows per task are shuffled)."""
    order = [F.col(metric).asc() if ascending else F.col(metric).desc()]
    if tiebreak:
        tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
        order += [F.col(t).asc() for t in tb]
    return df.orderBy(*order).limit(n)


def top_by_abs(df: DataFrame, metric: str, n: int, tiebreak: str) -> DataFrame:
    """T5: sort by absolute value, descending."""
    return df.orderBy(F.abs(F.col(metric)).desc(), F.col(tiebreak).asc()).limit(n)


def row_of_max(df: DataFrame, metric: str, key: str | Sequence[str]) -> DataFrame:
    """T4: ``idxmax``; ties go to the smallest key (the first row in key order).

    Planned as a top-1 TakeOrderedAndProject: each task keeps one row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.col(metric).desc(), *[F.col(k).asc() for k in keys]).limit(1)


def preview(df: DataFrame, n: int, key: str = "loan_id") -> DataFrame:
    """First n rows in key order (a deterministic preview)."""
    return df.orderBy(F.col(key).asc()).limit(n)


def seeded_sample(df: DataFrame, n: int, key: str = "loan_id", seed: int = config.RANDOM_STATE) -> DataFrame:
    """Reproducible sample of n rows: order by md5(key || seed), take n."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def histogram(df: DataFrame, value: str, bins: int, group: str | None = None) -> DataFrame:
    """Fixed-width histogram; bin width from the column's min/max (scalar subquery).

    The column is read twice (extent, then bins), so its narrow projection is
    checkpointed once instead of recomputing the upstream pipeline twice.
    """
    from tempest.session import cut_lineage
    df = cut_lineage(df.select(value, *([group] if group else [])))
    ext = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(
        F.struct("lo", "hi").alias("e")).scalar()
    lo, hi = ext.getField("lo"), ext.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - lo) / F.when(width == 0, F.lit(1.0)).otherwise(width)).cast("int"),
                F.lit(bins - 1)))
    keys = ([group] if group else [])
    out = df.where(F.col(value).isNotNull()).withColumn("bin", idx)
    if group:
        out = out.where(F.col(group).isNotNull())
    return out.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")).withColumns({
        "bin_lo": lo + F.col("bin") * width,
        "bin_hi": lo + (F.col("bin") + 1) * width,
    })


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-missing keys."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def geography_is_state_codes(df: DataFrame, key: str = "addr_state") -> DataFrame:
    """F8: true if any distinct stripped key has length 2."""
    return df.select(C.strip_key(key).alias("k")).where(F.col("k").isNotNull()).agg(
        F.coalesce(F.max(F.length("k") == 2), F.lit(False)).alias("is_state_codes"))


def rank_desc_avg(df: DataFrame, metric: str, out: str = "rank") -> DataFrame:
    """W1/W2 on a small table: descending rank with ties sharing the average rank (int)."""
    w = Window.orderBy(F.col(metric).desc())
    wt = Window.partitionBy(metric)
    return df.withColumn(out, (F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0).cast("int"))
