"""Batch scoring of an uploaded portfolio and the result sinks.

The upload is read header-driven with every column as text (no schema
inference pass over the file); the columns the pipeline uses are coerced
with ``try_*`` casts, incomplete rows are dropped, and the scored rows go to
CSV (S8) and JSON (S9, missing numbers as 0) with a one-row summary beside
them.  Writes are plain DataFrame writes into a run folder the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest import config
from tempest.functions import columns as C
from tempest.operators import cleaning, overlay, scoring
from tempest.sources import dims

REQUIRED = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment"]
NUMERIC = ["dti", "annual_inc", "fico_range_low", "installment", "loan_amnt"]
OUTPUT_EXTRA = ["Baseline_PD", "CPD", "PD_Uplift_Pct", "Risk_Category", "Expected_Loss"]


def prepare_upload(df: DataFrame) -> DataFrame:
    """F2 (raise before any job), P2 / P3 coercion, F1 drop of rows missing dti, income or score."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    cols = {c: C.percent_to_double(c) for c in NUMERIC if c in df.columns}
    cols["int_rate"] = C.percent_to_double("int_rate")
    if "emp_length" in df.columns:
        cols["emp_length"] = C.first_digits("emp_length", 0.0)
    return cleaning.drop_incomplete(df.withColumns(cols))


def score_upload(df: DataFrame, scenario: str = "orderly", severity: float = config.SEVERITY_FACTOR,
                 scaling: float = config.TRANSITION_SCALING, baseline=None) -> DataFrame:
    """R8 on the prepared upload; the input columns that exist plus the five result columns."""
    dims.validate_scenario(scenario)
    with_pd = baseline(df) if baseline else scoring.scorecard_pd(df)
    scored = overlay.score_cpd(with_pd, scenario=scenario, severity=severity, scaling=scaling)
    keep = [c for c in df.columns + OUTPUT_EXTRA if c in scored.columns]
    return scored.select(*keep)


def upload_summary(scored: DataFrame, n_input, scenario: str) -> DataFrame:
    """A1: counts, averages, total expected loss and the tier distribution in one aggregate."""
    tiers = [F.count_if(F.col("Risk_Category") == t).alias(f"n_{t.lower()}") for t in config.RISK_LABELS]
    return scored.agg(
        F.lit(n_input).cast("long").alias("n_input"), F.count(F.lit(1)).alias("n_scored"),
        F.lit(scenario).alias("scenario"), C.lit_d(dims.scenario_price(scenario)).alias("carbon_price_usd"),
        C.fixed_round_col(F.avg("Baseline_PD"), 6).alias("avg_baseline_pd"),
        C.fixed_round_col(F.avg("CPD"), 6).alias("avg_cpd"),
        C.fixed_round_col(F.avg("PD_Uplift_Pct"), 2).alias("avg_pd_uplift_pct"),
        C.fixed_round_col(F.sum("Expected_Loss"), 2).alias("total_expected_loss"),
        *tiers)


def write_results(scored: DataFrame, summary: DataFrame, out_dir: str) -> None:
    """S8 CSV with header, S9 JSON records (missing numbers -> 0) and the summary as JSON.

    The records name every column in every row, so they are written gzipped; Spark and other readers open them as they are.
    """
    scored.write.mode("overwrite").option("header", True).csv(f"{out_dir}/results_csv")
    numeric = [f.name for f in scored.schema.fields if isinstance(f.dataType, T.NumericType)]
    scored.na.fill(0, subset=numeric).write.mode("overwrite").option("compression", "gzip").json(f"{out_dir}/results_json")
    summary.write.mode("overwrite").json(f"{out_dir}/summary_json")


def export_scenarios(scored_by_scenario: DataFrame, out_dir: str) -> None:
    """S10 re-aimed: loan level, portfolio summary and risk distribution, one table each, by scenario."""
    scored_by_scenario.write.mode("overwrite").partitionBy("scenario").parquet(f"{out_dir}/loan_level")
    # scored once: the other two tables come from the one written
    scored_by_scenario = scored_by_scenario.sparkSession.read.schema(scored_by_scenario.schema).parquet(f"{out_dir}/loan_level")
    summary = scored_by_scenario.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_loans"), F.avg("Baseline_PD").alias("avg_baseline_pd"),
        F.avg("CPD").alias("avg_cpd"), F.avg("PD_Uplift_Pct").alias("avg_pd_uplift_pct"),
        F.sum("Expected_Loss").alias("total_expected_loss"),
        F.count_if(C.is_high_or_critical("Risk_Category")).alias("high_critical"))
    summary.write.mode("overwrite").partitionBy("scenario").parquet(f"{out_dir}/summary")
    dist = scored_by_scenario.where(F.col("Risk_Category").isNotNull()) \
        .groupBy("scenario", "Risk_Category").agg(F.count(F.lit(1)).alias("n_loans"))
    dist.write.mode("overwrite").partitionBy("scenario").parquet(f"{out_dir}/risk_distribution")
