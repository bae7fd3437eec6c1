"""Sources and sinks end to end.

Each query writes data Spark derived from the given tables into a run
folder under the session's checkpoint folder, reads it back through the
library's readers and returns what the job produced.  Where the round trip
must reproduce an existing query exactly, that query's SQL is the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.operators import batch as B
from tempest.operators import cleaning, drift, publish, scenarios
from tempest.operators import evaluate as E
from tempest.plans import base
from tempest.plans.catalog import finish, oracle_text, r, register
from tempest.plans.sqlbase import with_base
from tempest.session import materialise, run_folder
from tempest.sources.loans import fixture_loans, read_loan_csv, read_upload_csv


def _run_dir(spark, kind):
    return run_folder(spark, kind)


def _write_upload(spark, sf_dir, run):
    """The stand-in portfolio as the CSV a user would upload (text columns, header)."""
    path = f"{run}/upload_csv"
    fixture_loans(spark, sf_dir).drop("issue_d").write.mode("overwrite").option("header", True).csv(path)
    return path


@register("csv_scan_clean", lambda: oracle_text("clean_loans"), "S1 P1-P9 F1")
def csv_scan_clean(spark, sf_dir):
    """The 32 raw columns scanned from CSV as text, then cleaned: equal to the cleaned table."""
    run = _run_dir(spark, "csv")
    raw = read_loan_csv(spark, _write_upload(spark, sf_dir, run), keep=("loan_id",))
    df = cleaning.clean_loans(raw.withColumn("loan_id", F.col("loan_id").cast("long")))
    return finish(df.select("loan_id", "default", *config.ALL_FEATURES))


def _upload_summary_sql() -> str:
    tiers = ", ".join(f"CAST(count_if(Risk_Category = '{t}') AS BIGINT) AS n_{t.lower()}" for t in config.RISK_LABELS)
    return with_base(f"""
SELECT (SELECT count(*) FROM raw) AS n_input, count(*) AS n_scored, 'orderly' AS scenario,
  CAST(100.0 AS DOUBLE) AS carbon_price_usd,
  {r('avg(Baseline_PD)')} AS avg_baseline_pd, {r('avg(CPD)')} AS avg_cpd,
  {r('avg(PD_Uplift_Pct)', 2)} AS avg_pd_uplift_pct, {r('sum(Expected_Loss)', 2)} AS total_expected_loss, {tiers}
FROM portfolio""")


@register("batch_upload_summary", _upload_summary_sql, "S2 F2 P2 P3 F1 R8 A1 A3 S8 S9")
def batch_upload_summary(spark, sf_dir):
    """Upload CSV -> validate / coerce / drop -> score (orderly) -> CSV + JSON results; the summary read back."""
    run = _run_dir(spark, "upload")
    upload = read_upload_csv(spark, _write_upload(spark, sf_dir, run))
    n_input = upload.count()
    scored = materialise(B.score_upload(B.prepare_upload(upload), "orderly"), run, "scored")
    summary = B.upload_summary(scored, n_input, "orderly")
    B.write_results(scored, summary, run)
    back = spark.read.json(f"{run}/summary_json")
    cols = ["n_input", "n_scored", "scenario", "carbon_price_usd", "avg_baseline_pd", "avg_cpd",
            "avg_pd_uplift_pct", "total_expected_loss"] + [f"n_{t.lower()}" for t in config.RISK_LABELS]
    return back.select(*cols)


@register("batch_upload_rows", lambda: with_base(f"""
SELECT loan_id, {r('CPD')} AS cpd_csv, {r('CPD')} AS cpd_json, true AS same FROM portfolio"""), "S8 S9 P35")
def batch_upload_rows(spark, sf_dir):
    """Scored upload rows read back from the CSV sink and compared with the JSON sink (NaN -> 0)."""
    run = _run_dir(spark, "upload")
    upload = read_upload_csv(spark, _write_upload(spark, sf_dir, run))
    scored = materialise(B.score_upload(B.prepare_upload(upload), "orderly"), run, "scored")
    B.write_results(scored, B.upload_summary(scored, 0, "orderly"), run)
    csv = spark.read.option("header", True).csv(f"{run}/results_csv").select(
        F.col("loan_id").cast("long").alias("loan_id"), F.col("CPD").cast("double").alias("cpd_csv"))
    js = spark.read.json(f"{run}/results_json").select("loan_id", F.col("CPD").alias("cpd_json"))
    return finish(csv.join(js, "loan_id").withColumn("same", F.col("cpd_csv") == F.col("cpd_json")))


def _export_sql() -> str:
    from tempest.plans.q_scenarios import _grid_sql
    return with_base(f"""WITH {_grid_sql(False)}
SELECT scenario, Risk_Category, count(*) AS n_loans FROM grid2 WHERE Risk_Category IS NOT NULL GROUP BY scenario, Risk_Category""")


@register("export_run", _export_sql, "S10 J12")
def export_run(spark, sf_dir):
    """Per-scenario loan level, summary and risk distribution written by scenario; the distribution read back."""
    run = _run_dir(spark, "export")
    inputs = scenarios.overlay_inputs(base.with_pd(spark, sf_dir))
    per = scenarios.scenario_cpd(inputs).withColumn(
        "Expected_Loss", F.col("CPD") * config.DEFAULT_LGD * F.col("EAD"))
    B.export_scenarios(per.drop("scenario_order"), run)
    return spark.read.parquet(f"{run}/risk_distribution").select("scenario", "Risk_Category", "n_loans")


@register("training_stats_roundtrip", lambda: oracle_text("feature_stats"), "S11 A12")
def training_stats_roundtrip(spark, sf_dir):
    """Feature statistics written as a parquet table and read back (the drift job's input)."""
    from tempest.plans.q_drift import _train
    run = _run_dir(spark, "stats")
    stats = drift.feature_stats(drift.long_form(_train(spark, sf_dir), config.ALL_FEATURES))
    stats.write.mode("overwrite").parquet(f"{run}/training_stats")
    return finish(spark.read.parquet(f"{run}/training_stats"))



@register("published_thresholds", lambda: f"""SELECT 'cost_optimal' AS metric, threshold AS value FROM ({oracle_text('cost_threshold')})
UNION ALL SELECT 'f1_optimal', threshold FROM ({oracle_text('f1_threshold')})
UNION ALL SELECT * FROM (VALUES ('fn_cost', CAST({config.FN_COST} AS DOUBLE)), ('fp_cost', CAST({config.FP_COST} AS DOUBLE))) AS t(metric, value)""",
          "S12 S13 M15 M16")
def published_thresholds(spark, sf_dir):
    """A model version published with its threshold table and statistics, then loaded and checked; the thresholds."""
    from tempest.plans.q_model import fitted

    lab = materialise(base.scored_labels(spark, sf_dir).select("id", "label", F.col("p_a").alias("score")), _run_dir(spark, "labels"), "p_a")
    pr = E.pr_points(lab)
    table = E.cost_threshold(pr).select(F.lit("cost_optimal").alias("metric"), F.col("threshold").alias("value")).unionByName(
        E.f1_threshold(pr).select(F.lit("f1_optimal").alias("metric"), F.col("threshold").alias("value")))
    consts = spark.createDataFrame([("fn_cost", float(config.FN_COST)), ("fp_cost", float(config.FP_COST))], "metric string, value double")
    root = _run_dir(spark, "published")
    statistics = drift.feature_stats(drift.long_form(base.clean(spark, sf_dir), config.ALL_FEATURES))
    publish.publish(spark, root, fitted(spark, sf_dir, "lr")[0], table.unionByName(consts), statistics)
    return finish(publish.load(spark, root).thresholds)
