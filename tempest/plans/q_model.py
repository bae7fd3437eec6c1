"""Step 9 of the build plan: model fitting and model-based jobs.

Outputs are fitted or seeded-random, so these queries register no oracle SQL
(rows-only check).  The deterministic parts (AUC, thresholds, reports) are
the SQL-checked evaluation queries of step 8.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest import config
from tempest.operators import adapters as A
from tempest.operators import batch as B
from tempest.operators import boosting
from tempest.operators import evaluate as E
from tempest.operators import model as M
from tempest.plans import base
from tempest.plans.catalog import register
from tempest.plans.sqlbase import cpd_sql, tier_sql, with_base
from tempest.session import SMALL_GROUPS, checkpoint_dir, cut_lineage, files_state, materialise, run_folder, short_methods
from tempest.sources import adapters as src
from tempest.sources import dims

#: The tables that the loans are made from.
LOAN_TABLES = ("orders", "customer", "lineitem")

_CLEAN: dict[tuple, DataFrame] = {}
_FRAMES: dict[tuple, DataFrame] = {}
_FITTED: dict[tuple, object] = {}


def _key(spark, sf_dir, *what):
    """Names what is kept: by session, folder and state of the input files, so a changed table is read again."""
    return spark.sparkContext.applicationId, sf_dir, files_state(spark, sf_dir, LOAN_TABLES), *what


def clean_table(spark, sf_dir):
    """The cleaned loans, written once a session: the frame and the portfolio scored with a fitted model read them."""
    key = _key(spark, sf_dir)
    if key not in _CLEAN:
        with short_methods(spark):
            _CLEAN[key] = materialise(base.clean(spark, sf_dir), run_folder(spark, "clean"), "loans", **SMALL_GROUPS)
    return _CLEAN[key]


def model_frame(spark, sf_dir):
    """Cleaned loans as (id, label, 38 features, split), made once a session: every job reads it."""
    key = _key(spark, sf_dir)
    if key not in _FRAMES:
        _FRAMES[key] = M.model_frame(clean_table(spark, sf_dir), written=True)
    return _FRAMES[key]


def fitted(spark, sf_dir, kind, **params):
    """(model, seconds) of one kind of model on the frame: fitted once a session, used by all its jobs."""
    key = _key(spark, sf_dir, kind, *sorted(params.items()))
    if key not in _FITTED:
        _FITTED[key] = M.timed_fit(model_frame(spark, sf_dir), kind, **params)
    return _FITTED[key]


def blocks(spark, sf_dir, folds):
    """The frame's rows binned and packed for boosting, once a session."""
    key = _key(spark, sf_dir, "blocks", folds)
    if key not in _FITTED:
        _FITTED[key] = boosting.binned_blocks(model_frame(spark, sf_dir), M.FEATURES, folds, run_folder(spark, "boosting"))
    return _FITTED[key]


def trial_ledger(spark, sf_dir):
    """The ledger of trials on these loans.  It lies in the shared checkpoint folder and outlives the session."""
    return boosting.ledger(spark, f"{checkpoint_dir(spark).rstrip('/')}/tempest-trials/{files_state(spark, sf_dir, LOAN_TABLES)}")


@register("fit_gbt", None, "M3 M2 M1 M11 M12")
def fit_gbt(spark, sf_dir):
    """Boosted trees on the training split; test AUC, Brier and fit time."""
    mf = model_frame(spark, sf_dir)
    model, sec = fitted(spark, sf_dir, "gbt")
    return M.test_metrics(model, mf, "gbt", seconds=sec).withColumn(
        "n_trees", F.lit(model.stages[-1].getNumTrees))


@register("fit_lr", None, "M4 M2")
def fit_lr(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    model, sec = fitted(spark, sf_dir, "lr")
    return M.test_metrics(model, mf, "logistic_regression", seconds=sec)


@register("fit_rf", None, "M5 M2")
def fit_rf(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    model, sec = fitted(spark, sf_dir, "rf")
    return M.test_metrics(model, mf, "random_forest", seconds=sec)


@register("cv_auc", None, "M7")
def cv_auc(spark, sf_dir):
    """5-fold stratified CV AUC (mean, std) of boosted trees on the training rows, kept in the ledger."""
    return _cv_gbt(spark, sf_dir, "gbt", {}).select("model", "folds", "cv_auc_mean", "cv_auc_std")


def _cv_gbt(spark, sf_dir, name, p):
    return boosting.cross_validate(blocks(spark, sf_dir, config.CV_FOLDS), p, config.GBT_PARAMS["maxIter"], config.CV_FOLDS, len(M.FEATURES),
                                   trial_ledger(spark, sf_dir), name)


@register("calibrated_scores", None, "M9 M10")
def calibrated_scores(spark, sf_dir):
    """Raw and isotonic-calibrated default probability of every test loan."""
    mf = model_frame(spark, sf_dir)
    model, _ = fitted(spark, sf_dir, "gbt")
    iso = M.calibrate(model, mf)
    return M.calibrated_scores(model, iso, mf.where(F.col("split") == "test")).select("id", "label", "p_raw", "p_cal")


@register("reliability_raw_vs_calibrated", None, "M19 M9")
def reliability_raw_vs_calibrated(spark, sf_dir):
    """Reliability curves (15 quantile bins) of the raw and the calibrated test scores."""
    mf = model_frame(spark, sf_dir)
    model, _ = fitted(spark, sf_dir, "gbt")
    scored = M.calibrated_scores(model, M.calibrate(model, mf), mf.where(F.col("split") == "test"))
    raw = E.reliability(scored.select("label", F.col("p_raw").alias("score"))).withColumn("curve", F.lit("raw"))
    cal = E.reliability(scored.select("label", F.col("p_cal").alias("score"))).withColumn("curve", F.lit("calibrated"))
    return raw.unionByName(cal)


@register("gain_importance", None, "M23")
def gain_importance(spark, sf_dir):
    return M.gain_importance(fitted(spark, sf_dir, "gbt")[0])


@register("permutation_importance", None, "M22")
def permutation_importance(spark, sf_dir):
    """AUC drop per shuffled feature, 10 seeded repeats, all in one plan."""
    mf = model_frame(spark, sf_dir)
    model, _ = fitted(spark, sf_dir, "gbt")
    return M.permutation_importance(model, mf.where(F.col("split") == "test"))


@register("linear_attribution", None, "M24")
def linear_attribution(spark, sf_dir):
    """Top-12 log-odds contributions per test loan under the logistic model."""
    mf = model_frame(spark, sf_dir)
    return M.linear_attribution(fitted(spark, sf_dir, "lr")[0], mf.where(F.col("split") == "test"))


@register("attribution_global", None, "M24")
def attribution_global(spark, sf_dir):
    """Mean absolute log-odds contribution per feature over all test loans."""
    mf = model_frame(spark, sf_dir)
    return M.mean_abs_attribution(M.linear_attribution(fitted(spark, sf_dir, "lr")[0], mf.where(F.col("split") == "test"),
                                                       top=len(M.FEATURES)))


SHALLOW = {"max_depth": 4, "step": 0.1}


def _compare(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    book, rows = trial_ledger(spark, sf_dir), []
    for name, kind, params in (("gbt", "gbt", {}), ("gbt_shallow", "gbt", SHALLOW),
                               ("logistic_regression", "lr", {}), ("random_forest", "rf", {})):
        model, sec = fitted(spark, sf_dir, kind, **params)
        iso = M.calibrate(model, mf)
        rows.append(M.test_metrics(model, mf, name, iso=iso, seconds=sec))
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    # CV results are those that earlier runs left in the ledger; what it lacks is run now
    cv = [_cv_gbt(spark, sf_dir, "gbt", {}),
          _cv_gbt(spark, sf_dir, "gbt_shallow", {"max_depth": SHALLOW["max_depth"], "learning_rate": SHALLOW["step"]}),
          boosting.summary(M.cv_folds(mf, "lr", "logistic_regression", book, parallelism=config.CV_FOLDS), config.CV_FOLDS),
          boosting.summary(M.cv_folds(mf, "rf", "random_forest", book, parallelism=config.CV_FOLDS), config.CV_FOLDS)]
    cv = reduce(DataFrame.unionByName, cv).select("model", "cv_auc_mean", "cv_auc_std")
    out = materialise(table.join(cv, "model", "left").na.fill(0.0, ["cv_auc_mean", "cv_auc_std"]), run_folder(spark, "compare"), "table")
    return out.select("*", E.average_rank_desc(out, "auc").alias("auc_rank"))


@register("model_compare", None, "M27 M6 J17 W1")
def model_compare(spark, sf_dir):
    """Comparison table: raw / calibrated AUC, Brier, CV mean and std, fit seconds, rank."""
    return _compare(spark, sf_dir)


@register("cross_dataset", None, "M25 M26 M18 S4")
def cross_dataset(spark, sf_dir):
    """Loan-trained boosted trees scoring the adapted home-credit portfolio: AUC, rate and reports.

    Reports at 0.5 and at the threshold matched to the default rate.
    """
    model, _ = fitted(spark, sf_dir, "gbt")
    other = A.adapt_home_credit(src.fixture_home_credit(spark, sf_dir)).withColumnRenamed("loan_id", "id") \
        .withColumnRenamed("default", "label")
    scored = cut_lineage(M.score(model, other, "score").select("id", "label", "score"))
    auc = E.auc(scored).select("auc").scalar()
    rate = E.rate_threshold(scored).first()
    parts = []
    for kind, t in (("0.50", 0.5), ("rate_matched", rate.threshold)):
        parts.append(E.class_report(E.confusion(scored, t)).select(
            F.lit(kind).alias("threshold_kind"), F.lit(float(t)).alias("threshold"), "*"))
    return parts[0].unionByName(parts[1]).select("*", auc.alias("auc"), F.lit(rate.default_rate).alias("default_rate"))


@register("model_roundtrip", None, "S12 M10")
def model_roundtrip(spark, sf_dir):
    """Save the fitted pipeline to the shared folder, load it back and score the test loans with both."""
    mf = model_frame(spark, sf_dir)
    model, _ = fitted(spark, sf_dir, "lr")
    path = run_folder(spark, "models") + "/lr"
    M.save(model, path)
    test = mf.where(F.col("split") == "test")
    a = M.score(model, test, "p_fitted").select("id", "p_fitted")
    b = M.score(M.load(path), test, "p_loaded").select("id", "p_loaded")
    return a.join(b, "id").withColumn("equal", F.col("p_fitted") == F.col("p_loaded"))


@register("model_cpd", lambda: with_base("SELECT loan_id, true AS overlay_ok, true AS pd_ok FROM clean"), "R8 R9 R10 R11 M10")
def model_cpd(spark, sf_dir):
    """Fitted logistic pipeline through both overlays: the written result against the overlay's formula in SQL."""
    model, _ = fitted(spark, sf_dir, "lr")

    def baseline(df):
        return M.score(model, df, "Baseline_PD")

    run = run_folder(spark, "model-cpd")
    with short_methods(spark):
        scored = materialise(B.score_upload(clean_table(spark, sf_dir), "orderly", baseline=baseline), run, "scored", **SMALL_GROUPS)
    scored.createOrReplaceTempView("model_cpd_scored")
    dims.state_dim(spark).createOrReplaceTempView("model_cpd_states")
    dims.sector_dim(spark).createOrReplaceTempView("model_cpd_sectors")
    strip = "regexp_replace(m.addr_state, '^\\\\s+|\\\\s+$', '')"
    return spark.sql(f"""
WITH l AS (SELECT m.*, coalesce(s.physical_risk, 0.45D) AS hazard, coalesce(k.emission_intensity, 0.25D) AS emission_intensity
           FROM model_cpd_scored m LEFT JOIN model_cpd_states s ON {strip} = s.state_key
           LEFT JOIN model_cpd_sectors k ON replace(lower(m.purpose), ' ', '_') = k.sector_key),
c AS (SELECT *, CAST({cpd_sql()} AS DOUBLE) AS want FROM l)
SELECT loan_id, abs(CPD - want) < 1e-9 AND abs(Expected_Loss - want * 0.45D * loan_amnt) < 1e-3
         AND Risk_Category <=> {tier_sql('CPD')} AS overlay_ok, Baseline_PD BETWEEN 0 AND 1 AS pd_ok FROM c""")


@register("threshold_artifacts", None, "S13 M15 M16")
def threshold_artifacts(spark, sf_dir):
    """Cost- and F1-optimal thresholds of the calibrated model as a (metric, value) table, written and re-read."""
    mf = model_frame(spark, sf_dir)
    model, _ = fitted(spark, sf_dir, "gbt")
    scored = M.calibrated_scores(model, M.calibrate(model, mf), mf.where(F.col("split") == "test"))
    pr = E.pr_points(scored.select("label", F.col("p_cal").alias("score")))
    cost = E.cost_threshold(pr).select(F.lit("cost_optimal").alias("metric"), F.col("threshold").alias("value"))
    f1 = E.f1_threshold(pr).select(F.lit("f1_optimal").alias("metric"), F.col("threshold").alias("value"))
    consts = spark.createDataFrame([("fn_cost", config.FN_COST), ("fp_cost", config.FP_COST)], "metric string, value double")
    table = cost.unionByName(f1).unionByName(consts).withColumn("model", F.lit("gbt_calibrated"))
    path = run_folder(spark, "artifacts") + "/thresholds"
    table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("tune_gbt", None, "M8 M7")
def tune_gbt(spark, sf_dir):
    """Seeded random search over all eight parameters: CV AUC (3 folds) of each of the 75 candidates; the best one has its test AUC."""
    folds = config.TUNING_FOLDS
    found = boosting.search(blocks(spark, sf_dir, folds), boosting.draw_candidates(), folds, len(M.FEATURES), trial_ledger(spark, sf_dir))
    return found.select("setting", "n_trees", "folds", "cv_auc_mean", "cv_auc_std", "test_auc")


def _tree_attribution(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    model, _ = fitted(spark, sf_dir, "gbt")
    return M.tree_attribution(model, mf.where(F.col("split") == "test"), mf.where(F.col("split") == "train"))


@register("tree_attribution", None, "M24")
def tree_attribution(spark, sf_dir):
    """Top-12 exact Shapley contributions (log-odds) per test loan under the boosted trees, against all training loans."""
    return M.top_attributions(_tree_attribution(spark, sf_dir))


@register("tree_attribution_global", None, "M24")
def tree_attribution_global(spark, sf_dir):
    """Mean absolute exact Shapley contribution per feature over all test loans."""
    return M.mean_abs_attribution(_tree_attribution(spark, sf_dir).select(F.inline("c")))
