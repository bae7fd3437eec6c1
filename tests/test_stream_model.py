"""Streaming jobs equal their batch form; model jobs run and keep their contracts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tempest import config
from tempest.operators import drift
from tempest.operators import model as M
from tempest.plans import base
from tempest.sources import requests as RQ
from tempest.streaming import jobs

from conftest import SF_SMALL


def test_stream_score_equals_batch(spark):
    out = tempfile.mkdtemp(prefix="t-stream-")
    jobs.stream_score(spark, RQ.request_stream(spark, SF_SMALL), out)
    streamed = spark.read.parquet(f"{out}/scored")
    acc, rej = jobs.split_valid(RQ.request_batch(spark, SF_SMALL))
    batch = jobs.score_requests(acc)
    cols = ["request_id", "Baseline_PD", "CPD", "PD_Uplift_Pct", "Risk_Category", "Expected_Loss"]
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert spark.read.parquet(f"{out}/rejected").count() == rej.count() > 0


def test_each_request_under_its_own_scenario(spark):
    """All four scenarios, none, and unknown keys: every row as if it had been scored in a table of its scenario alone."""
    req = RQ.request_batch(spark, SF_SMALL)
    acc, rej = jobs.split_valid(req)
    cols = ["request_id", "Baseline_PD", "CPD", "PD_Uplift_Pct", "Risk_Category", "Expected_Loss", "scenario", "carbon_price"]
    got = {r.request_id: r for r in jobs.score_requests(acc).select(*cols).collect()}
    plain = acc.drop("scenario", "carbon_price")
    seen = set()
    for key, price in config.CARBON_PRICES.items():
        alone = {r.request_id: r for r in jobs.score_requests(plain, scenario=key).select(*cols).collect()}
        mine = {r.request_id for r in acc.where(F.col("scenario") == key).collect()}
        assert mine and all(got[i] == alone[i] and got[i].carbon_price == price for i in mine)
        seen |= mine
    assert seen == set(got) and any(r.scenario is None for r in req.collect())
    unknown = {r.request_id for r in rej.where(F.array_contains("reject_reasons", "scenario unknown")).collect()}
    assert unknown == {r.request_id for r in req.where("scenario NOT IN ('orderly', 'disorderly', 'hot_house', 'too_little_too_late')").collect()} != set()
    with pytest.raises(ValueError):
        jobs.split_valid(req, "net_zero")


def drift_reference(spark):
    return drift.feature_stats(drift.long_form(base.clean(spark, SF_SMALL), jobs.DRIFT_FEATURES))


def test_stream_drift_equals_batch(spark):
    stats = drift_reference(spark)
    out = tempfile.mkdtemp(prefix="t-drift-")
    jobs.stream_drift(spark, RQ.request_stream(spark, SF_SMALL), stats, out)
    streamed = jobs.read_drift(spark, out)
    ref = jobs.reference_bins(stats)
    batch = jobs.window_psi(jobs.window_bins(RQ.request_batch(spark, SF_SMALL), ref, watermark=None), ref)
    key = ["window_start", "feature", "n_total", "psi", "status"]
    assert sorted(streamed.select(*key).collect()) == sorted(batch.select(*key).collect())
    assert streamed.where("closed").count() > 0 and streamed.where("not closed").count() > 0


def test_window_psi_equals_psi_of_two_samples(spark):
    """The column expression over bin counts gives what the batch PSI of the same values gives."""
    stats = drift_reference(spark)
    ref = jobs.reference_bins(stats)
    req = RQ.request_batch(spark, SF_SMALL)
    got = {r.feature: r.psi for r in jobs.window_psi(jobs.window_bins(req, ref, window="36500 days", watermark=None), ref).collect()}
    actual = drift.long_form(jobs.with_request_defaults(req), jobs.DRIFT_FEATURES)
    want = {r.feature: r.psi for r in drift.psi(drift.reference_sample(stats), actual).collect()}
    assert len(got) == len(jobs.DRIFT_FEATURES) and all(got[f] == pytest.approx(want[f], abs=1e-5) for f in got)


def test_drift_emits_closed_windows_while_it_runs(spark):
    """A window's PSI is there once a later event has moved the watermark past its end; late rows are dropped and counted."""
    from datetime import datetime, timedelta

    ref = jobs.reference_bins(drift_reference(spark)).cache()
    base_rows = RQ.request_batch(spark, SF_SMALL).limit(50).cache()
    source, out = tempfile.mkdtemp(prefix="t-in-"), tempfile.mkdtemp(prefix="t-drift-")

    def arrive(day: int, name: str) -> None:
        rows = base_rows.withColumn("event_time", F.lit(datetime(2024, 1, 1) + timedelta(days=day, hours=5)))
        rows.coalesce(1).write.parquet(f"{source}/{name}")

    stream = spark.readStream.schema(base_rows.schema).parquet(f"{source}/*")
    arrive(0, "first")
    query = jobs.drift_query(spark, stream, ref, out)
    try:
        query.processAllAvailable()
        assert spark.read.schema("psi double").parquet(f"{out}/psi").count() == 0  # still open
        arrive(3, "second")
        query.processAllAvailable()
        closed = spark.read.parquet(f"{out}/psi")
        assert query.isActive and {r.window_start.day for r in closed.collect()} == {1} and closed.count() == len(jobs.DRIFT_FEATURES)
        assert closed.where("n_total <> 50").count() == 0 and jobs.late_rows(query) == 0
        arrive(0, "late")
        query.processAllAvailable()
        assert jobs.late_rows(query) == len(jobs.DRIFT_FEATURES)  # one task, one window: a row per feature
        assert spark.read.parquet(f"{out}/psi").count() == closed.count()
    finally:
        query.stop()
    left = jobs.open_windows(spark, ref, out)
    assert {r.window_start.day for r in left.collect()} == {4} and left.count() == len(jobs.DRIFT_FEATURES)


@pytest.fixture(scope="module")
def mf(spark):
    return M.model_frame(base.clean(spark, SF_SMALL)).cache()


def test_frame_shuffles_no_wide_row(spark):
    """with one row an id the frame is a scan of the written loans; rows of a repeated id take every split of it."""
    clean = base.clean(spark, SF_SMALL)
    frame = M.model_frame(clean)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    twice = M.model_frame(clean.union(clean.where("loan_id % 5 = 0")))
    once = clean.groupBy().agg(F.count("*"), F.count_if(F.col("loan_id") % 5 == 0)).first()
    assert frame.count() == once[0] and twice.count() == once[0] + 3 * once[1] and twice.columns == frame.columns


def test_model_cpd_reads_the_written_loans(spark, monkeypatch):
    """the loans are cleaned once for the fit and the portfolio scored with it."""
    from tempest.plans import q_model

    calls = []
    monkeypatch.setattr(q_model.base, "clean", lambda *a, of=base.clean: calls.append(1) or of(*a))
    monkeypatch.setattr(q_model, "_CLEAN", {})
    monkeypatch.setattr(q_model, "_FRAMES", {})
    monkeypatch.setattr(q_model, "_FITTED", {})
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    r = q_model.model_cpd(spark, SF_SMALL).agg(F.count("*").alias("n"), F.count_if(F.col("overlay_ok") & F.col("pd_ok")).alias("ok")).first()
    assert len(calls) == 1 and r.n == r.ok > 0 and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit


def test_model_fit_score_calibrate(spark, mf):
    model = M.fit(mf, "gbt", max_iter=5)
    iso = M.calibrate(model, mf)
    s = M.calibrated_scores(model, iso, mf.where(F.col("split") == "test"))
    r = s.agg(F.min("p_raw"), F.max("p_raw"), F.min("p_cal"), F.max("p_cal"), F.count("*")).first()
    assert 0 <= r[0] <= r[1] <= 1 and 0 <= r[2] <= r[3] <= 1 and r[4] > 0


def test_stream_scores_with_a_fitted_model(spark, mf):
    """The fitted pipeline as baseline gives the stream the PD that it gives the batch."""
    model = M.fit(mf, "lr", maxIter=20)
    out = tempfile.mkdtemp(prefix="t-stream-")
    baseline = lambda df: M.score(model, df, "Baseline_PD")
    jobs.stream_score(spark, RQ.request_stream(spark, SF_SMALL), out, baseline=baseline)
    cols = ["request_id", "Baseline_PD", "CPD", "Risk_Category", "Expected_Loss"]
    batch = jobs.score_requests(jobs.split_valid(RQ.request_batch(spark, SF_SMALL))[0], baseline=baseline)
    got = sorted(spark.read.parquet(f"{out}/scored").select(*cols).collect())
    assert got == sorted(batch.select(*cols).collect()) and len({r.Baseline_PD for r in got}) > 10


def test_model_columns_with_and_without_climate(spark, mf):
    from tempest import config

    assert M.feature_set(mf) == config.ALL_FEATURES
    both = mf.withColumns({c: F.lit(0.5) for c in config.CLIMATE_FEATURES})
    assert M.feature_set(both) == config.ALL_FEATURES + config.CLIMATE_FEATURES and M.feature_set(both, False) == config.ALL_FEATURES


def test_scoring_fills_missing_columns(spark, mf):
    model = M.fit(mf, "lr", maxIter=20)
    few = mf.select("id", "label", "split", "dti", "annual_inc", "fico_range_low", "int_rate", "installment")
    assert M.score(model, few).where(F.col("p").isNull()).count() == 0


def test_permutation_importance_shape(spark, mf):
    model = M.fit(mf, "gbt", max_iter=3)
    imp = M.permutation_importance(model, mf.where(F.col("split") == "test"), features=["dti", "int_rate"], repeats=2)
    assert sorted(r.feature for r in imp.collect()) == ["dti", "int_rate"]


def test_linear_attribution_sums_to_logit(spark, mf):
    model = M.fit(mf, "lr", maxIter=50)
    test = mf.where(F.col("split") == "test").limit(20)
    attr = M.linear_attribution(model, test, top=len(M.FEATURES))
    total = attr.groupBy("id").agg(F.sum("contribution").alias("s"))
    logit = M.score(model, test).select("id", F.log(F.col("p") / (1 - F.col("p"))).alias("z"))
    icpt = model.stages[3].intercept
    for row in total.join(logit, "id").collect():
        assert row.s + icpt == pytest.approx(row.z, abs=1e-6)


@pytest.mark.parametrize("n_background", [1, 20, 500])
def test_sampled_shapley_efficiency(spark, mf, n_background):
    """One order and one background row per (row, sample), shared by all features: a row's values sum to f(x)
    minus the mean score of the background rows drawn for it, for a background of any size."""
    model = M.fit(mf, "gbt", max_iter=5)
    test = mf.where(F.col("split") == "test").orderBy("id").limit(3)
    bg = mf.where(F.col("split") == "train").orderBy("id").limit(n_background)
    attr = M.sampled_shapley(model, test, bg, samples=4)
    tot = {r.id: r.s for r in attr.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    logit = F.log(F.col("p") / (1 - F.col("p")))
    fx = {r.id: r.z for r in M.score(model, test).select("id", logit.alias("z")).collect()}
    order = {i: k for k, i in enumerate(r.id for r in bg.select("id", M.E.split_hash("id", M.config.RANDOM_STATE + 3).alias("h")).orderBy("h", "id").collect())}
    fz = {order[r.id]: r.z for r in M.score(model, bg).select("id", logit.alias("z")).collect()}
    n = len(fz)
    draws = test.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")).select(
        "id", F.pmod(F.xxhash64(F.concat_ws("|", F.col("id").cast("string"), F.col("m").cast("string")), F.lit("bg"), F.lit(M.config.RANDOM_STATE)),
                     F.lit(n).cast("long")).alias("z")).collect()
    assert len(tot) == 3
    for i, s in tot.items():
        assert s == pytest.approx(fx[i] - sum(fz[r.z] for r in draws if r.id == i) / 4, abs=1e-9)


def test_boosted_trees_run_all_iterations(spark, mf):
    model = M.fit(mf, "gbt", max_iter=25, max_depth=3, step=0.1)
    assert model.stages[-1].getNumTrees == 25
    assert M.gbt().getMaxIter() == 300 and not M.gbt().isSet("validationIndicatorCol")
    assert M.test_metrics(model, mf, "gbt").first().auc > 0.6  # the label has a signal
