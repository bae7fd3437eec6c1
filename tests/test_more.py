"""Adapters, drift, climate features and the driver contract."""

import random

import pytest
from pyspark.sql import functions as F

from tempest import config
from tempest.operators import adapters as A
from tempest.operators import climate as CL
from tempest.operators import drift as D
from tempest.sources import climate as SC

from conftest import SF_SMALL


# ---------------------------------------------------------------- adapters
def _hc(spark, rows):
    cols = ("SK_ID_CURR bigint, TARGET int, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, "
            "AMT_GOODS_PRICE double, DAYS_EMPLOYED int, EXT_SOURCE_1 double, EXT_SOURCE_2 double, "
            "EXT_SOURCE_3 double, ORGANIZATION_TYPE string, REGION_RATING_CLIENT int")
    return spark.createDataFrame(rows, cols)


def test_home_credit_edges(spark):
    rows = [
        (1, 1, 100000.0, 20000.0, 1000.0, 18000.0, 365243, 0.5, None, None, "Construction", 3),
        (2, 0, 50000.0, 10000.0, None, None, 0, None, None, None, "Nowhere", 7),
        (3, 0, 80000.0, 10000.0, 500.0, 10000.0, -20000, 0.2, 0.4, 0.6, None, 1),
        (4, 0, 80000.0, 10000.0, 500.0, 10000.0, None, 0.2, None, 0.6, "Electricity", 2),
        (5, 0, None, 10000.0, 500.0, 10000.0, -100, 0.2, None, 0.6, "Electricity", 2),
    ]
    out = {r.loan_id: r for r in A.adapt_home_credit(_hc(spark, rows)).collect()}
    assert set(out) == {1, 2, 3, 4}  # missing income dropped
    assert out[1].emp_length == 0.0 and out[2].emp_length == 0.0
    assert out[3].emp_length == pytest.approx(40.0) and out[4].emp_length is None
    assert out[1].fico_range_low == pytest.approx(575.0) and out[2].fico_range_low == 580.0
    assert out[3].fico_range_low == pytest.approx(0.4 * 550 + 300)
    assert out[2].installment == 0.0 and out[2].int_rate == 12.0
    assert out[1].int_rate == pytest.approx(min(max(20000 / 18001 - 1, 0), 0.5) * 100)
    assert out[1].dti == pytest.approx(1000 * 12 / 100001 * 100)
    assert (out[1].purpose, out[2].purpose, out[3].purpose, out[4].purpose) == (
        "construction", "other", "other", "thermal_power")
    assert (out[1].addr_state, out[2].addr_state, out[3].addr_state) == ("FL", "NY", "NY")
    assert out[1].loan_status == "Charged Off" and out[1].default == 1


def test_indian_bank_edges(spark):
    cols = ("ID bigint, Disbursed int, Monthly_Income double, Loan_Amount_Applied double, Loan_Tenure_Applied double, "
            "Existing_EMI double, age int, Var4 int, Var5 int, Source_0 int, Source_1 int, Source_2 int")
    rows = [
        (1, 0, 1000.0, 5000.0, 2.0, 0.0, 30, 1, 10, 1, 1, 1),
        (2, 1, 2000.0, 5000.0, 2.0, 100.0, None, 7, None, 0, 1, 0),
        (3, 1, 4000.0, None, 2.0, 100.0, 70, 3, 59, 1, 0, 0),
        (4, 1, 300.0, 5000.0, 1.0, None, 10, 6, 0, 0, 0, 0),
    ]
    out = {r.loan_id: r for r in A.adapt_indian_bank(spark.createDataFrame(rows, cols)).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1].default == 1 and out[1].installment == pytest.approx(5000 / 25)
    assert out[2].installment == 100.0 and out[2].emp_length == 5.0 and out[2].fico_range_low == 650.0
    assert out[1].fico_range_low == 750.0 and out[2].int_rate == 12.0 and out[4].int_rate == 12.0
    assert (out[1].purpose, out[2].purpose, out[4].purpose) == ("debt_consolidation", "home_improvement",
                                                                "small_business")
    # median of 12x income over all four rows (before the drop) = 18000
    assert (out[1].addr_state, out[2].addr_state, out[4].addr_state) == ("Uttar Pradesh", "Tamil Nadu", "Bihar")
    assert out[4].dti is None and out[4].emp_length == 0.0


# ---------------------------------------------------------------- drift
def _long(spark, values, feature="x"):
    return spark.createDataFrame([(feature, float(v)) for v in values], "feature string, value double")


def test_psi_properties(spark):
    rnd = random.Random(1)
    a = [rnd.gauss(0, 1) for _ in range(3000)]
    b = [rnd.gauss(0, 1) for _ in range(3000)]
    far = [rnd.gauss(5, 1) for _ in range(3000)]
    near = D.psi(_long(spark, a), _long(spark, b)).first().psi
    assert 0 <= near < 0.01
    assert D.psi(_long(spark, a), _long(spark, far)).first().psi > 0.25
    assert D.psi(_long(spark, [1.0] * 50), _long(spark, [1.0] * 50)).first().psi == 0.0


def test_drift_status_labels(spark):
    df = spark.createDataFrame([(0.05,), (0.10,), (0.25,)], "p double")
    assert [r.s for r in df.select(D.drift_status(F.col("p")).alias("s")).collect()] == ["OK", "MODERATE", "DRIFT"]


def test_feature_drift_against_stats(spark):
    rnd = random.Random(3)
    train = spark.createDataFrame([(rnd.gauss(15, 5), rnd.gauss(700, 40)) for _ in range(2000)], "dti double, fico_range_low double")
    stats = D.feature_stats(D.long_form(train, ["dti", "fico_range_low"]))
    new = train.withColumn("dti", F.col("dti") + 20)
    got = {r.feature: r for r in D.feature_drift(new, stats, ["dti", "fico_range_low"]).collect()}
    # the reference sample is 7 summary values with fixed repeats, so even an
    # unshifted feature has some PSI against it; the shifted one must drift
    assert got["dti"].status == "DRIFT" and got["fico_range_low"].status != "DRIFT"
    assert got["dti"].psi > 10 * got["fico_range_low"].psi


# ---------------------------------------------------------------- climate
def _series(spark, months, loc="10.0_20.0", sentinel_every=0):
    rows = []
    for m in range(months):
        ym = f"{2010 + m // 12}{m % 12 + 1:02d}"
        t = 8.0 + 2.5 * min(m % 12, 12 - m % 12) + 0.01 * m  # a triangle over the year on a slow rise
        p = 40.0 + 7.0 * ((m * 5) % 11) - (30.0 if m % 23 == 4 else 0.0)  # rain in no order, now and then a dry month
        if sentinel_every and m % sentinel_every == 0:
            t = -999.0
        rows += [(loc, SC.T2M, ym, t), (loc, SC.PRECIP, ym, p)]
    return spark.createDataFrame(rows, "loc_key string, variable string, month string, value double")


def test_climate_features_ranges_and_fallback(spark):
    obs = _series(spark, 168).unionByName(_series(spark, 11, loc="short"))
    got = {r.loc_key: r for r in CL.climate_features(obs).collect()}
    full = got["10.0_20.0"]
    assert 0 <= full.flood_freq_score <= 1 and 0 <= full.drought_severity_index <= 1
    assert 0 <= full.physical_risk_score <= 1
    short = got["short"]
    for k, v in config.CLIMATE_FALLBACK.items():
        assert getattr(short, k) == v


def test_climate_sentinel_removed(spark):
    clean = CL.valid_observations(_series(spark, 24, sentinel_every=2))
    assert clean.where(F.col("value") == -999.0).count() == 0
    assert clean.where(F.col("variable") == SC.T2M).count() == 12


def test_loc_key_rounding(spark):
    df = spark.createDataFrame([(27.994, -81.76)], "lat double, lon double")
    assert df.select(CL.loc_key("lat", "lon").alias("k")).first().k == "28.0_-81.8"


# ---------------------------------------------------------------- contract
def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "avg_cpd" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["cpd_by_state", "scenario_compare", "auc", "adapt_indian_bank", "feature_drift"])
def test_queries_run_on_smallest_scale(spark, name):
    import __spark_entry__ as E
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_climate_json_source_maps_to_long_form(spark, tmp_path):
    """Two month -> value maps per location, read with a MapType schema and exploded; -999 dropped later."""
    import json
    path = tmp_path / "climate.json"
    rec = {"lat": 27.64, "lon": -81.52, SC.T2M: {"201001": 15.0, "201002": -999.0, "201013": 9.0},
           SC.PRECIP: {"201001": 2.5, "201002": 3.0}}
    path.write_text(json.dumps(rec) + "\n")
    obs = SC.read_climate_json(spark, str(path))
    rows = {(r.variable, r.month): r.value for r in obs.collect()}
    assert rows[(SC.T2M, "201001")] == 15.0 and rows[(SC.PRECIP, "201002")] == 3.0
    assert {r.loc_key for r in obs.collect()} == {"27.6_-81.5"}
    valid = CL.valid_observations(obs)
    # the sentinel and the annual pseudo-month 13 are not valid observations
    assert valid.count() == 3


def test_json_results_are_gzipped_and_whole(spark, tmp_path):
    """The records name every column in every row: written compressed, read back as they were, missing numbers as 0."""
    from tempest.operators import batch

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i / 8, "High") for i in range(500)], "loan_id long, CPD double, Risk_Category string")
    batch.write_results(rows, rows.limit(1), str(tmp_path))
    parts = list((tmp_path / "results_json").glob("part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    back = {r["loan_id"]: (r["CPD"], r["Risk_Category"]) for r in spark.read.json(str(tmp_path / "results_json")).collect()}
    assert back == {i: (0.0 if i % 7 == 0 else i / 8, "High") for i in range(500)}
