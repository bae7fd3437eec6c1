"""Physical and transition overlays, tiers and keys (metamorphic tests follow the method's own)."""

import pytest
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import overlay

STATIC = {k: r for k, r, *_ in config.state_rows()}
SECTOR = {k: i for k, i, _ in config.sector_rows()}


def _loans(spark, rows):
    return spark.createDataFrame(rows, "id int, Baseline_PD double, addr_state string, purpose string, annual_inc double")


def test_known_and_indian_state_scores(spark):
    df = spark.createDataFrame([(s,) for s in ["FL", "NY", "CA", "LA", "Odisha", "Kerala", "Rajasthan"]], "addr_state string")
    got = {r.addr_state: r.hazard for r in overlay.with_static_hazard(df).collect()}
    for s in ["FL", "NY", "CA", "LA"]:
        assert got[s] == STATIC[s]
    assert (got["Odisha"], got["Kerala"], got["Rajasthan"]) == (0.90, 0.70, 0.50)


def test_unknown_blank_padded_and_missing_states(spark):
    df = spark.createDataFrame([("ZZ",), ("UNKNOWN",), ("",), (None,), (" FL ",)], "addr_state string")
    got = [r.hazard for r in overlay.with_static_hazard(df).orderBy(F.col("addr_state").asc_nulls_first()).collect()]
    # NULL, '', ' FL ' (stripped -> FL), UNKNOWN, ZZ
    assert got == [STATIC["OTHER"], STATIC["OTHER"], STATIC["FL"], STATIC["OTHER"], STATIC["OTHER"]]


def test_all_us_states_have_scores():
    us = ("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH "
          "NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY").split()
    assert all(s in STATIC for s in us)
    assert all(0.0 <= v <= 1.0 for v in STATIC.values())


def test_physical_overlay_monotone_clipped_and_severity(spark):
    df = overlay.with_static_hazard(_loans(spark, [
        (1, 0.05, "FL", "car", 5e4), (2, 0.10, "NY", "car", 5e4), (3, 0.20, "OH", "car", 5e4),
        (4, 0.95, "LA", "car", 5e4), (5, 0.99, "FL", "car", 5e4), (6, None, "FL", "car", 5e4)]))
    out = df.select("id", "Baseline_PD",
                    overlay.physical_pd("Baseline_PD", "hazard").alias("d"),
                    overlay.physical_pd("Baseline_PD", "hazard", 0.5).alias("hi"),
                    overlay.physical_pd("Baseline_PD", "hazard", 0.0).alias("zero")).orderBy("id").collect()
    for r in out[:5]:
        assert r.Baseline_PD <= r.d <= 1.0 and r.hi >= r.d
        assert r.zero == pytest.approx(r.Baseline_PD)
    assert out[0].d == pytest.approx(0.05 * (1 + STATIC["FL"] * 0.3))
    assert out[5].d is None  # NULL stays NULL through the clip


def _cpd(spark, rows, scenario, **kw):
    df = _loans(spark, rows)
    return {r.id: r.CPD for r in overlay.score_cpd(df, scenario=scenario, impute_income=False, **kw).collect()}


def test_scenario_ordering_and_clip(spark):
    rows = [(1, 0.10, "ZZ", "car", 5e4), (2, 0.10, "ZZ", "small_business", 6e4), (3, 0.95, "ZZ", "coal", 1e4),
            (4, 0.99, "ZZ", "coal", 1e4)]
    o, d, h = (_cpd(spark, rows, s, severity=0.0) for s in ("orderly", "disorderly", "hot_house"))
    assert d[1] >= o[1] and h[2] <= o[2]
    assert all(0.0 <= v <= 1.0 for v in d.values())


def test_renewables_never_lower_pd(spark):
    assert SECTOR["renewable_energy"] < 0
    got = _cpd(spark, [(1, 0.1, "ZZ", "renewable_energy", 5e4)], "disorderly", severity=0.0)
    assert got[1] == pytest.approx(0.1)


def test_scaling_override_and_sector_beats_purpose(spark):
    rows = [(1, 0.10, "ZZ", "credit_card", 5e4)]
    base = _cpd(spark, rows, "orderly", severity=0.0)[1]
    assert _cpd(spark, rows, "orderly", severity=0.0, scaling=0.6)[1] > base
    df = _loans(spark, rows).withColumn("sector", F.lit("coal"))
    by_sector = overlay.score_cpd(df, scenario="orderly", severity=0.0, impute_income=False,
                                  sector_col="sector").first().CPD
    assert by_sector > base


def test_transition_exact_value(spark):
    got = _cpd(spark, [(1, 0.10, "ZZ", "car", 5e4)], "orderly", severity=0.0)[1]
    ratio = min(max(SECTOR["car"] * 100.0 / (5e4 / 1000 + 1e-6), 0), 0.5)
    assert got == pytest.approx(0.10 * (1 + ratio * 0.4))


def test_unknown_scenario_rejected():
    from tempest.sources import dims
    with pytest.raises(ValueError):
        dims.validate_scenario("Hot House World")


@pytest.mark.parametrize("cpd,tier", [(0.0, "Low"), (0.05, "Low"), (0.15, "Medium"), (0.30, "High"),
                                      (1.0, "Critical"), (None, None), (1.5, None)])
def test_risk_tiers_right_closed(spark, cpd, tier):
    df = spark.createDataFrame([(cpd,)], "CPD double")
    assert df.select(C.risk_tier("CPD").alias("t")).first().t == tier


@pytest.mark.parametrize("dti,b", [(-1.0, None), (0.0, 0.0), (10.0, 0.0), (20.0, 1.0), (30.0, 2.0), (100.0, 3.0),
                                   (100.1, None), (None, None)])
def test_dti_bins(spark, dti, b):
    df = spark.createDataFrame([(dti,)], "x double")
    assert df.select(C.right_closed_bin("x", config.DTI_BINS).alias("b")).first().b == b


@pytest.mark.parametrize("score,b", [(299.0, None), (300.0, 0.0), (580.0, 0.0), (670.0, 1.0), (740.0, 2.0),
                                     (850.0, 3.0), (851.0, None)])
def test_score_bins(spark, score, b):
    df = spark.createDataFrame([(score,)], "x double")
    assert df.select(C.right_closed_bin("x", config.FICO_BINS).alias("b")).first().b == b


def test_purpose_keys(spark):
    df = spark.createDataFrame([("Debt Consolidation",), ("COAL",), ("zzz",), (None,), ("renewable_energy",)], "purpose string")
    got = {r.purpose: r.emission_intensity for r in overlay.with_sector_lookup(df).collect()}
    assert got["Debt Consolidation"] == SECTOR["debt_consolidation"]
    assert got["COAL"] == SECTOR["coal"]
    assert got["zzz"] == got[None] == config.SECTOR_DEFAULT_INTENSITY


def test_proxy_sensitivity_draws_anew_for_every_rate(spark):
    """Every (loan, rate, trial) has draws of its own: the result is that of 2 x 5 separate runs over all loans."""
    import statistics

    from tempest.operators import scenarios as S
    from tempest.sources import dims

    rows = [(i, 0.05 + i / 100, 0.4, [0.1, 0.5, 0.9][i % 3], 3e4 + i, 1e3) for i in range(40)]
    inputs = spark.createDataFrame(rows, "loan_id long, Baseline_PD double, hazard double, emission_intensity double, annual_inc double, EAD double")
    got = {round(r["rate"], 2): r for r in S.proxy_sensitivity(inputs, (0.2, 0.6), trials=5).collect()}
    factors = [0.1, 0.5, 0.9]
    every = inputs.crossJoin(spark.createDataFrame([(f,) for f in factors], "f double"))
    phys = overlay.physical_pd("Baseline_PD", "hazard", 0.3)
    price = dims.scenario_price("orderly")
    change = F.abs(overlay.transition_pd(phys, "f", "annual_inc", price) - overlay.transition_pd(phys, "emission_intensity", "annual_inc", price))
    by = {(r["loan_id"], r["f"]): r["c"] for r in every.select("loan_id", "f", change.alias("c")).collect()}
    for k, rate in enumerate((0.2, 0.6)):
        means = []
        for trial in range(5):
            total = 0.0
            for i, *_ in rows:
                at = {}
                for name, text in S.draw_steps("row", "counter", 42):
                    at[name] = eval(text, {"row": i, "counter": k * 5 + trial, **at})  # noqa: S307
                if at["x3"] < rate * S.DRAW_MODULUS:
                    total += by[i, factors[int(at["x5"] * 3 / S.DRAW_MODULUS)]]
            means.append(total / len(rows))
        assert got[rate]["mean_abs_cpd_change"] == pytest.approx(statistics.fmean(means), abs=1e-12)
        assert got[rate]["std_abs_cpd_change"] == pytest.approx(statistics.pstdev(means), abs=1e-12)
