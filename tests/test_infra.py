"""Quantiles, upload contract, dataset registry, dimensions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempest.operators import adapters as A
from tempest.operators import batch as B
from tempest.operators import quantiles as Q
from tempest.sources import dims


def test_quantiles_equal_percentile(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e-310, 1e308, -1e308, None, float("nan")]
    rows = [(g, rng.choice(values + [rng.gauss(0, 1), rng.uniform(-1e6, 1e6), float(rng.randint(-3, 3)), 2.0 ** rng.randint(-50, 50)]))
            for g, n in (("a", 1), ("b", 7), (None, 800)) for _ in range(n)]
    df = spark.createDataFrame(rows + [("c", 5.0)] * 9, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in Q.quantiles(df, "x", probs, ["g"]).collect()}
    exact = df.where("x is not null and not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q"))
    assert got == {r.g: r.q for r in exact.collect()}
    assert Q.quantiles(df.where("false"), "x", [0.5]).collect()[0].q == [None]
    assert Q.quantiles(df.where("false"), "x", [0.5], ["g"]).collect() == []


def test_value_buckets_keep_the_order(spark):
    rng = random.Random(2)
    xs = sorted([rng.uniform(-1, 1) * 2.0 ** rng.randint(-1000, 1000) for _ in range(3000)] + [0.0, 5e-324, -5e-324]
                + [f(2.0 ** k) for k in range(-1000, 1000, 7) for f in (float, lambda x: math.nextafter(x, 0))])
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double").orderBy("i")
    buckets = [r[0] for r in df.select(Q.value_bucket(F.col("x"))).collect()]
    assert buckets == sorted(buckets)


def test_upload_requires_columns_before_any_job(spark):
    df = spark.createDataFrame([("1", "2")], "dti string, annual_inc string")
    with pytest.raises(ValueError, match="fico_range_low"):
        B.prepare_upload(df)


def test_upload_coercion_and_drop(spark):
    df = spark.createDataFrame([("15", "60000", "700", "12.5%", "300", "10+ years"),
                                ("n/a", "60000", "700", "12%", "300", None)],
                               "dti string, annual_inc string, fico_range_low string, int_rate string, "
                               "installment string, emp_length string")
    out = B.prepare_upload(df).collect()
    assert len(out) == 1 and out[0].int_rate == 12.5 and out[0].emp_length == 10.0


def test_dataset_registry_keys():
    assert set(A.DATASET_REGISTRY) == {"lendingclub", "home_credit", "indian_bank"}
    with pytest.raises(ValueError):
        A.load_dataset(None, "nope", "/x")


def test_dimensions_bounded_and_local(spark):
    for d in (dims.state_dim(spark), dims.sector_dim(spark), dims.org_sector_dim(spark), dims.scenario_dim(spark)):
        assert d.count() <= dims.MAX_DIM_ROWS
    assert dims.state_dim(spark).where("state_key = 'OTHER'").first().physical_risk == 0.45


def test_upload_sinks_agree_and_summary_matches(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    rows = E.queries()["batch_upload_rows"](spark, SF_SMALL)
    assert rows.count() > 0 and rows.where("NOT same").count() == 0
    summary = E.queries()["batch_upload_summary"](spark, SF_SMALL).first()
    tiers = summary.n_low + summary.n_medium + summary.n_high + summary.n_critical
    assert summary.n_scored <= summary.n_input and tiers == summary.n_scored


def test_tuning_query_searches_all_candidates(monkeypatch):
    from tempest.plans import q_model

    asked = {}
    monkeypatch.setattr(q_model, "blocks", lambda spark, sf_dir, folds: None)
    monkeypatch.setattr(q_model, "trial_ledger", lambda spark, sf_dir: None)

    class Found:
        def select(self, *columns):
            return columns

    monkeypatch.setattr(q_model.boosting, "search", lambda blocks, candidates, folds, n, book: asked.update(c=candidates, folds=folds) or Found())
    q_model.tune_gbt(None, None)
    assert sum(len(stages) for _, stages in asked["c"]) == 75 and asked["folds"] == 3
    for p, stages in asked["c"]:
        assert len(p) == 7 and 3 <= p["max_depth"] <= 10 and 1e-8 <= p["reg_alpha"] <= 10 and 1e-8 <= p["reg_lambda"] <= 10
        assert all(100 <= n <= 500 and n % 50 == 0 for n in stages) and len(set(stages)) == len(stages)
