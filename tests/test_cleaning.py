"""Text coercion, ordinals, dates, clipping and validation."""

import pytest

from tempest.functions import columns as C
from tempest.operators import cleaning


@pytest.mark.parametrize("text,val", [("12.5%", 12.5), ("12.5", 12.5), ("n/a", None), ("nan", None), ("", None),
                                      (None, None)])
def test_percent_text(spark, text, val):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(C.percent_to_double("x").alias("v")).first().v == val


@pytest.mark.parametrize("text,val", [("10+ years", 10.0), ("< 1 year", 1.0), ("n/a", 0.0), (None, 0.0),
                                      ("3 years", 3.0)])
def test_first_digits(spark, text, val):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(C.first_digits("x", 0.0).alias("v")).first().v == val


@pytest.mark.parametrize("g,val", [("A1", 1.0), ("C3", 13.0), ("G5", 35.0), ("H1", 18.0), ("A6", 18.0), (None, 18.0)])
def test_sub_grade(spark, g, val):
    df = spark.createDataFrame([(g,)], "x string")
    assert df.select(C.sub_grade_ordinal("x").alias("v")).first().v == val


def test_credit_history(spark):
    df = spark.createDataFrame([("Jan-2010",), ("bad",), (None,)], "x string")
    got = [r.v for r in df.select(C.credit_history_months("x").alias("v")).collect()]
    assert got[0] == pytest.approx(2922 / 30.44)
    assert got[1:] == [180.0, 180.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r.v for r in df.select(C.clip("x", 0.0, 1.0).alias("v")).collect()] == [None, 0.0, 1.0]


def test_default_flag(spark):
    df = spark.createDataFrame([("Charged Off",), ("Default",), ("Late (31-120 days)",), ("Fully Paid",), (None,)],
                               "s string")
    assert [r.v for r in df.select(C.default_flag("s").alias("v")).collect()] == [1, 1, 1, 0, 0]


def test_required_columns_and_reject_reasons(spark):
    df = spark.createDataFrame([(15.0, 60000.0, 700.0), (150.0, -1.0, 299.0)], "dti double, annual_inc double, fico_range_low double")
    with pytest.raises(ValueError):
        cleaning.validate(df, ["dti", "int_rate"])
    got = [r.reject_reasons for r in cleaning.validate(df, ["dti"]).collect()]
    assert got[0] == [] and set(got[1]) == {"dti out of range", "annual_inc out of range", "fico_range_low out of range"}


def test_median_impute_is_mean_of_middle_pair(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    got = sorted(r.x for r in cleaning.median_impute(df, ["x"]).collect())
    assert got == [1.0, 2.0, 3.0, 4.0, 10.0]


def test_default_fill_only_missing(spark):
    df = spark.createDataFrame([(5.0,)], "term_months double")
    out = cleaning.default_fill(df).first()
    assert out.term_months == 5.0 and out.sub_grade_num == 18.0 and out.credit_history_months == 180.0
