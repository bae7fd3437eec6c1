"""Step 2 of the build plan: parsing, cleaning, features, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import cleaning, overlay, scoring
from tempest.plans import base
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import _scorecard_sql, cpd_sql, div_sql, strip_sql, with_base
from tempest.sources.loans import fixture_loans


def _typed(spark, sf_dir):
    return cleaning.typed_loans(fixture_loans(spark, sf_dir))


def _cols_sql(cols, table="clean") -> str:
    return f"SELECT loan_id, {', '.join(r(c) + ' AS ' + c for c in cols)} FROM {table}"


@register("clean_loans", lambda: with_base(
    f'SELECT loan_id, "default", {", ".join(r(c) + " AS " + c for c in config.ALL_FEATURES)} FROM clean'),
    "S1 P1-P9 F1 P19")
def clean_loans(spark, sf_dir):
    df = base.clean(spark, sf_dir)
    return finish(df.select("loan_id", "default", *config.ALL_FEATURES))


@register("percent_parse", lambda: with_base(_cols_sql(["int_rate", "revol_util"], "typed")), "P2")
def percent_parse(spark, sf_dir):
    return finish(_typed(spark, sf_dir).select("loan_id", "int_rate", "revol_util"))


@register("emp_length_digits", lambda: with_base(_cols_sql(["emp_length", "term_months"], "typed")), "P3")
def emp_length_digits(spark, sf_dir):
    return finish(_typed(spark, sf_dir).select("loan_id", "emp_length", "term_months"))


@register("subgrade_ordinal", lambda: with_base(_cols_sql(["sub_grade_num", "verification_num"], "typed")),
          "P5 P6")
def subgrade_ordinal(spark, sf_dir):
    return finish(_typed(spark, sf_dir).select("loan_id", "sub_grade_num", "verification_num"))


@register("credit_history", lambda: with_base(_cols_sql(["credit_history_months"], "typed")), "P7")
def credit_history(spark, sf_dir):
    return finish(_typed(spark, sf_dir).select("loan_id", "credit_history_months"))


RATIOS = ["income_to_installment", "loan_to_income", "monthly_payment_burden", "credit_utilization_ratio",
          "open_to_total_acc", "bc_limit_to_income", "rev_limit_to_income", "recent_accts_ratio"]


@register("ratio_features", lambda: with_base(_cols_sql(RATIOS)), "P8")
def ratio_features(spark, sf_dir):
    return finish(base.clean(spark, sf_dir).select("loan_id", *RATIOS))


@register("dti_fico_bins", lambda: with_base("""
SELECT loan_id,
  CAST(CASE WHEN dti >= 0 AND dti <= 10 THEN 0.0 WHEN dti > 10 AND dti <= 20 THEN 1.0
       WHEN dti > 20 AND dti <= 30 THEN 2.0 WHEN dti > 30 AND dti <= 100 THEN 3.0 END AS DOUBLE) AS dti_bucket,
  CAST(CASE WHEN fico_range_low >= 300 AND fico_range_low <= 580 THEN 0.0 WHEN fico_range_low > 580 AND fico_range_low <= 670 THEN 1.0
       WHEN fico_range_low > 670 AND fico_range_low <= 740 THEN 2.0 WHEN fico_range_low > 740 AND fico_range_low <= 850 THEN 3.0 END AS DOUBLE) AS fico_bucket,
  CASE WHEN fico_range_low > 300 AND fico_range_low <= 580 THEN 'Poor' WHEN fico_range_low > 580 AND fico_range_low <= 670 THEN 'Fair'
       WHEN fico_range_low > 670 AND fico_range_low <= 740 THEN 'Good' WHEN fico_range_low > 740 AND fico_range_low <= 850 THEN 'Excellent' END AS fico_group
FROM typed"""), "P9 P10")
def dti_fico_bins(spark, sf_dir):
    df = _typed(spark, sf_dir)
    fico = F.col("fico_range_low")
    edges = config.FICO_BINS
    group = None
    for i, lab in enumerate(config.FICO_GROUP_LABELS):  # P10: first edge open
        cond = (fico > edges[i]) & (fico <= edges[i + 1])
        group = F.when(cond, F.lit(lab)) if group is None else group.when(cond, F.lit(lab))
    return df.select("loan_id", C.right_closed_bin("dti", config.DTI_BINS).alias("dti_bucket"),
                     C.right_closed_bin("fico_range_low", config.FICO_BINS).alias("fico_bucket"),
                     group.alias("fico_group"))


@register("median_impute", lambda: with_base(
    "SELECT loan_id, " + ", ".join(f"{r(f'coalesce({c}, (SELECT median({c}) FROM clean))')} AS {c}"
                                   for c in config.ALL_FEATURES) + " FROM clean"), "P12 P13")
def median_impute(spark, sf_dir):
    df = base.clean(spark, sf_dir).select("loan_id", *config.ALL_FEATURES)
    return finish(cleaning.median_impute(df, config.ALL_FEATURES))


def _income_fill_sql() -> str:
    medians = ", ".join(f"median({f}) AS med_{f}" for f, _, _ in scoring.SCORECARD_WEIGHTS)
    return with_base(f"""WITH p AS (SELECT typed.*, {_scorecard_sql()} AS Baseline_PD FROM typed, (SELECT {medians} FROM typed) med),
l AS (SELECT p.*, coalesce(s.physical_risk, 0.45) AS hazard, coalesce(k.emission_intensity, 0.25) AS emission_intensity,
        coalesce(annual_inc, (SELECT median(annual_inc) FROM typed)) AS income
      FROM p LEFT JOIN states s ON {strip_sql('p.addr_state')} = s.state_key
      LEFT JOIN sectors k ON replace(lower(p.purpose), ' ', '_') = k.sector_key)
SELECT loan_id, annual_inc IS NULL AS filled, {r('income', 2)} AS income, {r(cpd_sql().replace('annual_inc', 'income'))} AS CPD FROM l""")


@register("income_filled_overlay", _income_fill_sql, "P13 R8")
def income_filled_overlay(spark, sf_dir):
    """Both overlays on the typed loans before incomplete rows go: a missing income counts as the batch median."""
    df = scoring.scorecard_pd(_typed(spark, sf_dir))
    scored = overlay.score_cpd(df, impute_income=True)
    out = scored.select("loan_id", F.col("annual_inc").isNull().alias("filled"), overlay.income_filled(df).alias("income"), "CPD")
    return finish(out, money=("income",))


def _default_fill_sql() -> str:
    defaults = dict(config.SCORING_DEFAULTS)
    given = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment", "emp_length"]
    exprs = []
    for c in config.BASE_FEATURES:
        exprs.append(f"{r(c)} AS {c}" if c in given else f"CAST({defaults[c]} AS DOUBLE) AS {c}")
    eng = {
        "income_to_installment": div_sql("annual_inc", "installment * 12 + 1"),
        "loan_to_income": div_sql(str(defaults["loan_amnt"]), "annual_inc + 1"),
        "dti_bucket": "CAST(CASE WHEN dti >= 0 AND dti <= 10 THEN 0.0 WHEN dti > 10 AND dti <= 20 THEN 1.0 "
                      "WHEN dti > 20 AND dti <= 30 THEN 2.0 WHEN dti > 30 AND dti <= 100 THEN 3.0 END AS DOUBLE)",
        "fico_bucket": "CAST(CASE WHEN fico_range_low >= 300 AND fico_range_low <= 580 THEN 0.0 "
                       "WHEN fico_range_low > 580 AND fico_range_low <= 670 THEN 1.0 "
                       "WHEN fico_range_low > 670 AND fico_range_low <= 740 THEN 2.0 "
                       "WHEN fico_range_low > 740 AND fico_range_low <= 850 THEN 3.0 END AS DOUBLE)",
        "monthly_payment_burden": div_sql("installment", "annual_inc / 12 + 1"),
        "credit_utilization_ratio": div_sql("0.0", "annual_inc + 1"),
        "open_to_total_acc": div_sql("0.0", "0.0 + 1"),
        "bc_limit_to_income": div_sql("0.0", "annual_inc + 1"),
        "rev_limit_to_income": div_sql("0.0", "annual_inc + 1"),
        "recent_accts_ratio": div_sql("0.0", "0.0 + 1"),
    }
    exprs += [f"{r(v)} AS {k}" for k, v in eng.items()]
    return "SELECT loan_id, " + ", ".join(exprs) + " FROM clean"


@register("default_fill", lambda: with_base(_default_fill_sql()), "P11 M10")
def default_fill(spark, sf_dir):
    """Minimal scoring rows (six fields) completed with the fixed defaults and engineered features."""
    given = ["loan_id", "dti", "annual_inc", "fico_range_low", "int_rate", "installment", "emp_length"]
    df = base.clean(spark, sf_dir).select(*given)
    df = cleaning.add_engineered(cleaning.default_fill(df), only_missing=True)
    return finish(df.select("loan_id", *config.ALL_FEATURES))


# The field rules, written out in the order of the reasons: field, what breaks its rule.
BROKEN_RULES = [
    ("dti", "dti < 0 OR dti > 100"),
    ("annual_inc", "annual_inc <= 0"),
    ("fico_range_low", "fico_range_low < 300 OR fico_range_low > 850"),
    ("int_rate", "int_rate < 0 OR int_rate > 40"),
    ("installment", "installment <= 0"),
    ("emp_length", "emp_length < 0 OR emp_length > 10"),
    ("loan_amnt", "loan_amnt <= 0"),
    ("revol_util", "revol_util < 0"),
    ("revol_bal", "revol_bal < 0"),
    ("open_acc", "open_acc < 0"),
    ("total_acc", "total_acc < 0"),
    ("pub_rec", "pub_rec < 0"),
    ("delinq_2yrs", "delinq_2yrs < 0"),
    ("inq_last_6mths", "inq_last_6mths < 0"),
    ("acc_open_past_24mths", "acc_open_past_24mths < 0"),
    ("mort_acc", "mort_acc < 0"),
    ("total_bc_limit", "total_bc_limit < 0"),
    ("total_rev_hi_lim", "total_rev_hi_lim < 0"),
    ("mo_sin_rcnt_tl", "mo_sin_rcnt_tl < 0"),
    ("mo_sin_old_rev_tl_op", "mo_sin_old_rev_tl_op < 0"),
    ("num_actv_rev_tl", "num_actv_rev_tl < 0"),
    ("percent_bc_gt_75", "percent_bc_gt_75 < 0 OR percent_bc_gt_75 > 100"),
    ("bc_util", "bc_util < 0"),
    ("mths_since_recent_inq", "mths_since_recent_inq < 0"),
]


def _rejects_sql() -> str:
    lst = ", ".join(f"CASE WHEN coalesce({bad}, false) THEN '{c} out of range' END" for c, bad in BROKEN_RULES)
    return f"""SELECT loan_id, CAST(len(rs) AS INTEGER) AS n_reasons, array_to_string(rs, ';') AS reasons
FROM (SELECT loan_id, list_filter([{lst}], lambda x: x IS NOT NULL) AS rs FROM typed) WHERE len(rs) > 0"""


@register("validate_rejects", lambda: with_base(_rejects_sql()), "F2 F3")
def validate_rejects(spark, sf_dir):
    required = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment"]
    df = cleaning.validate(_typed(spark, sf_dir), required)
    return df.where(F.size("reject_reasons") > 0).select(
        "loan_id", F.size("reject_reasons").alias("n_reasons"),
        F.array_join("reject_reasons", ";").alias("reasons"))


@register("default_flag_by_status", lambda: with_base("""
SELECT loan_status, "default", count(*) AS n FROM typed GROUP BY ALL"""), "P1")
def default_flag_by_status(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy("loan_status", "default").agg(F.count(F.lit(1)).alias("n"))
