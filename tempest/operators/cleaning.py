"""Cleaning, typing, validation and feature engineering of loan tables.

P1-P13, F1-F3, F9.  Every function is ``DataFrame -> DataFrame`` (or a
column expression) and composes with ``df.transform``.  Columns are built
in a few wide ``select``/``withColumns`` steps to keep the plan shallow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import quantiles as Q

PASSTHROUGH = ["loan_id", "home_ownership", "purpose", "addr_state", "loan_status"]


def typed_loans(raw: DataFrame) -> DataFrame:
    """P1-P7 + P4: raw (text) loan table to typed base columns.

    Keeps ``loan_id`` and any non-raw columns the caller carried along.
    """
    extra = [c for c in raw.columns if c not in config.RAW_COLS]
    numeric_zero = ["revol_bal", "open_acc", "total_acc", "pub_rec", "delinq_2yrs",
                    "inq_last_6mths"] + config.BUREAU_COLS
    cols: dict[str, Column] = {
        "default": C.default_flag("loan_status"),
        "loan_status": F.col("loan_status"),
        "loan_amnt": C.to_double("loan_amnt"),
        "dti": C.to_double("dti"),
        "annual_inc": C.to_double("annual_inc"),
        "fico_range_low": C.to_double("fico_range_low"),
        "int_rate": C.percent_to_double("int_rate"),
        "installment": C.to_double("installment"),
        "emp_length": C.first_digits("emp_length", 0.0),
        "home_ownership": F.col("home_ownership"),
        "purpose": F.col("purpose"),
        "addr_state": F.col("addr_state"),
        "revol_util": F.coalesce(C.percent_to_double("revol_util"), C.lit_d(0.0)),
        "term_months": C.first_digits("term", 36.0),
        "sub_grade_num": C.sub_grade_ordinal("sub_grade"),
        "verification_num": C.verification_ordinal("verification_status"),
        "credit_history_months": C.credit_history_months("earliest_cr_line"),
    }
    for c in numeric_zero:
        cols[c] = C.to_double_or(c, 0.0) if c in raw.columns else C.lit_d(0.0)
    return raw.select(*[F.col(c) for c in extra], *[v.alias(k) for k, v in cols.items()])


def drop_incomplete(df: DataFrame, subset: Sequence[str] = ("dti", "annual_inc", "fico_range_low")) -> DataFrame:
    """drop loans missing dti / annual_inc / fico (pushed below the feature work)."""
    return df.na.drop(subset=list(subset))


def engineered_columns(df: DataFrame) -> dict[str, Column]:
    """P8 + P9: the ten engineered features as expressions over typed columns."""
    inc = F.col("annual_inc")

    def ratio(num, den):
        return F.try_divide(num, den)

    def present(c, default=0.0):
        return F.col(c) if c in df.columns else C.lit_d(default)

    return {
        "income_to_installment": ratio(inc, F.col("installment") * 12 + 1),
        "loan_to_income": ratio(present("loan_amnt"), inc + 1),
        "dti_bucket": C.right_closed_bin("dti", config.DTI_BINS),
        "fico_bucket": C.right_closed_bin("fico_range_low", config.FICO_BINS),
        "monthly_payment_burden": ratio(F.col("installment"), inc / 12 + 1),
        "credit_utilization_ratio": ratio(present("revol_bal"), inc + 1),
        "open_to_total_acc": ratio(present("open_acc"), present("total_acc") + 1),
        "bc_limit_to_income": ratio(present("total_bc_limit"), inc + 1),
        "rev_limit_to_income": ratio(present("total_rev_hi_lim"), inc + 1),
        "recent_accts_ratio": ratio(present("acc_open_past_24mths"), present("total_acc") + 1),
    }


def add_engineered(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """P8/P9; with ``only_missing`` the existing columns are kept (scoring path)."""
    cols = engineered_columns(df)
    if only_missing:
        cols = {k: v for k, v in cols.items() if k not in df.columns}
    return df.withColumns(cols) if cols else df


def clean_loans(raw: DataFrame) -> DataFrame:
    """``load_data``: typed columns, incomplete rows dropped, engineered features added."""
    return raw.transform(typed_loans).transform(drop_incomplete).transform(add_engineered)


def default_fill(df: DataFrame) -> DataFrame:
    """Add scoring columns that are absent, with their fixed defaults."""
    missing = {c: C.lit_d(v) for c, v in config.SCORING_DEFAULTS if c not in df.columns}
    return df.withColumns(missing) if missing else df


def medians_row(df: DataFrame, cols: Sequence[str], reread: bool = False) -> DataFrame:
    """One-row frame of exact batch medians (pandas ``median``: mean of the two middle values)."""
    return Q.column_quantiles(df, cols, 0.5, reread)


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``X.fillna(X.median())`` as one aggregate and a scalar subquery per column.

    The medians are computed once (one pass, partial aggregation) and enter
    the row expressions as scalar subqueries, so no join and no shuffle of
    the loan rows happens.
    """
    cols = list(cols)
    if not cols:
        return df
    med = medians_row(df, cols).select(F.struct(*cols).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), med.getField(c)) for c in cols})


def prediction_at(p, threshold: float) -> Column:
    """F9."""
    return (C.col_(p) >= C.lit_d(threshold)).cast("int")


# ---------------------------------------------------------------------------
# per-field range checks of scoring requests
# ---------------------------------------------------------------------------
RANGE_RULES: list[tuple[str, float | None, float | None, bool]] = [
    # (column, low, high, low_exclusive)
    ("dti", 0.0, 100.0, False),
    ("annual_inc", 0.0, None, True),
    ("fico_range_low", 300.0, 850.0, False),
    ("int_rate", 0.0, 40.0, False),
    ("installment", 0.0, None, True),
    ("emp_length", 0.0, 10.0, False),
    ("loan_amnt", 0.0, None, True),
    ("revol_util", 0.0, None, False),
    ("revol_bal", 0.0, None, False),
    ("open_acc", 0.0, None, False),
    ("total_acc", 0.0, None, False),
    ("pub_rec", 0.0, None, False),
    ("delinq_2yrs", 0.0, None, False),
    ("inq_last_6mths", 0.0, None, False),
    ("acc_open_past_24mths", 0.0, None, False),
    ("mort_acc", 0.0, None, False),
    ("total_bc_limit", 0.0, None, False),
    ("total_rev_hi_lim", 0.0, None, False),
    ("mo_sin_rcnt_tl", 0.0, None, False),
    ("mo_sin_old_rev_tl_op", 0.0, None, False),
    ("num_actv_rev_tl", 0.0, None, False),
    ("percent_bc_gt_75", 0.0, 100.0, False),
    ("bc_util", 0.0, None, False),
    ("mths_since_recent_inq", 0.0, None, False),
    # per-request overlay factors
    ("severity_factor", 0.0, 1.0, False),
    ("transition_scaling", 0.0, 1.0, False),
]


def reject_reasons(df: DataFrame, rules=RANGE_RULES) -> Column:
    """Array of '<field> out of range' texts for the rules that fail (missing values pass)."""
    reasons = []
    for c, lo, hi, lo_excl in rules:
        if c not in df.columns:
            continue
        x = F.col(c)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | ((x <= C.lit_d(lo)) if lo_excl else (x < C.lit_d(lo)))
        if hi is not None:
            bad = bad | (x > C.lit_d(hi))
        reasons.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{c} out of range")))
    if not reasons:
        return F.array().cast("array<string>")
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def validate(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """F2 + F3: fail fast on missing columns, then tag each row with its reject reasons."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df.withColumn("reject_reasons", reject_reasons(df))
