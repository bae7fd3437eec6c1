"""Adapters of foreign loan layouts to the loan schema.

Both adapters are one projection over the scanned rows plus, for the
home-credit layout, a broadcast lookup of the organisation type (a fixed
table of 57 keys) and, for the Indian-bank layout, one batch median entering
as a scalar subquery.  No loan row is shuffled.

Output columns (both): default, loan_status, annual_inc, loan_amnt,
installment, emp_length, fico_range_low, dti, int_rate, purpose, addr_state,
preceded by the source id as ``loan_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import quantiles as Q
from tempest.sources import adapters as src
from tempest.sources import dims

LOAN_COLUMNS = ["loan_id", "default", "loan_status", "annual_inc", "loan_amnt", "installment", "emp_length",
                "fico_range_low", "dti", "int_rate", "purpose", "addr_state"]


def _map(c: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def adapt_home_credit(df: DataFrame, id_col: str = "SK_ID_CURR") -> DataFrame:
    """Home-credit application rows to loans; rows missing income, amount, score or DTI dropped."""
    days = F.col("DAYS_EMPLOYED").cast("double")
    emp = (F.when(days.isNull(), F.lit(None).cast("double"))
           .when(days > 0, C.lit_d(0.0))
           .otherwise(F.least(F.abs(days) / C.lit_d(365.25), C.lit_d(40.0))))
    ext = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
    ext_sum = sum((F.coalesce(F.col(e), C.lit_d(0.0)) for e in ext[1:]), F.coalesce(F.col(ext[0]), C.lit_d(0.0)))
    ext_n = sum((F.col(e).isNotNull().cast("int") for e in ext[1:]), F.col(ext[0]).isNotNull().cast("int"))
    ext_mean = F.try_divide(ext_sum, F.nullif(ext_n, F.lit(0)).cast("double"))
    installment = F.coalesce(F.col("AMT_ANNUITY"), C.lit_d(0.0))
    income = F.col("AMT_INCOME_TOTAL").cast("double")
    org = dims.org_sector_dim(df.sparkSession).select(F.col("organization_type").alias("_org"),
                                                       F.col("sector").alias("_org_sector"))
    keyed = df.join(org, df["ORGANIZATION_TYPE"] == org["_org"], "left")
    target = F.col("TARGET").cast("int")
    out = keyed.select(
        F.col(id_col).alias("loan_id"),
        target.alias("default"),
        F.when(target == 1, F.lit("Charged Off")).when(target == 0, F.lit("Fully Paid")).alias("loan_status"),
        income.alias("annual_inc"),
        F.col("AMT_CREDIT").cast("double").alias("loan_amnt"),
        installment.alias("installment"),
        emp.alias("emp_length"),
        F.coalesce(C.clip(ext_mean * C.lit_d(550.0) + C.lit_d(300.0), 300.0, 850.0), C.lit_d(580.0))
        .alias("fico_range_low"),
        C.clip(installment * C.lit_d(12.0) / (income + C.lit_d(1.0)) * C.lit_d(100.0), 0.0, 100.0).alias("dti"),
        F.coalesce(C.clip(F.col("AMT_CREDIT") / (F.col("AMT_GOODS_PRICE") + C.lit_d(1.0)) - C.lit_d(1.0), 0.0, 0.5)
                   * C.lit_d(100.0), C.lit_d(12.0)).alias("int_rate"),
        F.coalesce(F.col("_org_sector"), F.lit("other")).alias("purpose"),
        _map(F.col("REGION_RATING_CLIENT"), config.REGION_RATING_STATE, config.REGION_RATING_DEFAULT)
        .alias("addr_state"),
    )
    return out.na.drop(subset=["annual_inc", "loan_amnt", "fico_range_low", "dti"])


def adapt_indian_bank(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """Indian-bank rows to loans; rows missing income or amount dropped.

    The state follows the income relative to the batch median, which is taken
    over all rows before the drop (one aggregate, used as a scalar subquery).
    """
    income = F.col("Monthly_Income").cast("double") * C.lit_d(12.0)
    emi = F.col("Existing_EMI").cast("double")
    amount = F.col("Loan_Amount_Applied").cast("double")
    tenure_months = F.col("Loan_Tenure_Applied").cast("double") * C.lit_d(12.0)
    med = Q.quantile(df, income, 0.5)
    purpose = F.lit("small_business")
    if "Source_0" in df.columns:
        s1 = F.col("Source_1") == 1 if "Source_1" in df.columns else F.lit(False)
        s2 = F.col("Source_2") == 1 if "Source_2" in df.columns else F.lit(False)
        purpose = (F.when(s2, F.lit("debt_consolidation")).when(s1, F.lit("home_improvement"))
                   .otherwise(F.lit("small_business")))
    state = (F.when(income > med * C.lit_d(1.5), F.lit("Maharashtra"))
             .when(income > med, F.lit("Tamil Nadu"))
             .when(income > med * C.lit_d(0.5), F.lit("Uttar Pradesh"))
             .otherwise(F.lit("Bihar")))
    disbursed = F.col("Disbursed").cast("int")
    out = df.select(
        F.col(id_col).alias("loan_id"),
        (F.lit(1) - disbursed).alias("default"),
        F.when(disbursed == 0, F.lit("Charged Off")).when(disbursed == 1, F.lit("Fully Paid")).alias("loan_status"),
        income.alias("annual_inc"),
        amount.alias("loan_amnt"),
        F.when(emi > 0, emi).otherwise(amount / (tenure_months + C.lit_d(1.0))).alias("installment"),
        F.coalesce(C.clip(F.col("age").cast("double") - C.lit_d(22.0), 0.0, 40.0), C.lit_d(5.0)).alias("emp_length"),
        _map(F.col("Var4"), config.VAR4_SCORE, config.VAR4_DEFAULT_SCORE).cast("double").alias("fico_range_low"),
        C.clip(emi * C.lit_d(12.0) / (income + C.lit_d(1.0)) * C.lit_d(100.0), 0.0, 100.0).alias("dti"),
        F.coalesce(C.clip(C.lit_d(12.0) + F.col("Var5").cast("double") * C.lit_d(0.5), 5.0, 30.0), C.lit_d(12.0))
        .alias("int_rate"),
        purpose.alias("purpose"),
        state.alias("addr_state"),
    )
    return out.na.drop(subset=["annual_inc", "loan_amnt"])


def retention(raw: DataFrame, adapted: DataFrame, dataset: str) -> DataFrame:
    """Input rows, kept rows, retained share (%) and default rate of the kept rows."""
    n_in = raw.agg(F.count(F.lit(1))).scalar()
    kept = adapted.agg(F.count(F.lit(1)).alias("n_kept"), F.avg(F.col("default").cast("double")).alias("default_rate"))
    return kept.select(
        F.lit(dataset).alias("dataset"), n_in.alias("n_input"), "n_kept",
        (F.col("n_kept") / n_in * 100.0).alias("retained_pct"), "default_rate")


# S3: dataset registry, key -> (label, loader(spark, path, limit) -> loan-schema DataFrame)
def _load_lendingclub(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    from tempest.operators.cleaning import clean_loans
    from tempest.sources.loans import read_loan_csv
    return clean_loans(read_loan_csv(spark, path, limit))


DATASET_REGISTRY = {
    "lendingclub": ("LendingClub (US)", _load_lendingclub),
    "home_credit": ("Home Credit Default Risk",
                    lambda spark, path, limit=None: adapt_home_credit(src.read_home_credit(spark, path, limit))),
    "indian_bank": ("Indian Bank Loan Dataset",
                    lambda spark, path, limit=None: adapt_indian_bank(src.read_indian_bank(spark, path, limit))),
}


def load_dataset(spark: SparkSession, key: str, path: str, limit: int | None = None) -> DataFrame:
    """S3: load a registered dataset in the loan schema."""
    if key not in DATASET_REGISTRY:
        raise ValueError(f"unknown dataset {key!r}; known: {sorted(DATASET_REGISTRY)}")
    return DATASET_REGISTRY[key][1](spark, path, limit)
