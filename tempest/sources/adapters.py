"""Sources of second portfolios in foreign schemas.

* ``read_home_credit`` / ``read_indian_bank``: CSV scans of the two foreign
  layouts with an explicit schema (only the named columns are parsed).
* ``fixture_home_credit`` / ``fixture_indian_bank``: the driver's tables hold
  no such portfolios, so these map ``orders`` + ``customer`` onto the two
  layouts (missing values, sentinel 365243, unmapped codes included).  They
  only produce rows in the foreign schema; the adaptation itself is
  ``tempest.operators.adapters``.  As for the loans, the mapping is a list of
  SQL expressions shared with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempest.sources.loans import table

HOME_CREDIT_SCHEMA = (
    "SK_ID_CURR BIGINT, TARGET INT, AMT_INCOME_TOTAL DOUBLE, AMT_CREDIT DOUBLE, AMT_ANNUITY DOUBLE, "
    "AMT_GOODS_PRICE DOUBLE, DAYS_EMPLOYED INT, DAYS_BIRTH INT, EXT_SOURCE_1 DOUBLE, EXT_SOURCE_2 DOUBLE, "
    "EXT_SOURCE_3 DOUBLE, CNT_CHILDREN INT, ORGANIZATION_TYPE STRING, REGION_RATING_CLIENT INT, "
    "NAME_INCOME_TYPE STRING, NAME_CONTRACT_TYPE STRING"
)
INDIAN_BANK_SCHEMA = (
    "ID BIGINT, Disbursed INT, Monthly_Income DOUBLE, Loan_Amount_Applied DOUBLE, Loan_Tenure_Applied DOUBLE, "
    "Existing_EMI DOUBLE, age INT, Var4 INT, Var5 INT, Source_0 INT, Source_1 INT, Source_2 INT"
)


def read_home_credit(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """S4 scan: header CSV with the 15 used columns (plus the id) typed by the schema."""
    df = spark.read.option("header", True).schema(HOME_CREDIT_SCHEMA).csv(path)
    return df.limit(limit) if limit is not None else df


def read_indian_bank(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """S5 scan: header CSV of the Indian-bank layout."""
    df = spark.read.option("header", True).schema(INDIAN_BANK_SCHEMA).csv(path)
    return df.limit(limit) if limit is not None else df


_K = "o_orderkey"
_C = "o_custkey"

HOME_CREDIT_COLUMNS: list[tuple[str, str]] = [
    ("SK_ID_CURR", _K),
    ("TARGET", "CAST(CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 "
               "ELSE 0 END AS INTEGER)"),
    ("AMT_INCOME_TOTAL", f"CASE WHEN {_C} % 29 = 0 THEN NULL ELSE CAST((c_acctbal + 1500) * 20 AS DOUBLE) END"),
    ("AMT_CREDIT", "CAST(o_totalprice AS DOUBLE)"),
    ("AMT_ANNUITY", f"CASE WHEN {_K} % 17 = 0 THEN NULL ELSE CAST(o_totalprice / 24 AS DOUBLE) END"),
    ("AMT_GOODS_PRICE", f"CASE WHEN {_K} % 23 = 0 THEN NULL ELSE CAST(o_totalprice * 0.9 AS DOUBLE) END"),
    ("DAYS_EMPLOYED", f"CAST(CASE {_K} % 10 WHEN 0 THEN 365243 WHEN 1 THEN NULL WHEN 2 THEN 0 "
                      f"ELSE -(({_K} * 13) % 20000) END AS INTEGER)"),
    ("DAYS_BIRTH", f"CAST(-(8000 + {_K} % 15000) AS INTEGER)"),
    ("EXT_SOURCE_1", f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE CAST(({_K} * 7) % 1000 AS DOUBLE) / 1000 END"),
    ("EXT_SOURCE_2", f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE CAST(({_K} * 11) % 1000 AS DOUBLE) / 1000 END"),
    ("EXT_SOURCE_3", f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE CAST(({_K} * 13) % 1000 AS DOUBLE) / 1000 END"),
    ("CNT_CHILDREN", f"CAST({_C} % 4 AS INTEGER)"),
    ("ORGANIZATION_TYPE", f"CASE WHEN {_K} % 19 = 0 THEN NULL ELSE CASE c_mktsegment "
                          "WHEN 'AUTOMOBILE' THEN 'Transport: type 2' WHEN 'MACHINERY' THEN 'Industry: type 3' "
                          "WHEN 'BUILDING' THEN 'Construction' WHEN 'HOUSEHOLD' THEN 'Self-employed' "
                          "ELSE 'Unlisted organisation' END END"),
    ("REGION_RATING_CLIENT", f"CAST(1 + {_K} % 4 AS INTEGER)"),
    ("NAME_INCOME_TYPE", "'Working'"),
    ("NAME_CONTRACT_TYPE", "'Cash loans'"),
]

INDIAN_BANK_COLUMNS: list[tuple[str, str]] = [
    ("ID", _K),
    ("Disbursed", f"CAST(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 "
                  f"ELSE {_K} % 2 END AS INTEGER)"),
    ("Monthly_Income", f"CASE WHEN {_C} % 31 = 0 THEN NULL ELSE CAST(c_acctbal + 1500 AS DOUBLE) END"),
    ("Loan_Amount_Applied", f"CASE WHEN {_K} % 43 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END"),
    ("Loan_Tenure_Applied", f"CAST({_K} % 6 AS DOUBLE)"),
    ("Existing_EMI", f"CASE WHEN {_K} % 4 = 0 THEN CAST(0 AS DOUBLE) WHEN {_K} % 9 = 0 THEN NULL "
                     "ELSE CAST(o_totalprice / 100 AS DOUBLE) END"),
    ("age", f"CAST(CASE WHEN {_C} % 37 = 0 THEN NULL ELSE 18 + {_C} % 50 END AS INTEGER)"),
    ("Var4", f"CAST(1 + {_K} % 7 AS INTEGER)"),
    ("Var5", f"CAST(CASE WHEN {_K} % 13 = 0 THEN NULL ELSE {_K} % 60 END AS INTEGER)"),
    ("Source_0", f"CAST(CASE WHEN {_K} % 3 = 0 THEN 1 ELSE 0 END AS INTEGER)"),
    ("Source_1", f"CAST(CASE WHEN {_K} % 4 = 1 THEN 1 ELSE 0 END AS INTEGER)"),
    ("Source_2", f"CAST(CASE WHEN {_K} % 5 = 2 THEN 1 ELSE 0 END AS INTEGER)"),
]


def _fixture(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in columns])


def _fixture_sql(columns) -> str:
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in columns)
    return f"SELECT\n  {cols}\nFROM orders JOIN customer ON o_custkey = c_custkey"


def fixture_home_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, HOME_CREDIT_COLUMNS)


def fixture_indian_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, INDIAN_BANK_COLUMNS)


def fixture_home_credit_sql() -> str:
    return _fixture_sql(HOME_CREDIT_COLUMNS)


def fixture_indian_bank_sql() -> str:
    return _fixture_sql(INDIAN_BANK_COLUMNS)
