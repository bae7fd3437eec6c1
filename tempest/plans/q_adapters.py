"""Step 7 of the build plan: adapters of foreign portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.operators import adapters as A
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import _q, clip_sql
from tempest.session import run_folder
from tempest.sources import adapters as src


def _org_values() -> str:
    rows = ", ".join(f"({_q(o)}, {_q(s)})" for o, s in config.org_sector_rows())
    return f"SELECT * FROM (VALUES {rows}) AS t(organization_type, sector)"


def _ext_mean() -> str:
    ext = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
    s = " + ".join(f"coalesce({e}, 0.0)" for e in ext)
    n = " + ".join(f"CAST({e} IS NOT NULL AS INTEGER)" for e in ext)
    return f"(({s}) / CAST(NULLIF({n}, 0) AS DOUBLE))"


def _home_credit_sql() -> str:
    return f"""
WITH hc AS ({src.fixture_home_credit_sql()}),
org AS ({_org_values()}),
a AS (
  SELECT SK_ID_CURR AS loan_id, TARGET AS "default",
    CASE WHEN TARGET = 1 THEN 'Charged Off' WHEN TARGET = 0 THEN 'Fully Paid' END AS loan_status,
    AMT_INCOME_TOTAL AS annual_inc, AMT_CREDIT AS loan_amnt, coalesce(AMT_ANNUITY, 0.0) AS installment,
    CASE WHEN DAYS_EMPLOYED IS NULL THEN NULL WHEN DAYS_EMPLOYED > 0 THEN 0.0
         ELSE least(abs(DAYS_EMPLOYED) / 365.25, 40.0) END AS emp_length,
    coalesce({clip_sql(_ext_mean() + ' * 550.0 + 300.0', 300.0, 850.0)}, 580.0) AS fico_range_low,
    {clip_sql('coalesce(AMT_ANNUITY, 0.0) * 12.0 / (AMT_INCOME_TOTAL + 1.0) * 100.0', 0.0, 100.0)} AS dti,
    coalesce({clip_sql('AMT_CREDIT / (AMT_GOODS_PRICE + 1.0) - 1.0', 0.0, 0.5)} * 100.0, 12.0) AS int_rate,
    coalesce(o.sector, 'other') AS purpose,
    CASE REGION_RATING_CLIENT WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'FL' ELSE 'NY' END AS addr_state
  FROM hc LEFT JOIN org o ON hc.ORGANIZATION_TYPE = o.organization_type)
SELECT loan_id, "default", loan_status, {r('annual_inc', 2)} AS annual_inc, {r('loan_amnt', 2)} AS loan_amnt,
  {r('installment')} AS installment, {r('emp_length')} AS emp_length, {r('fico_range_low')} AS fico_range_low,
  {r('dti')} AS dti, {r('int_rate')} AS int_rate, purpose, addr_state
FROM a WHERE annual_inc IS NOT NULL AND loan_amnt IS NOT NULL AND fico_range_low IS NOT NULL AND dti IS NOT NULL"""


def _indian_bank_sql() -> str:
    var4 = " ".join(f"WHEN {k} THEN {v!r}" for k, v in config.VAR4_SCORE.items())
    return f"""
WITH ib AS ({src.fixture_indian_bank_sql()}),
m AS (SELECT median(Monthly_Income * 12.0) AS med FROM ib),
a AS (
  SELECT ID AS loan_id, 1 - Disbursed AS "default",
    CASE WHEN Disbursed = 0 THEN 'Charged Off' WHEN Disbursed = 1 THEN 'Fully Paid' END AS loan_status,
    Monthly_Income * 12.0 AS annual_inc, Loan_Amount_Applied AS loan_amnt,
    CASE WHEN Existing_EMI > 0 THEN Existing_EMI
         ELSE Loan_Amount_Applied / (Loan_Tenure_Applied * 12.0 + 1.0) END AS installment,
    coalesce({clip_sql('CAST(age AS DOUBLE) - 22.0', 0.0, 40.0)}, 5.0) AS emp_length,
    CAST(CASE Var4 {var4} ELSE {config.VAR4_DEFAULT_SCORE!r} END AS DOUBLE) AS fico_range_low,
    {clip_sql('Existing_EMI * 12.0 / (Monthly_Income * 12.0 + 1.0) * 100.0', 0.0, 100.0)} AS dti,
    coalesce({clip_sql('12.0 + CAST(Var5 AS DOUBLE) * 0.5', 5.0, 30.0)}, 12.0) AS int_rate,
    CASE WHEN Source_2 = 1 THEN 'debt_consolidation' WHEN Source_1 = 1 THEN 'home_improvement'
         ELSE 'small_business' END AS purpose,
    CASE WHEN Monthly_Income * 12.0 > med * 1.5 THEN 'Maharashtra' WHEN Monthly_Income * 12.0 > med THEN 'Tamil Nadu'
         WHEN Monthly_Income * 12.0 > med * 0.5 THEN 'Uttar Pradesh' ELSE 'Bihar' END AS addr_state
  FROM ib, m)
SELECT loan_id, "default", loan_status, {r('annual_inc', 2)} AS annual_inc, {r('loan_amnt', 2)} AS loan_amnt,
  {r('installment')} AS installment, {r('emp_length')} AS emp_length, {r('fico_range_low')} AS fico_range_low,
  {r('dti')} AS dti, {r('int_rate')} AS int_rate, purpose, addr_state
FROM a WHERE annual_inc IS NOT NULL AND loan_amnt IS NOT NULL"""


_MONEY = ("annual_inc", "loan_amnt")


@register("adapt_home_credit", _home_credit_sql, "S4 P20 P21 P22 P23 P24 P25 P26 P27 J8 J9")
def adapt_home_credit_q(spark, sf_dir):
    """Home-credit style applications adapted to the loan schema."""
    return finish(A.adapt_home_credit(src.fixture_home_credit(spark, sf_dir)), money=_MONEY)


@register("adapt_indian_bank", _indian_bank_sql, "S5 P28 P29 P30 P31 P32 P33 P34 J10")
def adapt_indian_bank_q(spark, sf_dir):
    """Indian-bank style applications adapted to the loan schema."""
    return finish(A.adapt_indian_bank(src.fixture_indian_bank(spark, sf_dir)), money=_MONEY)


def _retention_sql() -> str:
    def part(name, fixture_sql, body_sql):
        return f"""SELECT '{name}' AS dataset, (SELECT count(*) FROM ({fixture_sql})) AS n_input,
  count(*) AS n_kept, {r(f'count(*) / (SELECT count(*) FROM ({fixture_sql})) * 100.0')} AS retained_pct,
  {r('avg("default")')} AS default_rate FROM ({body_sql})"""
    return (part("home_credit", src.fixture_home_credit_sql(), _home_credit_sql()) + "\nUNION ALL\n"
            + part("indian_bank", src.fixture_indian_bank_sql(), _indian_bank_sql()))


def _registry_sql() -> str:
    part = lambda key, body: f"""SELECT '{key}' AS dataset, loan_id, "default", annual_inc, loan_amnt, addr_state FROM ({body})"""
    return part("home_credit", _home_credit_sql()) + "\nUNION ALL\n" + part("indian_bank", _indian_bank_sql())


@register("dataset_registry", _registry_sql, "S3 S4 S5")
def dataset_registry(spark, sf_dir):
    """Both foreign portfolios written as CSV files in their own layouts and loaded by their registry keys."""
    run = run_folder(spark, "datasets")
    out = None
    for key, raw in (("home_credit", src.fixture_home_credit(spark, sf_dir)), ("indian_bank", src.fixture_indian_bank(spark, sf_dir))):
        raw.write.option("header", True).csv(f"{run}/{key}")
        df = A.load_dataset(spark, key, f"{run}/{key}").select(
            F.lit(key).alias("dataset"), "loan_id", "default", "annual_inc", "loan_amnt", "addr_state")
        out = df if out is None else out.unionByName(df)
    return finish(out, money=_MONEY)


@register("adapter_retention", _retention_sql, "P27 O1")
def adapter_retention(spark, sf_dir):
    """Rows in, rows kept, retained share and default rate per adapted dataset."""
    hc_raw, ib_raw = src.fixture_home_credit(spark, sf_dir), src.fixture_indian_bank(spark, sf_dir)
    hc = A.retention(hc_raw, A.adapt_home_credit(hc_raw), "home_credit")
    ib = A.retention(ib_raw, A.adapt_indian_bank(ib_raw), "indian_bank")
    return finish(hc.unionByName(ib))
