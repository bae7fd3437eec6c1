"""Shared SQL text for the DuckDB oracle.

The oracle is an independent, plain-SQL statement of each query over the
same parquet tables.  This module holds the common CTEs: the fixture loan
rows, the dimension tables (from the fixed values), the cleaned loan table
and the scored portfolio.
"""

from __future__ import annotations

from tempest import config
from tempest.operators import scoring
from tempest.sources.loans import fixture_loans_sql


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _num(x) -> str:
    return "NULL" if x is None else f"CAST({float(x)!r} AS DOUBLE)"


def states_values() -> str:
    rows = ", ".join(
        f"({_q(k)}, {_num(r)}, {_num(lat)}, {_num(lon)}, {_num(c)}, {_num(e)}, {_q(ctry)})"
        for k, r, lat, lon, c, e, ctry in config.state_rows()
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(state_key, physical_risk, lat, lon, coast_km, elev_m, country)"


def sectors_values() -> str:
    rows = ", ".join(f"({_q(k)}, {_num(i)}, {_num(e)})" for k, i, e in config.sector_rows())
    return f"SELECT * FROM (VALUES {rows}) AS t(sector_key, emission_intensity, policy_exposure)"


def scenarios_values() -> str:
    rows = ", ".join(f"({_q(k)}, {_num(v)}, {i})" for i, (k, v) in enumerate(config.CARBON_PRICES.items()))
    return f"SELECT * FROM (VALUES {rows}) AS t(scenario, carbon_price, scenario_order)"


def severities_values() -> str:
    rows = ", ".join(f"({_q(lab)}, {_num(v)}, {i})" for i, (lab, v) in enumerate(config.SEVERITY_LEVELS))
    return f"SELECT * FROM (VALUES {rows}) AS t(severity_label, severity, severity_order)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tod(x: str) -> str:
    """TRY_CAST to double, NaN to NULL."""
    return f"(CASE WHEN isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


def tier_sql(x: str) -> str:
    return (f"(CASE WHEN {x} >= 0 AND {x} <= 0.05 THEN 'Low' WHEN {x} > 0.05 AND {x} <= 0.15 THEN 'Medium' "
            f"WHEN {x} > 0.15 AND {x} <= 0.30 THEN 'High' WHEN {x} > 0.30 AND {x} <= 1.0 THEN 'Critical' END)")


def bin_sql(x: str, edges) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{x} >= {lo} AND {x} <= {hi}" if i == 0 else f"{x} > {lo} AND {x} <= {hi}"
        parts.append(f"WHEN {cond} THEN CAST({float(i)} AS DOUBLE)")
    return "(CASE " + " ".join(parts) + " END)"


def clip_sql(x: str, lo=None, hi=None) -> str:
    y = x
    if lo is not None:
        y = f"greatest({y}, {lo})"
    if hi is not None:
        y = f"least({y}, {hi})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {y} END)"


def div_sql(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


TYPED_SQL = f"""
SELECT loan_id, issue_d,
  CASE WHEN loan_status IN ('Charged Off', 'Default', 'Late (31-120 days)') THEN 1 ELSE 0 END AS "default",
  loan_status,
  {tod('loan_amnt')} AS loan_amnt,
  {tod('dti')} AS dti,
  {tod('annual_inc')} AS annual_inc,
  {tod('fico_range_low')} AS fico_range_low,
  {tod("replace(CAST(int_rate AS VARCHAR), '%', '')")} AS int_rate,
  {tod('installment')} AS installment,
  coalesce(TRY_CAST(NULLIF(regexp_extract(CAST(emp_length AS VARCHAR), '(\\d+)', 1), '') AS DOUBLE), 0.0) AS emp_length,
  home_ownership, purpose, addr_state,
  coalesce({tod("replace(CAST(revol_util AS VARCHAR), '%', '')")}, 0.0) AS revol_util,
  coalesce(TRY_CAST(NULLIF(regexp_extract(CAST(term AS VARCHAR), '(\\d+)', 1), '') AS DOUBLE), 36.0) AS term_months,
  CASE WHEN regexp_full_match(sub_grade, '[A-G][1-5]')
       THEN CAST((ascii(substr(sub_grade, 1, 1)) - 65) * 5 + CAST(substr(sub_grade, 2, 1) AS INTEGER) AS DOUBLE)
       ELSE 18.0 END AS sub_grade_num,
  CASE verification_status WHEN 'Not Verified' THEN 0.0 WHEN 'Source Verified' THEN 1.0
       WHEN 'Verified' THEN 2.0 ELSE 0.0 END AS verification_num,
  coalesce(CAST(date_diff('day', CAST(try_strptime(earliest_cr_line, '%b-%Y') AS DATE), DATE '2018-01-01') AS DOUBLE) / 30.44, 180.0)
      AS credit_history_months,
  {", ".join(f"coalesce({tod(c)}, 0.0) AS {c}" for c in ["revol_bal", "open_acc", "total_acc", "pub_rec", "delinq_2yrs", "inq_last_6mths"] + config.BUREAU_COLS)}
FROM raw
"""

ENGINEERED_SQL = ",\n  ".join([
    f"{div_sql('annual_inc', 'installment * 12 + 1')} AS income_to_installment",
    f"{div_sql('loan_amnt', 'annual_inc + 1')} AS loan_to_income",
    f"{bin_sql('dti', config.DTI_BINS)} AS dti_bucket",
    f"{bin_sql('fico_range_low', config.FICO_BINS)} AS fico_bucket",
    f"{div_sql('installment', 'annual_inc / 12 + 1')} AS monthly_payment_burden",
    f"{div_sql('revol_bal', 'annual_inc + 1')} AS credit_utilization_ratio",
    f"{div_sql('open_acc', 'total_acc + 1')} AS open_to_total_acc",
    f"{div_sql('total_bc_limit', 'annual_inc + 1')} AS bc_limit_to_income",
    f"{div_sql('total_rev_hi_lim', 'annual_inc + 1')} AS rev_limit_to_income",
    f"{div_sql('acc_open_past_24mths', 'total_acc + 1')} AS recent_accts_ratio",
])

CLEAN_SQL = f"""
SELECT *, {ENGINEERED_SQL}
FROM typed
WHERE dti IS NOT NULL AND annual_inc IS NOT NULL AND fico_range_low IS NOT NULL
"""


def _scorecard_sql(weights=None, intercept=None) -> str:
    weights = scoring.SCORECARD_WEIGHTS if weights is None else weights
    intercept = scoring.SCORECARD_INTERCEPT if intercept is None else intercept
    z = f"CAST({intercept} AS DOUBLE)"
    for f, centre, w in weights:
        z += f" + CAST({w} AS DOUBLE) * (coalesce({f}, med_{f}) - CAST({centre} AS DOUBLE))"
    return f"1.0 / (1.0 + exp(-({z})))"


PD_SQL = f"""
SELECT clean.*, {_scorecard_sql()} AS Baseline_PD
FROM clean, (SELECT {", ".join(f"median({f}) AS med_{f}" for f, _, _ in scoring.SCORECARD_WEIGHTS)} FROM clean) med
"""

# Hazard (static) and intensity per loan, before any scenario.
LOOKUP_SQL = f"""
SELECT p.*,
  coalesce(s.physical_risk, 0.45) AS hazard,
  coalesce(k.emission_intensity, 0.25) AS emission_intensity,
  coalesce(k.policy_exposure, 0.20) AS policy_exposure
FROM pd p
LEFT JOIN states s ON {strip_sql('p.addr_state')} = s.state_key
LEFT JOIN sectors k ON replace(lower(p.purpose), ' ', '_') = k.sector_key
"""


def phys_sql(pd: str, hazard: str, severity: str) -> str:
    return clip_sql(f"{pd} * (1 + {hazard} * {severity})", 0, 1)


def trans_sql(pdp: str, intensity: str, income: str, price: str, scaling: str = "0.4") -> str:
    ratio = clip_sql(f"{intensity} * {price} / ({income} / 1000.0 + 1e-6)", 0, 0.5)
    return clip_sql(f"{pdp} * (1 + {ratio} * {scaling})", 0, 1)


def cpd_sql(severity: str = "0.3", price: str = "100.0", pd: str = "Baseline_PD", scaling: str = "0.4") -> str:
    return trans_sql(phys_sql(pd, "hazard", severity), "emission_intensity", "annual_inc", price, scaling)


def scored_sql(severity: str = "0.3", price: str = "100.0") -> str:
    return f"""
SELECT l.*, {cpd_sql(severity, price)} AS CPD
FROM lookup l
"""


FINAL_SQL = f"""
SELECT c.*,
  (CPD - Baseline_PD) / (Baseline_PD + 1e-8) * 100 AS PD_Uplift_Pct,
  {tier_sql('CPD')} AS Risk_Category,
  loan_amnt AS EAD,
  CPD * 0.45 * loan_amnt AS Expected_Loss
FROM cpd c
"""


def with_base(body: str, scenario_price: float = 100.0, severity: float = 0.3) -> str:
    """Prefix a query body with the CTE chain up to ``portfolio`` (scored, one scenario).

    A body that starts with ``WITH`` has its CTEs appended to the chain.
    """
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        body = ",\n" + stripped[4:]
    return f"""WITH raw AS ({fixture_loans_sql()}),
states AS ({states_values()}),
sectors AS ({sectors_values()}),
scenarios AS ({scenarios_values()}),
severities AS ({severities_values()}),
typed AS ({TYPED_SQL}),
clean AS ({CLEAN_SQL}),
pd AS ({PD_SQL}),
lookup AS ({LOOKUP_SQL}),
cpd AS ({scored_sql(repr(float(severity)), repr(float(scenario_price)))}),
portfolio AS ({FINAL_SQL}){body if body.startswith(",") else chr(10) + body}"""


def labels_sql() -> str:
    """CTE body of the scored labels (id, label, p_a, p_b); needs the ``pd`` CTE of ``with_base``."""
    from tempest.plans import base
    from tempest.plans.catalog import r
    meds = ", ".join(f"median({f}) AS med_{f}" for f, _, _ in base.SECOND_WEIGHTS)
    return f"""SELECT loan_id AS id, "default" AS label, {r('Baseline_PD', 3)} AS p_a,
  {r(_scorecard_sql(base.SECOND_WEIGHTS, base.SECOND_INTERCEPT), 3)} AS p_b
FROM pd, (SELECT {meds} FROM clean) med"""


def with_labels(body: str) -> str:
    """``with_base`` plus the ``labels`` CTE; ``body`` may start with its own ``WITH``."""
    stripped = body.lstrip()
    extra = ""
    if stripped[:4].upper() == "WITH":
        extra = ",\n" + stripped[4:]
        stripped = ""
    return with_base(f"WITH labels AS ({labels_sql()}){extra}\n{stripped}")
