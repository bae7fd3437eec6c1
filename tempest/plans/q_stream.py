"""Step 10 of the build plan: streaming jobs (Q1, Q2).

Each query runs its Structured Streaming job over the whole events file with
the ``availableNow`` trigger, writing under the session's checkpoint folder,
and returns the written result as a DataFrame.  The scoring stream is
stateless, so its result must equal the batch SQL over the same rows: that
is its oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.operators import drift
from tempest.operators.scoring import SCORECARD_INTERCEPT, SCORECARD_WEIGHTS
from tempest.plans import base
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import cpd_sql, sectors_values, states_values, strip_sql, tier_sql, with_base
from tempest.session import materialise, run_folder
from tempest.sources import requests as RQ
from tempest.streaming import jobs

OUT_COLS = ["request_id", "dti", "annual_inc", "fico_range_low", "int_rate", "installment", "loan_amnt",
            "emp_length", "addr_state", "purpose", "Baseline_PD", "CPD", "PD_Uplift_Pct", "Risk_Category",
            "Expected_Loss", "scenario", "carbon_price", "lgd_assumption"]


def _run_dir(spark, kind):
    return run_folder(spark, f"stream-{kind}")


# The rules of a request, written out: what breaks one.
BAD_REQUEST = [
    "dti < 0 OR dti > 100", "annual_inc <= 0", "fico_range_low < 300 OR fico_range_low > 850", "int_rate < 0 OR int_rate > 40",
    "installment <= 0", "emp_length < 0 OR emp_length > 10", "loan_amnt <= 0", "revol_util < 0", "revol_bal < 0", "open_acc < 0",
    "total_acc < 0", "pub_rec < 0", "delinq_2yrs < 0", "inq_last_6mths < 0", "acc_open_past_24mths < 0", "mort_acc < 0",
    "total_bc_limit < 0", "total_rev_hi_lim < 0", "mo_sin_rcnt_tl < 0", "mo_sin_old_rev_tl_op < 0", "num_actv_rev_tl < 0",
    "percent_bc_gt_75 < 0 OR percent_bc_gt_75 > 100", "bc_util < 0", "mths_since_recent_inq < 0",
    "severity_factor < 0 OR severity_factor > 1", "transition_scaling < 0 OR transition_scaling > 1",
    "scenario NOT IN ('orderly', 'disorderly', 'hot_house', 'too_little_too_late')",
]


def _stream_score_sql() -> str:
    z = f"CAST({SCORECARD_INTERCEPT} AS DOUBLE)" + "".join(
        f" + CAST({w} AS DOUBLE) * ({f} - CAST({c} AS DOUBLE))" for f, c, w in SCORECARD_WEIGHTS)
    checks = " AND ".join(f"NOT coalesce({b}, false)" for b in BAD_REQUEST)
    required = " AND ".join(f"{c} IS NOT NULL" for c in jobs.REQUIRED)
    prices = " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.CARBON_PRICES.items())
    return f"""
WITH req AS ({RQ.requests_sql()}),
states AS ({states_values()}),
sectors AS ({sectors_values()}),
ok AS (SELECT * FROM req WHERE {required} AND {checks}),
d AS (SELECT request_id, dti, annual_inc, fico_range_low, int_rate, installment,
        coalesce(loan_amnt, 10000.0) AS loan_amnt, coalesce(emp_length, 3.0) AS emp_length, addr_state, purpose,
        coalesce(scenario, 'orderly') AS scenario,
        CAST(CASE scenario {prices} ELSE 100.0 END AS DOUBLE) AS carbon_price,
        coalesce(severity_factor, {config.SEVERITY_FACTOR}) AS sev, coalesce(transition_scaling, {config.TRANSITION_SCALING}) AS tscale,
        1.0 / (1.0 + exp(-({z}))) AS Baseline_PD FROM ok),
l AS (SELECT d.*, coalesce(s.physical_risk, 0.45) AS hazard, coalesce(k.emission_intensity, 0.25) AS emission_intensity
      FROM d LEFT JOIN states s ON {strip_sql('d.addr_state')} = s.state_key
      LEFT JOIN sectors k ON replace(lower(d.purpose), ' ', '_') = k.sector_key),
c AS (SELECT l.*, {cpd_sql('sev', price='carbon_price', scaling='tscale')} AS CPD FROM l)
SELECT request_id, {r('dti')} AS dti, {r('annual_inc', 2)} AS annual_inc, {r('fico_range_low')} AS fico_range_low,
  {r('int_rate')} AS int_rate, {r('installment')} AS installment, {r('loan_amnt', 2)} AS loan_amnt,
  {r('emp_length')} AS emp_length, addr_state, purpose,
  {r('Baseline_PD')} AS Baseline_PD, {r('CPD')} AS CPD, {r('(CPD - Baseline_PD) / (Baseline_PD + 1e-8) * 100', 2)} AS PD_Uplift_Pct,
  {tier_sql('CPD')} AS Risk_Category, {r('CPD * 0.45 * loan_amnt', 2)} AS Expected_Loss,
  scenario, carbon_price, CAST({config.DEFAULT_LGD} AS DOUBLE) AS lgd_assumption
FROM c"""


@register("stream_score", _stream_score_sql, "Q1 F2 F3 F4 J11 R8 S8")
def stream_score(spark, sf_dir):
    """Loan requests from the events stream, validated, scored each under its own scenario and written; the written rows."""
    out = _run_dir(spark, "score")
    jobs.stream_score(spark, RQ.request_stream(spark, sf_dir), out)
    return finish(spark.read.parquet(f"{out}/scored").select(*OUT_COLS), money=("annual_inc", "loan_amnt"))


@register("stream_rejects", lambda: f"""
WITH req AS ({RQ.requests_sql()})
SELECT request_id, CAST(count(*) AS BIGINT) AS n_reasons FROM (
  SELECT request_id, unnest([{", ".join(f"CASE WHEN {b} THEN 1 END" for b in BAD_REQUEST)}]) AS bad FROM req)
WHERE bad IS NOT NULL GROUP BY request_id""",
          "Q1 F3 F4 J11")
def stream_rejects(spark, sf_dir):
    """Requests the stream rejected, with the number of failed rules (ranges, unknown scenario)."""
    out = _run_dir(spark, "score")
    jobs.stream_reject(spark, RQ.request_stream(spark, sf_dir), out)
    return spark.read.parquet(f"{out}/rejected").select(
        "request_id", F.size("reject_reasons").cast("long").alias("n_reasons"))


def _stream_drift_sql() -> str:
    """Written out: reference values of the stored statistics, their deciles as edges, counts per day and bin."""
    from tempest.plans.q_drift import stats_sql

    feats = ", ".join(f"'{f}'" for f in jobs.DRIFT_FEATURES)
    probs = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"
    values = {"dti": "dti", "annual_inc": "annual_inc", "fico_range_low": "fico_range_low", "int_rate": "int_rate",
              "installment": "installment", "loan_amnt": "amt", "emp_length": "coalesce(emp_length, 3.0)",
              "income_to_installment": "annual_inc / (installment * 12 + 1)", "loan_to_income": "amt / (annual_inc + 1)",
              "monthly_payment_burden": "installment / (annual_inc / 12 + 1)"}
    rows = " UNION ALL ".join(f"SELECT day, '{f}' AS feature, CAST({v} AS DOUBLE) AS value FROM rq" for f, v in values.items())
    return with_base(f"""WITH {stats_sql("true")},
ref AS (SELECT feature, unnest(list_concat(list_concat(list_concat(list_transform(range(6), lambda x: min), list_transform(range(12), lambda x: p10)),
          list_concat(list_transform(range(18), lambda x: p25), list_transform(range(25), lambda x: p50))), list_concat(list_concat(list_transform(range(18), lambda x: p75), list_transform(range(12), lambda x: p90)),
          list_transform(range(6), lambda x: max)))) AS value FROM stats WHERE feature IN ({feats})),
e0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {probs}))) AS e, count(*) AS n_ref FROM ref GROUP BY feature),
edg AS (SELECT feature, n_ref, [e[1] - 1e-8] || e[2:len(e) - 1] || [e[len(e)] + 1e-8] AS edges FROM e0 WHERE len(e) >= 2),
rq AS (SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, *, coalesce(loan_amnt, 10000.0) AS amt FROM ({RQ.requests_sql()})),
act AS (SELECT * FROM ({rows}) WHERE value IS NOT NULL AND NOT isnan(value)),
both_rows AS (SELECT 'ref' AS day, feature, value FROM ref UNION ALL SELECT day, feature, value FROM act),
b AS (SELECT day, feature, CASE WHEN value >= edges[1] AND value <= edges[len(edges)]
              THEN least(len(list_filter(edges, lambda t: t <= value)) - 1, len(edges) - 2) ELSE -1 END AS bin
      FROM both_rows JOIN edg USING (feature)),
c AS (SELECT day, feature, bin, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT day, feature, sum(n) AS total FROM c GROUP BY ALL),
grid AS (SELECT day, feature, total, unnest(range(0, len(edges) - 1)) AS bin FROM t JOIN edg USING (feature)),
share AS (SELECT g.day, g.feature, g.bin, CASE WHEN coalesce(n, 0) = 0 THEN 1e-4 ELSE n / total END AS s
          FROM grid g LEFT JOIN c ON c.day = g.day AND c.feature = g.feature AND c.bin = g.bin),
p AS (SELECT a.day, a.feature, sum((a.s - e.s) * ln(a.s / e.s)) AS psi FROM share a
      JOIN share e ON e.day = 'ref' AND e.feature = a.feature AND e.bin = a.bin WHERE a.day <> 'ref' GROUP BY ALL)
SELECT day, feature, {r('psi', 5)} AS psi,
  CASE WHEN psi >= 0.25 THEN 'DRIFT' WHEN psi >= 0.10 THEN 'MODERATE' ELSE 'OK' END AS status FROM p""")


@register("stream_drift", _stream_drift_sql, "Q2 R16 R17")
def stream_drift(spark, sf_dir):
    """PSI per day and feature of the request stream against the loans' training statistics: closed windows and open ones."""
    out = _run_dir(spark, "drift")
    # the statistics are a small stored table
    stats = materialise(drift.feature_stats(drift.long_form(base.clean(spark, sf_dir), jobs.DRIFT_FEATURES)), out, "stats")
    jobs.stream_drift(spark, RQ.request_stream(spark, sf_dir), stats, out)
    psi = jobs.read_drift(spark, out)
    return finish(psi.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "feature", "psi", "status"), digits=5)
