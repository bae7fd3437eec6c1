"""Step 4 of the build plan: scenario grids, stress test, projection, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.operators import scenarios as S
from tempest.plans import base
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import cpd_sql, tier_sql, with_base


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


def _grid_sql(severities: bool) -> str:
    sev = "sv.severity" if severities else "0.3"
    join = "CROSS JOIN severities sv" if severities else ""
    return f"""grid AS (
  SELECT l.loan_id, l.Baseline_PD, sc.scenario, sc.scenario_order, sc.carbon_price
         {', sv.severity_label, sv.severity, sv.severity_order' if severities else ''},
         {cpd_sql(sev, 'sc.carbon_price')} AS CPD
  FROM lookup l CROSS JOIN scenarios sc {join}),
grid2 AS (SELECT *, (CPD - Baseline_PD) / (Baseline_PD + 1e-8) * 100 AS PD_Uplift_Pct,
                 {tier_sql('CPD')} AS Risk_Category FROM grid)"""


def _inputs(spark, sf_dir):
    return S.overlay_inputs(base.with_pd(spark, sf_dir))


@register("scenario_compare", lambda: with_base(f"""WITH {_grid_sql(False)}
SELECT scenario, scenario_order, carbon_price, {r('avg(CPD)')} AS avg_cpd,
  {r('avg(PD_Uplift_Pct)')} AS avg_uplift_pct,
  CAST(count_if(Risk_Category IN ('High', 'Critical')) AS BIGINT) AS high_critical,
  {title_sql('scenario')} AS scenario_label
FROM grid2 GROUP BY scenario, scenario_order, carbon_price"""), "R12 J12 P36")
def scenario_compare(spark, sf_dir):
    return finish(S.scenario_compare(_inputs(spark, sf_dir)))


@register("cpd_stats_by_scenario", lambda: with_base(f"""WITH {_grid_sql(False)}
SELECT scenario, {r('avg(CPD)')} AS mean_cpd, {r('stddev_pop(CPD)')} AS std_cpd, {r('max(CPD)')} AS max_cpd
FROM grid2 GROUP BY scenario"""), "A22")
def cpd_stats_by_scenario(spark, sf_dir):
    return finish(S.cpd_stats_by_scenario(_inputs(spark, sf_dir)))


def _stress_sql() -> str:
    return f"""WITH {_grid_sql(True)},
m AS (SELECT scenario, scenario_order, carbon_price, severity_label, severity, severity_order,
        avg(CPD) AS avg_cpd, avg(PD_Uplift_Pct) AS avg_uplift_pct,
        CAST(count_if(Risk_Category IN ('High', 'Critical')) AS BIGINT) AS high_critical, count(*) AS n
      FROM grid2 GROUP BY ALL)"""


@register("stress_matrix", lambda: with_base(f"""{_stress_sql()}
SELECT scenario, scenario_order, carbon_price, severity_label, severity, severity_order,
  {r('avg_cpd')} AS avg_cpd, {r('avg_uplift_pct')} AS avg_uplift_pct, high_critical, n,
  {r('high_critical / n * 100.0')} AS high_critical_pct, {title_sql('scenario')} AS scenario_label
FROM m"""), "R13 J13")
def stress_matrix(spark, sf_dir):
    return finish(S.stress_matrix(_inputs(spark, sf_dir)))


def _pivot_sql(value: str) -> str:
    cols = ", ".join(
        f"{r(f'max(CASE WHEN severity_label = {lab!r} THEN {value} END)')} AS \"{lab}\""
        for lab in ["Low (0.15)", "Medium (0.30)", "High (0.45)"])
    return f"""{_stress_sql()}
SELECT {title_sql('scenario')} AS scenario_label, {cols}
FROM (SELECT *, high_critical / n * 100.0 AS high_critical_pct FROM m) GROUP BY scenario"""


@register("stress_pivot_cpd", lambda: with_base(_pivot_sql("avg_cpd")), "R14 O3")
def stress_pivot_cpd(spark, sf_dir):
    return finish(S.stress_pivot(S.stress_matrix(_inputs(spark, sf_dir)), "avg_cpd"))


@register("stress_pivot_high", lambda: with_base(_pivot_sql("high_critical_pct")), "R14 O3")
def stress_pivot_high(spark, sf_dir):
    return finish(S.stress_pivot(S.stress_matrix(_inputs(spark, sf_dir)), "high_critical_pct"))


@register("projection", lambda: with_base(f"""WITH {_grid_sql(False)},
per AS (SELECT scenario, carbon_price, avg(Baseline_PD) AS avg_baseline, avg(CPD) AS avg_cpd_full
        FROM grid2 GROUP BY scenario, carbon_price),
yr AS (SELECT per.*, y.year,
         CASE WHEN y.year <= 2030 THEN 5.0 + (carbon_price - 5.0) * (CAST(y.year - 2025 AS DOUBLE) / 5)
              ELSE carbon_price END AS carbon_price_year
       FROM per CROSS JOIN (SELECT CAST(range AS INTEGER) AS year FROM range(2025, 2051)) y)
SELECT scenario, {title_sql('scenario')} AS scenario_label, year, {r('carbon_price_year')} AS carbon_price_year,
  {r('avg_baseline + (avg_cpd_full - avg_baseline) * carbon_price_year / (carbon_price + 1e-8)')} AS avg_cpd
FROM yr"""), "R15 J14")
def projection(spark, sf_dir):
    return finish(S.projection(_inputs(spark, sf_dir)))


@register("ablation", lambda: with_base(f"""
SELECT {r('avg(Baseline_PD)')} AS mean_baseline,
  {r('avg(least(greatest(Baseline_PD * (1 + hazard * 0.3), 0), 1))')} AS mean_physical,
  {r('avg(least(greatest(Baseline_PD * (1 + least(greatest(emission_intensity * 100.0 / (annual_inc / 1000.0 + 1e-6), 0), 0.5) * 0.4), 0), 1))')} AS mean_transition,
  {r('avg(CPD)')} AS mean_both,
  {r('(avg(CPD) - avg(Baseline_PD)) - ((avg(least(greatest(Baseline_PD * (1 + hazard * 0.3), 0), 1)) - avg(Baseline_PD)) + (avg(least(greatest(Baseline_PD * (1 + least(greatest(emission_intensity * 100.0 / (annual_inc / 1000.0 + 1e-6), 0), 0.5) * 0.4), 0), 1)) - avg(Baseline_PD)))')} AS interaction
FROM portfolio"""), "R20")
def ablation(spark, sf_dir):
    return finish(S.ablation(_inputs(spark, sf_dir)))


def _proxy_sql() -> str:
    changed = cpd_sql().replace("emission_intensity", "factor")
    m = float(S.DRAW_MODULUS)
    steps, last = "", "g"
    for name, text in S.draw_steps("loan_id", "run", config.RANDOM_STATE):
        steps += f"{name}_t AS (SELECT *, {text} AS {name} FROM {last}),\n"
        last = f"{name}_t"
    return f"""WITH f AS (SELECT unnest(list_sort(list_distinct(list(emission_intensity)))) AS factor FROM lookup),
k AS (SELECT factor, row_number() OVER (ORDER BY factor) - 1 AS k, count(*) OVER () AS n FROM f),
c AS (SELECT loan_id, k, n, abs({changed} - {cpd_sql()}) AS change FROM lookup CROSS JOIN k),
g AS (SELECT loan_id, percent, (percent // 10 - 1) * 100 + trial AS run FROM lookup
      CROSS JOIN (SELECT unnest([10, 20, 30]) AS percent) p CROSS JOIN (SELECT CAST(unnest(range(100)) AS BIGINT) AS trial) t),
{steps}d AS (SELECT x5_t.*, c.change FROM x5_t JOIN (SELECT max(n) AS n FROM k) z ON true
      JOIN c ON c.loan_id = x5_t.loan_id AND c.k = CAST(floor(x5 * z.n / {m!r}) AS BIGINT)),
m AS (SELECT percent, run, avg(CASE WHEN x3 < percent / 100.0 * {m!r} THEN change WHEN change IS NULL THEN NULL ELSE 0.0 END) AS mae
      FROM d GROUP BY percent, run)
SELECT percent / 100.0 AS rate, {r('avg(mae)')} AS mean_abs_cpd_change, {r('stddev_pop(mae)')} AS std_abs_cpd_change
FROM m GROUP BY percent"""


@register("proxy_sensitivity", lambda: with_base(_proxy_sql()), "R19")
def proxy_sensitivity(spark, sf_dir):
    """Random replacement of transition factors, by draws that any engine can repeat."""
    return finish(S.proxy_sensitivity(_inputs(spark, sf_dir)))
