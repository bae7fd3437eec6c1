"""Steps 1 and 3 of the build plan: overlay core and portfolio aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import overlay, portfolio as P
from tempest.plans import base
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import strip_sql, tier_sql, with_base
from tempest.sources.loans import fixture_loans

HC = "CAST(count_if(Risk_Category IN ('High', 'Critical')) AS BIGINT)"


# --------------------------------------------------------------------------
# Step 1: overlay core (loan level) and the minimum slice
# --------------------------------------------------------------------------
def _cpd_by_state_sql():
    return with_base(f"""
SELECT state, count(*) AS loan_count,
  {r('avg(Baseline_PD)')} AS avg_baseline_pd, {r('avg(CPD)')} AS avg_cpd,
  {r('avg(PD_Uplift_Pct)')} AS avg_uplift_pct, {r('sum(Expected_Loss)', 2)} AS total_expected_loss,
  {HC} AS high_critical
FROM (SELECT *, {strip_sql('addr_state')} AS state FROM portfolio) WHERE state IS NOT NULL
GROUP BY state ORDER BY avg_cpd DESC""")


@register("cpd_by_state", _cpd_by_state_sql, "R8 R9 R10 R11 J1 J3 R5 R6 A4 T1 S7")
def cpd_by_state(spark, sf_dir):
    """Minimum slice: scored portfolio (static hazard, orderly) aggregated by state."""
    scored = base.portfolio(spark, sf_dir)
    out = (
        scored.withColumn("state", C.strip_key("addr_state")).where(F.col("state").isNotNull())
        .groupBy("state").agg(
            F.count(F.lit(1)).alias("loan_count"),
            F.avg("Baseline_PD").alias("avg_baseline_pd"),
            F.avg("CPD").alias("avg_cpd"),
            F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
            F.sum("Expected_Loss").alias("total_expected_loss"),
            F.count_if(C.is_high_or_critical("Risk_Category")).alias("high_critical"),
        )
        .orderBy(F.col("avg_cpd").desc())
    )
    return finish(out, money=("total_expected_loss",))


@register("physical_static", lambda: with_base(f"""
SELECT loan_id, {r('hazard')} AS hazard,
  {r('least(greatest(Baseline_PD * (1 + hazard * 0.3), 0), 1)')} AS pd_physical
FROM portfolio"""), "R3 R5 J1 P15 P16")
def physical_static(spark, sf_dir):
    """Static hazard per loan and the physically adjusted PD."""
    df = overlay.with_static_hazard(base.with_pd(spark, sf_dir))
    return finish(df.select("loan_id", "hazard",
                            overlay.physical_pd("Baseline_PD", "hazard").alias("pd_physical")))


@register("transition_orderly", lambda: with_base(f"""
SELECT loan_id, {r('emission_intensity')} AS emission_intensity,
  {r('least(greatest(emission_intensity * 100.0 / (annual_inc / 1000.0 + 1e-6), 0), 0.5)')} AS carbon_cost_ratio,
  {r('least(greatest(Baseline_PD * (1 + least(greatest(emission_intensity * 100.0 / (annual_inc / 1000.0 + 1e-6), 0), 0.5) * 0.4), 0), 1)')} AS pd_transition
FROM portfolio"""), "R6 J3 J11 P14 P16")
def transition_orderly(spark, sf_dir):
    """Transition overlay alone (orderly scenario) on the baseline PD."""
    df = overlay.with_sector_lookup(base.with_pd(spark, sf_dir))
    ratio = C.clip(F.col("emission_intensity") * 100.0 / (F.col("annual_inc") / 1000.0 + 1e-6), 0.0, 0.5)
    return finish(df.select(
        "loan_id", "emission_intensity", ratio.alias("carbon_cost_ratio"),
        overlay.transition_pd("Baseline_PD", "emission_intensity", "annual_inc", 100.0).alias("pd_transition")))


@register("cpd_scored", lambda: with_base(f"""
SELECT loan_id, {r('Baseline_PD')} AS Baseline_PD, {r('CPD')} AS CPD, {r('PD_Uplift_Pct')} AS PD_Uplift_Pct,
  Risk_Category, {r('Expected_Loss', 2)} AS Expected_Loss
FROM portfolio"""), "R8 R9 R10 R11")
def cpd_scored(spark, sf_dir):
    df = base.portfolio(spark, sf_dir)
    return finish(df.select("loan_id", "Baseline_PD", "CPD", "PD_Uplift_Pct", "Risk_Category",
                            "Expected_Loss"), money=("Expected_Loss",))


# --------------------------------------------------------------------------
# Step 3: portfolio aggregates, top-k
# --------------------------------------------------------------------------
@register("portfolio_summary", lambda: with_base(f"""
SELECT (SELECT count(*) FROM raw) AS n_input, count(*) AS n_scored,
  {r('avg(Baseline_PD)')} AS avg_baseline_pd, {r('avg(CPD)')} AS avg_cpd,
  {r('avg(PD_Uplift_Pct)')} AS avg_uplift_pct, {r('sum(Expected_Loss)', 2)} AS total_expected_loss
FROM portfolio"""), "A1 F1")
def portfolio_summary(spark, sf_dir):
    n_input = fixture_loans(spark, sf_dir).select(F.count(F.lit(1))).scalar()
    return finish(P.batch_summary(base.portfolio(spark, sf_dir), n_input),
                  money=("total_expected_loss",))


@register("overview", lambda: with_base(f"""
SELECT {r('avg(Baseline_PD)')} AS avg_baseline_pd, {r('avg(CPD)')} AS avg_cpd,
  {r('avg(PD_Uplift_Pct)')} AS avg_uplift_pct, {r('avg(CPD - Baseline_PD)')} AS avg_pd_increase,
  {HC} AS high_critical
FROM portfolio"""), "A2 A25 F5")
def overview_q(spark, sf_dir):
    return finish(P.overview(base.portfolio(spark, sf_dir)))


@register("tier_counts", lambda: with_base("""
SELECT t.Risk_Category, t.tier_order, coalesce(c.loan_count, 0) AS loan_count
FROM (VALUES ('Low', 0), ('Medium', 1), ('High', 2), ('Critical', 3)) AS t(Risk_Category, tier_order)
LEFT JOIN (SELECT Risk_Category, count(*) AS loan_count FROM portfolio
           WHERE Risk_Category IS NOT NULL GROUP BY Risk_Category) c USING (Risk_Category)"""), "A3 R10")
def tier_counts_q(spark, sf_dir):
    return P.tier_counts(base.portfolio(spark, sf_dir))


def _state_risk_sql(extra_where: str = "", tail: str = "") -> str:
    return f"""
SELECT a.state, {r('a.avg_cpd')} AS avg_cpd, {r('a.avg_baseline_pd')} AS avg_baseline_pd,
  {r('a.avg_uplift_pct')} AS avg_uplift_pct, a.loan_count, {r('a.total_exposure', 2)} AS total_exposure,
  a.high_critical, {r('a.high_critical / a.loan_count * 100.0')} AS high_critical_pct,
  {r('coalesce(s.physical_risk, 0.45)')} AS physical_risk
FROM (SELECT state, avg(CPD) AS avg_cpd, avg(Baseline_PD) AS avg_baseline_pd, avg(PD_Uplift_Pct) AS avg_uplift_pct,
        count(CPD) AS loan_count, sum(EAD) AS total_exposure, {HC} AS high_critical
      FROM (SELECT *, {strip_sql('addr_state')} AS state FROM portfolio) WHERE state IS NOT NULL {extra_where}
      GROUP BY state) a
LEFT JOIN states s ON a.state = s.state_key {tail}"""


@register("state_risk", lambda: with_base(_state_risk_sql()), "A4 J7 P15")
def state_risk_q(spark, sf_dir):
    return finish(P.state_risk(base.portfolio(spark, sf_dir)), money=("total_exposure",))


@register("state_map_points", lambda: with_base(f"""
SELECT q.*, s.lat, s.lon, {r('greatest(6, least(25, 4 + 2.5 * ln(1 + q.loan_count)))')} AS radius
FROM ({_state_risk_sql()}) q JOIN states s ON q.state = s.state_key WHERE s.lat IS NOT NULL"""), "J6 P37")
def state_map_points_q(spark, sf_dir):
    agg = finish(P.state_risk(base.portfolio(spark, sf_dir)), money=("total_exposure",))
    return finish(P.state_map_points(agg), money=("total_exposure",))


@register("states_with_tiers", lambda: with_base(f"""
SELECT * FROM ({_state_risk_sql()}) q
WHERE q.state IN (SELECT {strip_sql('addr_state')} FROM portfolio WHERE Risk_Category IN ('Critical'))"""),
          "F6 J18")
def states_with_tiers_q(spark, sf_dir):
    return finish(P.states_with_tiers(base.portfolio(spark, sf_dir), ["Critical"]),
                  money=("total_exposure",))


@register("dashboard_loss", lambda: with_base(f"""
SELECT loan_id, {r('Baseline_PD')} AS CPD, {r('installment * 36.0', 2)} AS EAD, {r('Baseline_PD * 0.45 * installment * 36.0', 2)} AS Expected_Loss
FROM pd"""), "R11 R7 R8")
def dashboard_loss(spark, sf_dir):
    """Loans without amount, state and purpose: no overlay applies, exposure is 36 instalments."""
    df = base.with_pd(spark, sf_dir).drop("loan_amnt", "addr_state", "purpose")
    scored = overlay.score_cpd(df, ead_mode="dashboard", impute_income=False)
    return finish(scored.select("loan_id", "CPD", "EAD", "Expected_Loss"), money=("EAD", "Expected_Loss"))


@register("sector_risk", lambda: with_base(f"""
SELECT purpose, {r('avg(Baseline_PD)')} AS avg_baseline_pd, {r('avg(CPD)')} AS avg_cpd,
  {r('avg(PD_Uplift_Pct)')} AS avg_uplift_pct, count(CPD) AS loan_count
FROM portfolio WHERE purpose IS NOT NULL GROUP BY purpose"""), "A5")
def sector_risk_q(spark, sf_dir):
    return finish(P.sector_risk(base.portfolio(spark, sf_dir)))


@register("el_by_tier", lambda: with_base(f"""
SELECT Risk_Category, count(Expected_Loss) AS loan_count, {r('sum(EAD)', 2)} AS total_ead,
  {r('sum(Expected_Loss)', 2)} AS total_el, {r('avg(CPD)')} AS avg_cpd,
  {r('sum(Expected_Loss) / (sum(EAD) + 1e-8)')} AS el_rate
FROM portfolio WHERE Risk_Category IS NOT NULL GROUP BY Risk_Category"""), "A6 R11")
def el_by_tier_q(spark, sf_dir):
    return finish(P.el_by_tier(base.portfolio(spark, sf_dir)), money=("total_ead", "total_el"))


@register("el_by_sector", lambda: with_base(f"""
SELECT purpose, {r('sum(Expected_Loss)', 2)} AS total_el, {r('avg(CPD)')} AS avg_cpd,
  count(Expected_Loss) AS loan_count
FROM portfolio WHERE purpose IS NOT NULL GROUP BY purpose"""), "A7")
def el_by_sector_q(spark, sf_dir):
    return finish(P.el_by_sector(base.portfolio(spark, sf_dir)), money=("total_el",))


@register("el_totals", lambda: with_base(f"""
SELECT {r('sum(EAD)', 2)} AS total_ead, {r('sum(Expected_Loss)', 2)} AS total_el,
  {r('sum(Expected_Loss) / (sum(EAD) + 1e-8)')} AS avg_el_rate
FROM portfolio"""), "A8")
def el_totals_q(spark, sf_dir):
    return finish(P.el_totals(base.portfolio(spark, sf_dir)), money=("total_ead", "total_el"))


@register("report_headline", lambda: with_base(f"""
SELECT {r('avg(Baseline_PD)')} AS avg_baseline_pd, {r('avg(CPD)')} AS avg_cpd,
  {r(HC + ' / count(*) * 100.0')} AS high_critical_share_pct,
  {r('(avg(CPD) - avg(Baseline_PD)) / (avg(Baseline_PD) + 1e-8) * 100.0')} AS portfolio_uplift_pct
FROM portfolio"""), "A9")
def report_headline_q(spark, sf_dir):
    return finish(P.report_headline(base.portfolio(spark, sf_dir)))


@register("map_extents", lambda: with_base(f"""
SELECT count(*) AS n_states, CAST(sum(loan_count) AS BIGINT) AS total_loans,
  max(avg_cpd) AS max_avg_cpd, min(avg_cpd) AS min_avg_cpd
FROM ({_state_risk_sql()}) q"""), "A10")
def map_extents_q(spark, sf_dir):
    agg = finish(P.state_risk(base.portfolio(spark, sf_dir)), money=("total_exposure",))
    return finish(P.map_extents(agg))


@register("class_balance", lambda: with_base(f"""
SELECT CAST(count_if("default" = 0) AS BIGINT) AS n_negative, CAST(count_if("default" = 1) AS BIGINT) AS n_positive,
  {r('avg(CAST("default" AS DOUBLE))')} AS default_rate,
  {r('CAST(CAST(count_if("default" = 0) AS BIGINT) AS DOUBLE) / CAST(count_if("default" = 1) AS BIGINT)')} AS pos_weight
FROM clean"""), "A11 P1 M2")
def class_balance_q(spark, sf_dir):
    return finish(P.class_balance(base.clean(spark, sf_dir)))


@register("top20_loans", lambda: with_base(f"""
SELECT loan_id, {r('loan_amnt', 2)} AS loan_amnt, {strip_sql('addr_state')} AS state, purpose,
  {r('Baseline_PD')} AS Baseline_PD, {r('CPD')} AS CPD, {r('PD_Uplift_Pct')} AS PD_Uplift_Pct, Risk_Category
FROM portfolio ORDER BY CPD DESC, loan_id LIMIT 20"""), "T2 P35")
def top20_loans(spark, sf_dir):
    df = base.portfolio(spark, sf_dir).select(
        "loan_id", "loan_amnt", C.strip_key("addr_state").alias("state"), "purpose",
        "Baseline_PD", "CPD", "PD_Uplift_Pct", "Risk_Category")
    return finish(P.top_n(df, "CPD", 20, "loan_id"), money=("loan_amnt",))


@register("top10_states", lambda: with_base(f"""
SELECT * FROM ({_state_risk_sql()}) q ORDER BY avg_cpd DESC, state LIMIT 10"""), "T1 T3")
def top10_states(spark, sf_dir):
    agg = P.state_risk(base.portfolio(spark, sf_dir))
    return finish(P.top_n(agg, "avg_cpd", 10, "state"), money=("total_exposure",))


@register("riskiest_state", lambda: with_base(f"""
SELECT state, avg_cpd, loan_count FROM ({_state_risk_sql()}) q ORDER BY avg_cpd DESC, state LIMIT 1"""),
          "T4")
def riskiest_state(spark, sf_dir):
    agg = finish(P.state_risk(base.portfolio(spark, sf_dir)), money=("total_exposure",))
    return P.row_of_max(agg, "avg_cpd", "state").select("state", "avg_cpd", "loan_count")


@register("top_sectors_report", lambda: with_base(f"""
SELECT purpose, count(*) AS loan_count, round(avg(CPD), 4) AS avg_cpd
FROM portfolio WHERE purpose IS NOT NULL GROUP BY purpose ORDER BY loan_count DESC, purpose LIMIT 10"""),
          "A23 T3")
def top_sectors_report(spark, sf_dir):
    agg = base.portfolio(spark, sf_dir).where(F.col("purpose").isNotNull()).groupBy("purpose").agg(
        F.count(F.lit(1)).alias("loan_count"), F.round(F.avg("CPD"), 4).alias("avg_cpd"))
    return P.top_n(agg, "loan_count", 10, "purpose")


@register("loan_preview", lambda: with_base(f"""
SELECT loan_id, {r('loan_amnt', 2)} AS loan_amnt, addr_state, purpose, {r('Baseline_PD')} AS Baseline_PD,
  {r('CPD')} AS CPD_2030, {r('PD_Uplift_Pct')} AS "PD_Uplift_%", Risk_Category
FROM portfolio ORDER BY loan_id LIMIT 20"""), "T6 P35 P36")
def loan_preview(spark, sf_dir):
    df = base.portfolio(spark, sf_dir)
    wanted = ["loan_id", "loan_amnt", "addr_state", "purpose", "Baseline_PD", "CPD", "PD_Uplift_Pct",
              "Risk_Category"]
    shown = df.select(*[c for c in wanted if c in df.columns]).withColumnsRenamed(
        {"CPD": "CPD_2030", "PD_Uplift_Pct": "PD_Uplift_%"})
    return finish(P.preview(shown, 20), money=("loan_amnt",))


@register("seeded_sample", lambda: with_base(f"""
SELECT loan_id, {r('CPD')} AS CPD FROM portfolio
ORDER BY md5(CONCAT(CAST(loan_id AS VARCHAR), '42')) LIMIT 100"""), "T7")
def seeded_sample_q(spark, sf_dir):
    return finish(P.seeded_sample(base.portfolio(spark, sf_dir).select("loan_id", "CPD"), 100))


@register("histogram_cpd", lambda: with_base(f"""
WITH e AS (SELECT min(CPD) AS lo, max(CPD) AS hi FROM portfolio),
b AS (SELECT CASE WHEN (e.hi - e.lo) / 60 = 0 THEN 0
                  ELSE least(CAST(floor((CPD - e.lo) / ((e.hi - e.lo) / 60)) AS INTEGER), 59) END AS bin
      FROM portfolio, e WHERE CPD IS NOT NULL)
SELECT bin, count(*) AS count, {r('e.lo + bin * ((e.hi - e.lo) / 60)')} AS bin_lo,
  {r('e.lo + (bin + 1) * ((e.hi - e.lo) / 60)')} AS bin_hi
FROM b, e GROUP BY bin, e.lo, e.hi"""), "A14")
def histogram_cpd(spark, sf_dir):
    return finish(P.histogram(base.portfolio(spark, sf_dir), "CPD", 60))


@register("distinct_states", lambda: with_base(f"""
SELECT DISTINCT {strip_sql('addr_state')} AS state FROM portfolio WHERE addr_state IS NOT NULL"""), "A24")
def distinct_states(spark, sf_dir):
    df = base.portfolio(spark, sf_dir).select(C.strip_key("addr_state").alias("state"))
    return P.distinct_keys(df, "state")


@register("geography_check", lambda: with_base(f"""
SELECT coalesce(max(length({strip_sql('addr_state')}) = 2), false) AS is_state_codes
FROM portfolio WHERE addr_state IS NOT NULL"""), "F8")
def geography_check(spark, sf_dir):
    return P.geography_is_state_codes(base.portfolio(spark, sf_dir))
