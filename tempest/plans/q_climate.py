"""Step 5 of the build plan: climate features, climate-mode hazard, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import climate as K
from tempest.operators import model, overlay
from tempest.plans import base
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import strip_sql, with_base
from tempest.session import materialise, run_folder
from tempest.sources import climate as CS
from tempest.sources.climate import fixture_climate, fixture_climate_sql

FB = config.CLIMATE_FALLBACK


def features_sql() -> str:
    """R1 in SQL over the stand-in observations; CTE named ``feat``."""
    return f"""obs AS ({fixture_climate_sql()}),
v AS (SELECT * FROM obs WHERE value IS NOT NULL AND value <> -999 AND substr(month, 5, 2) BETWEEN '01' AND '12'),
w AS (SELECT *, count(*) OVER (PARTITION BY loc_key, variable) AS n,
        quantile_cont(value, 0.95) OVER (PARTITION BY loc_key, variable) AS p95,
        row_number() OVER (PARTITION BY loc_key, variable ORDER BY month DESC) AS rn
      FROM v),
s AS (SELECT loc_key, variable, any_value(n) AS n, avg(value) AS mean, stddev_pop(value) AS std,
        min(value) AS vmin, CAST(count_if(value > p95) AS BIGINT) AS n_above,
        avg(CASE WHEN rn <= least(60, n - 12) THEN value END) AS mean_recent,
        avg(CASE WHEN rn > least(60, n - 12) THEN value END) AS mean_earlier,
        any_value(least(60, n - 12)) AS split
      FROM w GROUP BY loc_key, variable),
l AS (SELECT loc_key,
        coalesce(max(CASE WHEN variable = 'T2M' THEN n END), 0) AS n_t2m,
        coalesce(max(CASE WHEN variable = 'PRECTOTCORR' THEN n END), 0) AS n_precip,
        max(CASE WHEN variable = 'PRECTOTCORR' THEN n_above END) AS p_above,
        max(CASE WHEN variable = 'T2M' THEN n_above END) AS t_above,
        max(CASE WHEN variable = 'PRECTOTCORR' THEN mean END) AS mean_p,
        max(CASE WHEN variable = 'PRECTOTCORR' THEN std END) AS std_p,
        max(CASE WHEN variable = 'PRECTOTCORR' THEN vmin END) AS min_p,
        max(CASE WHEN variable = 'T2M' THEN mean_recent END) AS t_recent,
        max(CASE WHEN variable = 'T2M' THEN mean_earlier END) AS t_earlier,
        max(CASE WHEN variable = 'T2M' THEN split END) AS t_split
      FROM s GROUP BY loc_key),
c AS (SELECT *, CAST(p_above AS DOUBLE) / n_precip AS flood,
        least(greatest(0.0, (mean_p - min_p) / (mean_p + std_p + 1e-6)), 1.0) AS drought,
        CASE WHEN t_split > 0 THEN t_recent - t_earlier ELSE 0.0 END AS anomaly,
        t_above + p_above AS events,
        n_t2m >= 12 AND n_precip >= 12 AS enough
      FROM l),
feat AS (SELECT loc_key,
        CASE WHEN enough THEN round(flood, 4) ELSE {FB['flood_freq_score']} END AS flood_freq_score,
        CASE WHEN enough THEN round(drought, 4) ELSE {FB['drought_severity_index']} END AS drought_severity_index,
        CASE WHEN enough THEN round(anomaly, 4) ELSE {FB['temp_anomaly_5yr']} END AS temp_anomaly_5yr,
        CASE WHEN enough THEN CAST(events AS INTEGER) ELSE {FB['extreme_weather_events_count']} END
            AS extreme_weather_events_count,
        CASE WHEN enough THEN round(least(0.35 * least(flood, 1.0) + 0.30 * drought
             + 0.20 * least(greatest(anomaly / 3.0, 0.0), 1.0) + 0.15 * least(events / 20.0, 1.0), 1.0), 4)
             ELSE {FB['physical_risk_score']} END AS physical_risk_score,
        n_t2m, n_precip
      FROM c),
state_feat AS (
  SELECT s.state_key,
    coalesce(f.flood_freq_score, 0.3) AS flood_freq_score,
    coalesce(f.drought_severity_index, 0.3) AS drought_severity_index,
    coalesce(f.temp_anomaly_5yr, 0.0) AS temp_anomaly_5yr,
    coalesce(f.extreme_weather_events_count, 2) AS extreme_weather_events_count,
    coalesce(f.physical_risk_score, 0.3) AS physical_risk_score
  FROM (SELECT state_key, CAST(round(lat, 1) AS VARCHAR) || '_' || CAST(round(lon, 1) AS VARCHAR) AS loc_key
        FROM states WHERE lat IS NOT NULL) s
  LEFT JOIN feat f USING (loc_key))"""


def _features(spark, sf_dir):
    return K.climate_features(fixture_climate(spark, sf_dir))


@register("climate_features", lambda: with_base(f"""WITH {features_sql()}
SELECT loc_key, {r('flood_freq_score')} AS flood_freq_score, {r('drought_severity_index')} AS drought_severity_index,
  {r('temp_anomaly_5yr')} AS temp_anomaly_5yr, extreme_weather_events_count,
  {r('physical_risk_score')} AS physical_risk_score, n_t2m, n_precip
FROM feat"""), "R1 R2 W3 S6")
def climate_features(spark, sf_dir):
    return finish(_features(spark, sf_dir))


@register("hazard_climate", lambda: with_base(f"""WITH {features_sql()}
SELECT p.loan_id,
  {r("CASE WHEN p.addr_state IS NULL THEN 0.45 ELSE coalesce(sf.physical_risk_score, 0.3) END")} AS hazard
FROM pd p LEFT JOIN state_feat sf ON {strip_sql('p.addr_state')} = sf.state_key"""), "R4 J2")
def hazard_climate(spark, sf_dir):
    df = overlay.with_climate_hazard(base.with_pd(spark, sf_dir), _features(spark, sf_dir))
    return finish(df.select("loan_id", "hazard"))


@register("cpd_climate_by_state", lambda: with_base(f"""WITH {features_sql()},
hz AS (SELECT p.*, CASE WHEN p.addr_state IS NULL THEN 0.45 ELSE coalesce(sf.physical_risk_score, 0.3) END AS hz
       FROM lookup p LEFT JOIN state_feat sf ON {strip_sql('p.addr_state')} = sf.state_key),
c2 AS (SELECT *, least(greatest(least(greatest(Baseline_PD * (1 + hz * 0.3), 0), 1) * (1 + least(greatest(
          emission_intensity * 100.0 / (annual_inc / 1000.0 + 1e-6), 0), 0.5) * 0.4), 0), 1) AS CPD2 FROM hz)
SELECT {strip_sql('addr_state')} AS state, count(*) AS loan_count, {r('avg(CPD2)')} AS avg_cpd,
  {r('avg(hz)')} AS avg_hazard
FROM c2 WHERE addr_state IS NOT NULL GROUP BY 1"""), "R4 R8 J2")
def cpd_climate_by_state(spark, sf_dir):
    scored = base.portfolio(spark, sf_dir, hazard=_features(spark, sf_dir))
    out = scored.withColumn("state", C.strip_key("addr_state")).where(F.col("state").isNotNull()) \
        .groupBy("state").agg(F.count(F.lit(1)).alias("loan_count"), F.avg("CPD").alias("avg_cpd"),
                              F.avg("hazard").alias("avg_hazard"))
    return finish(out)


@register("loan_climate_enriched", lambda: with_base(f"""WITH {features_sql()}
SELECT p.loan_id,
  {r('CASE WHEN p.addr_state IS NULL THEN 0.3 ELSE coalesce(sf.flood_freq_score, 0.3) END')} AS flood_freq_score,
  {r('CASE WHEN p.addr_state IS NULL THEN 0.3 ELSE coalesce(sf.drought_severity_index, 0.3) END')} AS drought_severity_index,
  {r('CASE WHEN p.addr_state IS NULL THEN 0.3 ELSE coalesce(sf.temp_anomaly_5yr, 0.0) END')} AS temp_anomaly_5yr,
  {r('CASE WHEN p.addr_state IS NULL THEN 0.3 ELSE CAST(coalesce(sf.extreme_weather_events_count, 2) AS DOUBLE) END')} AS extreme_weather_events_count,
  {r('CASE WHEN p.addr_state IS NULL THEN 0.3 ELSE coalesce(sf.physical_risk_score, 0.3) END')} AS physical_risk_score,
  {r('p.emission_intensity')} AS sector_carbon_intensity, {r('p.policy_exposure')} AS policy_exposure_score,
  {r('least(greatest(0.6 * least(greatest(p.emission_intensity, 0), 1) + 0.4 * p.policy_exposure, 0), 1)')} AS transition_risk_score,
  {r('coalesce(st.coast_km, 500.0)')} AS coastal_proximity_km, {r('coalesce(st.elev_m, 300.0)')} AS elevation_meters
FROM lookup p
LEFT JOIN state_feat sf ON {strip_sql('p.addr_state')} = sf.state_key
LEFT JOIN states st ON {strip_sql('p.addr_state')} = st.state_key"""), "R7 J2 J3 J4 J5 P17 P18")
def loan_climate_enriched(spark, sf_dir):
    df = K.enrich_climate(base.clean(spark, sf_dir), _features(spark, sf_dir))
    return finish(df.select("loan_id", *config.CLIMATE_FEATURES))


def _feature_set_sql() -> str:
    names = {True: config.ALL_FEATURES + config.CLIMATE_FEATURES, False: config.ALL_FEATURES}
    rows = ", ".join(f"({str(on).lower()}, {i}, '{f}')" for on, fs in names.items() for i, f in enumerate(fs))
    return with_base(f"SELECT *, (SELECT count(*) FROM clean) AS n_loans FROM (VALUES {rows}) AS t(climate, position, feature)")


@register("model_feature_set", _feature_set_sql, "P19")
def model_feature_set(spark, sf_dir):
    """The columns chosen for a model of the enriched loans, with and without climate, and the number of loans."""
    enriched = K.enrich_climate(base.clean(spark, sf_dir), _features(spark, sf_dir))
    chosen = F.array(*[F.struct(F.lit(on).alias("climate"), F.lit(i).alias("position"), F.lit(f).alias("feature"))
                       for on in (True, False) for i, f in enumerate(model.feature_set(enriched, on))])
    n = enriched.agg(F.count(F.lit(1)).alias("n_loans"))
    return n.select(F.explode(chosen).alias("c"), "n_loans").select("c.*", "n_loans")


# Locations that the stored table holds before the job (the same text in both engines).
NORTH = "CAST(split_part(loc_key, '_', 1) AS DOUBLE) >= 30"


@register("climate_missing_locations", lambda: with_base(f"""WITH {features_sql()},
req AS (SELECT DISTINCT CAST(round(s.lat, 1) AS VARCHAR) || '_' || CAST(round(s.lon, 1) AS VARCHAR) AS loc_key,
          s.lat, s.lon
        FROM clean c JOIN states s ON {strip_sql('c.addr_state')} = s.state_key WHERE s.lat IS NOT NULL)
SELECT loc_key, lat, lon FROM req WHERE loc_key NOT IN (SELECT loc_key FROM feat WHERE {NORTH})"""),
          "J16 S14 A24")
def climate_missing_locations(spark, sf_dir):
    """Loan locations that have no row in a feature table that covers the north only (left anti join)."""
    known = _features(spark, sf_dir).where(NORTH)
    return K.missing_locations(K.requested_locations(base.clean(spark, sf_dir)), known)


@register("climate_table_append", lambda: with_base(f"""WITH {features_sql()},
req AS (SELECT DISTINCT CAST(round(s.lat, 1) AS VARCHAR) || '_' || CAST(round(s.lon, 1) AS VARCHAR) AS loc_key
        FROM clean c JOIN states s ON {strip_sql('c.addr_state')} = s.state_key WHERE s.lat IS NOT NULL)
SELECT loc_key, {r('physical_risk_score')} AS physical_risk_score, NOT ({NORTH}) AS appended FROM feat
WHERE {NORTH} OR loc_key IN (SELECT loc_key FROM req)"""), "S6 S14 J16")
def climate_table_append(spark, sf_dir):
    """JSON month maps per location -> features; the stored table gets the requested locations it lacks."""
    run = run_folder(spark, "climate")
    CS.write_climate_json(CS.fixture_climate(spark, sf_dir), f"{run}/json")
    observed = CS.read_climate_json(spark, f"{run}/json")
    table = f"{run}/features"
    CS.append_features(K.climate_features(observed).where(NORTH).withColumn("appended", F.lit(False)), table)
    missing = CS.feature_table(spark, table).missing(K.requested_locations(base.clean(spark, sf_dir)))
    new = K.climate_features(observed.join(missing.select("loc_key"), "loc_key", "left_semi"))
    new = materialise(new.withColumn("appended", F.lit(True)), run, "new")
    for _ in range(2):  # a job that is repeated changes nothing
        CS.append_features(new, table)
    return finish(CS.read_feature_table(spark, table).select("loc_key", "physical_risk_score", "appended"))
