"""Climate features per location and their enrichment of loan rows.

R1, R2, R4, R7, J2, J4, J5, J16, W3, P18.

Observations come in long form ``(loc_key, variable, month, value)`` with
``variable`` in {T2M, PRECTOTCORR}; the sentinel -999 is removed per series.
Per location the work is: exact 95th percentiles, mean / population std /
min of precipitation, counts above the percentiles, and the mean of the
last k months against the earlier ones.  It runs as one window pass
partitioned by (location, variable) plus an aggregation that reuses that
partitioning, then a two-row-per-location pivot.  Monthly series are short
(hundreds of rows per location), so no location can hold a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.sources import dims

T2M, PRECIP = "T2M", "PRECTOTCORR"
FEATURES = config.PHYSICAL_RISK_FEATURES


def loc_key(lat, lon) -> Column:
    """R2: '<lat rounded to 1>_<lon rounded to 1>'."""
    return F.concat_ws("_", F.round(C.col_(lat), 1).cast("string"), F.round(C.col_(lon), 1).cast("string"))


def valid_observations(obs: DataFrame) -> DataFrame:
    """S6 filter: drop the -999 sentinel and missing values, months 01-12 only."""
    mm = F.substring(F.col("month"), 5, 2)
    return obs.where(
        F.col("value").isNotNull() & (F.col("value") != C.lit_d(config.CLIMATE_MISSING_SENTINEL))
        & mm.between("01", "12")
    )


def climate_features(obs: DataFrame) -> DataFrame:
    """The five physical features per location (rounded to 4; events as INT).

    Locations with fewer than 12 valid months in either series get the
    fallback row.  Output: loc_key + FEATURES + n_t2m + n_precip.
    """
    clean = valid_observations(obs)
    w = Window.partitionBy("loc_key", "variable")
    ordered = w.orderBy(F.col("month").desc())
    x = clean.select(
        "loc_key", "variable", "month", "value",
        F.count(F.lit(1)).over(w).alias("n"),
        F.percentile("value", F.lit(0.95)).over(w).alias("p95"),
        F.row_number().over(ordered).alias("rn_desc"),
    )
    # The last k months against the rest, k = min(60, n - 12)
    split = F.least(F.lit(config.CLIMATE_RECENT_MONTHS), F.col("n") - F.lit(config.CLIMATE_MIN_MONTHS))
    per_series = x.groupBy("loc_key", "variable").agg(
        F.first("n").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("vmin"),
        F.count_if(F.col("value") > F.col("p95")).alias("n_above"),
        F.avg(F.when(F.col("rn_desc") <= split, F.col("value"))).alias("mean_recent"),
        F.avg(F.when(F.col("rn_desc") > split, F.col("value"))).alias("mean_earlier"),
        F.first(split).alias("split"),
    )

    def pick(var: str, c: str) -> Column:
        return F.max(F.when(F.col("variable") == var, F.col(c)))

    loc = per_series.groupBy("loc_key").agg(
        F.coalesce(pick(T2M, "n"), F.lit(0)).alias("n_t2m"),
        F.coalesce(pick(PRECIP, "n"), F.lit(0)).alias("n_precip"),
        pick(PRECIP, "n_above").alias("p_above"),
        pick(T2M, "n_above").alias("t_above"),
        pick(PRECIP, "mean").alias("mean_p"),
        pick(PRECIP, "std").alias("std_p"),
        pick(PRECIP, "vmin").alias("min_p"),
        pick(T2M, "mean_recent").alias("t_recent"),
        pick(T2M, "mean_earlier").alias("t_earlier"),
        pick(T2M, "split").alias("t_split"),
    )
    flood = F.col("p_above").cast("double") / F.col("n_precip")
    drought = F.least(F.greatest(C.lit_d(0.0), (F.col("mean_p") - F.col("min_p"))
                                 / (F.col("mean_p") + F.col("std_p") + C.lit_d(1e-6))), C.lit_d(1.0))
    anomaly = F.when(F.col("t_split") > 0, F.col("t_recent") - F.col("t_earlier")).otherwise(C.lit_d(0.0))
    events = F.col("t_above") + F.col("p_above")
    score = (C.lit_d(0.35) * F.least(flood, C.lit_d(1.0)) + C.lit_d(0.30) * drought
             + C.lit_d(0.20) * F.least(F.greatest(anomaly / 3.0, C.lit_d(0.0)), C.lit_d(1.0))
             + C.lit_d(0.15) * F.least(events / 20.0, C.lit_d(1.0)))
    enough = (F.col("n_t2m") >= config.CLIMATE_MIN_MONTHS) & (F.col("n_precip") >= config.CLIMATE_MIN_MONTHS)
    fb = config.CLIMATE_FALLBACK
    return loc.select(
        "loc_key",
        F.when(enough, F.round(flood, 4)).otherwise(C.lit_d(fb["flood_freq_score"])).alias("flood_freq_score"),
        F.when(enough, F.round(drought, 4)).otherwise(C.lit_d(fb["drought_severity_index"])).alias("drought_severity_index"),
        F.when(enough, F.round(anomaly, 4)).otherwise(C.lit_d(fb["temp_anomaly_5yr"])).alias("temp_anomaly_5yr"),
        F.when(enough, events.cast("int")).otherwise(F.lit(fb["extreme_weather_events_count"]))
        .alias("extreme_weather_events_count"),
        F.when(enough, F.round(F.least(score, C.lit_d(1.0)), 4)).otherwise(C.lit_d(fb["physical_risk_score"]))
        .alias("physical_risk_score"),
        "n_t2m", "n_precip",
    )


def fallback_columns() -> dict[str, Column]:
    fb = config.CLIMATE_FALLBACK
    return {k: (F.lit(v).cast("int") if k == "extreme_weather_events_count" else C.lit_d(v)) for k, v in fb.items()}


def state_climate_features(spark: SparkSession, features: DataFrame) -> DataFrame:
    """Features per state with coordinates (US first, then India; both in the state
    dimension).  A state whose location has no feature row gets the fallback row.

    Output size is bounded by the state dimension (< 128 rows).
    """
    coords = dims.state_coords(spark)
    feats = features.select("loc_key", *FEATURES)
    joined = coords.join(feats, "loc_key", "left")
    fb = fallback_columns()
    return joined.select(
        "state_key", "loc_key",
        *[F.coalesce(F.col(f), fb[f]).alias(f) for f in FEATURES],
    )


def enrich_climate(df: DataFrame, features: DataFrame | None, state_col: str = "addr_state",
                   purpose_col: str = "purpose") -> DataFrame:
    """Add the 10 climate columns (5 physical, 3 transition, 2 geographic).

    * state missing -> 0.3 for all five physical features; state unknown -> fallback row
    * no state column -> 0.3 for score/index features, 0.0 for the others
    * no purpose column -> constants 0.25 / 0.20 / 0.22
    """
    spark = df.sparkSession
    out = df
    if state_col in df.columns:
        key = C.strip_key(state_col)
        per_state = state_climate_features(spark, features).drop("loc_key") if features is not None else None
        geo = dims.state_dim(spark).select(F.col("state_key").alias("_g_key"),
                                           F.col("coast_km").alias("_g_coast"), F.col("elev_m").alias("_g_elev"))
        out = out.withColumn("_st", key)
        if per_state is not None:
            ps = F.broadcast(per_state.select(F.col("state_key").alias("_p_key"),
                                              *[F.col(f).alias(f"_p_{f}") for f in FEATURES]))
            out = out.join(ps, out["_st"] == ps["_p_key"], "left")
        out = out.join(geo, out["_st"] == geo["_g_key"], "left")
        fb = fallback_columns()
        missing = C.lit_d(config.CLIMATE_MISSING_STATE_VALUE)
        cols = {}
        for f in FEATURES:
            present = F.coalesce(F.col(f"_p_{f}"), fb[f]) if per_state is not None else fb[f]
            miss = missing.cast("int") if f == "extreme_weather_events_count" else missing
            if f == "extreme_weather_events_count":
                cols[f] = F.when(F.col(state_col).isNull(), missing).otherwise(present.cast("double"))
            else:
                cols[f] = F.when(F.col(state_col).isNull(), miss).otherwise(present)
        cols["coastal_proximity_km"] = F.coalesce(F.col("_g_coast"), C.lit_d(500.0))
        cols["elevation_meters"] = F.coalesce(F.col("_g_elev"), C.lit_d(300.0))
        out = out.withColumns(cols)
        out = out.drop("_st", "_g_key", "_g_coast", "_g_elev", "_p_key", *[f"_p_{f}" for f in FEATURES])
    else:
        out = out.withColumns({f: C.lit_d(0.3 if ("score" in f or "index" in f) else 0.0) for f in FEATURES})
        out = out.withColumns({"coastal_proximity_km": C.lit_d(500.0), "elevation_meters": C.lit_d(300.0)})

    if purpose_col in df.columns:
        from tempest.operators import overlay
        out = overlay.with_sector_lookup(out, purpose_col, None, "sector_carbon_intensity", "policy_exposure_score")
        out = out.withColumn("transition_risk_score", transition_composite("sector_carbon_intensity",
                                                                           "policy_exposure_score"))
    else:
        out = out.withColumns({"sector_carbon_intensity": C.lit_d(0.25), "policy_exposure_score": C.lit_d(0.20),
                               "transition_risk_score": C.lit_d(0.22)})
    return out


def transition_composite(intensity, exposure) -> Column:
    """clip(0.6 * clip(intensity, 0, 1) + 0.4 * exposure, 0, 1)."""
    return C.clip(C.lit_d(0.6) * C.clip(intensity, 0.0, 1.0) + C.lit_d(0.4) * C.col_(exposure), 0.0, 1.0)


def requested_locations(loans: DataFrame, state_col: str = "addr_state") -> DataFrame:
    """Distinct location keys of the loans' states (states without coordinates drop out)."""
    coords = dims.state_coords(loans.sparkSession)
    keys = loans.select(C.strip_key(state_col).alias("state_key")).where(F.col("state_key").isNotNull()).distinct()
    return keys.join(coords, "state_key", "inner").select("loc_key", "lat", "lon").distinct()


def missing_locations(requested: DataFrame, table: DataFrame) -> DataFrame:
    """Requested locations not yet in the feature table (left anti join)."""
    return requested.join(table.select("loc_key"), "loc_key", "left_anti")
