"""Climate overlays and the CPD pipeline.

The overlays are column algebra on top of two broadcast lookups whose size
is fixed by the method (state and sector dimensions, < 128 rows each).  The
loan rows themselves are never shuffled by an overlay: the whole pipeline
is a single map-side stage (scan -> broadcast hash joins -> projections).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import quantiles as Q
from tempest.sources import dims

_OTHER_RISK = 0.45


def with_static_hazard(df: DataFrame, state_col: str = "addr_state", out: str = "hazard") -> DataFrame:
    """State -> static hazard score; missing or unknown -> OTHER (0.45).

    The key is stripped of surrounding whitespace (P15) once, here.
    """
    spark = df.sparkSession
    dim = dims.state_dim(spark).select(F.col("state_key").alias("_hz_key"),
                                       F.col("physical_risk").alias("_hz_score"))
    keyed = df.withColumn("_hz_join", C.strip_key(state_col))
    joined = keyed.join(dim, keyed["_hz_join"] == dim["_hz_key"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_hz_score"), C.lit_d(_OTHER_RISK))) \
        .drop("_hz_join", "_hz_key", "_hz_score")


def with_climate_hazard(df: DataFrame, features: DataFrame, state_col: str = "addr_state",
                        out: str = "hazard") -> DataFrame:
    """Hazard from climate features of the state's coordinates.

    * state present and known, features present -> the location's score
    * state present but unknown, or its location lacks enough months -> 0.30
      (the fallback feature row)
    * state missing -> 0.45 (OTHER)

    ``features`` holds one row per location (``loc_key``), bounded by the
    number of states with coordinates, so the joined side is small.
    """
    from tempest.operators.climate import state_climate_features

    per_state = state_climate_features(df.sparkSession, features).select(
        F.col("state_key").alias("_cz_key"), F.col("physical_risk_score").alias("_cz_score"))
    keyed = df.withColumn("_cz_join", C.strip_key(state_col))
    joined = keyed.join(F.broadcast(per_state), keyed["_cz_join"] == per_state["_cz_key"], "left")
    fallback = C.lit_d(config.CLIMATE_FALLBACK["physical_risk_score"])
    score = (
        F.when(F.col(state_col).isNull(), C.lit_d(_OTHER_RISK))
        .otherwise(F.coalesce(F.col("_cz_score"), fallback))
    )
    return joined.withColumn(out, score).drop("_cz_join", "_cz_key", "_cz_score")


def physical_pd(pd_col, hazard_col, severity: float | Column = config.SEVERITY_FACTOR) -> Column:
    """clip(pd * (1 + hazard * severity), 0, 1)."""
    sev = severity if isinstance(severity, Column) else C.lit_d(severity)
    return C.clip(C.col_(pd_col) * (C.lit_d(1.0) + C.col_(hazard_col) * sev), 0.0, 1.0)


def with_sector_lookup(df: DataFrame, purpose_col: str | None = "purpose",
                       sector_col: str | None = None,
                       intensity_out: str = "emission_intensity",
                       exposure_out: str | None = None) -> DataFrame:
    """Purpose (or a direct sector column, preferred) -> intensity (and exposure).

    Unknown or missing keys take the ``other`` defaults (0.25 / 0.20).
    """
    key_source = sector_col if (sector_col and sector_col in df.columns) else purpose_col
    spark = df.sparkSession
    dim = dims.sector_dim(spark).select(
        F.col("sector_key").alias("_sc_key"),
        F.col("emission_intensity").alias("_sc_int"),
        F.col("policy_exposure").alias("_sc_exp"),
    )
    keyed = df.withColumn("_sc_join", C.sector_key(key_source))
    joined = keyed.join(dim, keyed["_sc_join"] == dim["_sc_key"], "left")
    joined = joined.withColumn(intensity_out,
                               F.coalesce(F.col("_sc_int"), C.lit_d(config.SECTOR_DEFAULT_INTENSITY)))
    if exposure_out:
        joined = joined.withColumn(exposure_out,
                                   F.coalesce(F.col("_sc_exp"), C.lit_d(config.SECTOR_DEFAULT_EXPOSURE)))
    return joined.drop("_sc_join", "_sc_key", "_sc_int", "_sc_exp")


def transition_pd(pd_col, intensity_col, income_col, price: float | Column,
                  scaling: float | Column = config.TRANSITION_SCALING) -> Column:
    """ratio = clip(intensity * price / (income/1000 + 1e-6), 0, 0.5);
    cpd = clip(pd * (1 + ratio * scaling), 0, 1)."""
    price_c = price if isinstance(price, Column) else C.lit_d(price)
    scale_c = scaling if isinstance(scaling, Column) else C.lit_d(scaling)
    ratio = C.clip(
        C.col_(intensity_col) * price_c / (C.col_(income_col) / C.lit_d(1000.0) + C.lit_d(config.INCOME_EPS)),
        0.0, config.TRANSITION_COST_CLIP_MAX,
    )
    return C.clip(C.col_(pd_col) * (C.lit_d(1.0) + ratio * scale_c), 0.0, 1.0)


def income_filled(df: DataFrame, income_col: str = "annual_inc", impute: bool = True) -> Column:
    """Income with missing values replaced by the batch median (scalar subquery)."""
    if not impute:
        return F.col(income_col)
    med = Q.quantile(df, income_col, 0.5)
    return F.coalesce(F.col(income_col), med)


def ead_column(df: DataFrame, mode: str = "api") -> Column:
    """R11 exposure at default: loan_amnt if present; else 10000 (API) or installment*36 (dashboard)."""
    if "loan_amnt" in df.columns:
        return F.col("loan_amnt")
    if mode == "dashboard":
        return F.col("installment") * C.lit_d(config.DASHBOARD_TERM_MONTHS)
    return C.lit_d(config.API_DEFAULT_EAD)


def score_cpd(
    df: DataFrame,
    pd_col: str = "Baseline_PD",
    scenario: str = "orderly",
    severity: float = config.SEVERITY_FACTOR,
    scaling: float = config.TRANSITION_SCALING,
    hazard: str | DataFrame = "static",
    lgd: float = config.DEFAULT_LGD,
    ead_mode: str = "api",
    impute_income: bool = True,
    sector_col: str | None = None,
    price: Column | None = None,
) -> DataFrame:
    """Physical overlay, transition overlay, uplift %, tier and expected loss.

    ``hazard`` is ``"static"`` (J1) or a climate feature table (R4).  Without
    an ``addr_state`` column the physical overlay is skipped, without
    ``purpose`` the transition overlay is skipped (as in the method).
    ``price`` replaces the scenario's carbon price, row by row.
    Adds ``CPD``, ``PD_Uplift_Pct``, ``Risk_Category``, ``EAD``, ``Expected_Loss``.
    """
    price = dims.scenario_price(scenario) if price is None else price
    out = df
    if "addr_state" in df.columns:
        out = (with_static_hazard(out) if isinstance(hazard, str)
               else with_climate_hazard(out, hazard))
        out = out.withColumn("PD_Physical", physical_pd(pd_col, "hazard", severity))
    else:
        out = out.withColumn("PD_Physical", F.col(pd_col))
    if "purpose" in df.columns or (sector_col and sector_col in df.columns):
        inc = income_filled(out, impute=impute_income)
        out = with_sector_lookup(out, "purpose", sector_col)
        out = out.withColumn("CPD", transition_pd("PD_Physical", "emission_intensity", inc, price, scaling))
    else:
        out = out.withColumn("CPD", F.col("PD_Physical"))
    return out.withColumns({
        "PD_Uplift_Pct": C.uplift_pct(pd_col, "CPD"),
        "Risk_Category": C.risk_tier("CPD"),
        "EAD": ead_column(out, ead_mode),
    }).withColumn("Expected_Loss", F.col("CPD") * C.lit_d(lgd) * F.col("EAD"))


def fan_out_scenarios(df: DataFrame, severities: bool = False) -> DataFrame:
    """One row per loan and scenario (and severity) via ``explode`` of a literal array.

    The fan-out is a fixed factor (4, or 4 x 3), generated inside the scan
    stage; nothing is joined or shuffled.
    """
    out = df.withColumn("_sc", F.explode(dims.scenario_array())).select("*", "_sc.*").drop("_sc")
    if severities:
        out = out.withColumn("_sv", F.explode(dims.severity_array())).select("*", "_sv.*").drop("_sv")
    return out


def overlay_columns(pd_col: str, hazard_col: str, intensity_col: str, income_col,
                    price_col: str = "carbon_price", severity=config.SEVERITY_FACTOR,
                    scaling: float = config.TRANSITION_SCALING) -> Column:
    """CPD of a loan row that already carries hazard, intensity and a scenario price."""
    sev = F.col(severity) if isinstance(severity, str) else severity
    return transition_pd(physical_pd(pd_col, hazard_col, sev), intensity_col, income_col,
                         F.col(price_col), scaling)
