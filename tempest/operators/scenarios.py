"""Scenario grids, stress matrix, projections, ablation and proxy sensitivity.

R12-R15, R19, R20, J12-J14, A22, O3.

Design rule: score the baseline once, look up hazard and intensity once,
keep only the handful of columns the overlays need, and fan out over the
(4 scenarios x 3 severities) grid with ``explode`` of a literal array.  The
fan-out multiplies rows by a fixed factor inside the scan stage; the
aggregation after it shuffles one partial row per (task, scenario,
severity), however large the portfolio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import overlay
from tempest.sources import dims

OVERLAY_INPUTS = ["loan_id", "Baseline_PD", "hazard", "emission_intensity", "annual_inc", "EAD"]


def overlay_inputs(pd_df: DataFrame, hazard: str | DataFrame = "static") -> DataFrame:
    """Baseline PD plus hazard and intensity per loan, narrowed to the overlay inputs."""
    df = (overlay.with_static_hazard(pd_df) if isinstance(hazard, str)
          else overlay.with_climate_hazard(pd_df, hazard))
    df = overlay.with_sector_lookup(df)
    df = df.withColumn("EAD", overlay.ead_column(df))
    return df.select(*[c for c in OVERLAY_INPUTS if c in df.columns])


def scenario_cpd(inputs: DataFrame, severities: bool = False,
                 scaling: float = config.TRANSITION_SCALING,
                 severity: float = config.SEVERITY_FACTOR) -> DataFrame:
    """CPD of every loan under every scenario (and severity)."""
    fan = overlay.fan_out_scenarios(inputs, severities=severities)
    sev = F.col("severity") if severities else C.lit_d(severity)
    cpd = overlay.transition_pd(overlay.physical_pd("Baseline_PD", "hazard", sev),
                                "emission_intensity", "annual_inc", F.col("carbon_price"), scaling)
    return fan.withColumn("CPD", cpd).withColumns({
        "PD_Uplift_Pct": C.uplift_pct("Baseline_PD", "CPD"),
        "Risk_Category": C.risk_tier("CPD"),
    })


def scenario_compare(inputs: DataFrame) -> DataFrame:
    """Per scenario average CPD, average uplift and High/Critical count."""
    per = scenario_cpd(inputs)
    return per.groupBy("scenario", "scenario_order", "carbon_price").agg(
        F.avg("CPD").alias("avg_cpd"),
        F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
        F.count_if(C.is_high_or_critical("Risk_Category")).alias("high_critical"),
    ).withColumn("scenario_label", C.title_label("scenario"))


def cpd_stats_by_scenario(inputs: DataFrame) -> DataFrame:
    """CPD mean / population std / max per scenario."""
    return scenario_cpd(inputs).groupBy("scenario").agg(
        F.avg("CPD").alias("mean_cpd"), F.stddev_pop("CPD").alias("std_cpd"), F.max("CPD").alias("max_cpd"))


def stress_matrix(inputs: DataFrame) -> DataFrame:
    """Scenario x severity grid of average CPD, uplift, High/Critical count and share."""
    per = scenario_cpd(inputs, severities=True)
    return per.groupBy("scenario", "scenario_order", "carbon_price",
                       "severity_label", "severity", "severity_order").agg(
        F.avg("CPD").alias("avg_cpd"),
        F.avg("PD_Uplift_Pct").alias("avg_uplift_pct"),
        F.count_if(C.is_high_or_critical("Risk_Category")).alias("high_critical"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("high_critical_pct", F.col("high_critical") / F.col("n") * 100.0) \
     .withColumn("scenario_label", C.title_label("scenario"))


def stress_pivot(matrix: DataFrame, value: str = "avg_cpd") -> DataFrame:
    """Severities as columns (fixed column order), one row per scenario."""
    labels = [lab for lab, _ in config.SEVERITY_LEVELS]
    return matrix.groupBy("scenario_label").pivot("severity_label", labels).agg(F.first(value))


def projection(inputs: DataFrame, first_year: int = config.PROJECTION_FIRST_YEAR,
               ramp_end: int = config.PROJECTION_RAMP_END_YEAR,
               last_year: int = config.PROJECTION_LAST_YEAR,
               current_price: float = config.CURRENT_CARBON_PRICE) -> DataFrame:
    """Portfolio CPD path per scenario and year.

    Aggregate first (one row per scenario: average baseline and average CPD
    over the whole portfolio), then expand the 4 rows over the years.
    """
    per = scenario_cpd(inputs).groupBy("scenario", "carbon_price").agg(
        F.avg("Baseline_PD").alias("avg_baseline"), F.avg("CPD").alias("avg_cpd_full"))
    years = per.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    target = F.col("carbon_price")
    frac = (F.col("year") - F.lit(first_year)).cast("double") / float(ramp_end - first_year)
    price = F.when(F.col("year") <= ramp_end, C.lit_d(current_price) + (target - C.lit_d(current_price)) * frac) \
        .otherwise(target)
    return years.withColumn("carbon_price_year", price).withColumn(
        "avg_cpd", F.col("avg_baseline") + (F.col("avg_cpd_full") - F.col("avg_baseline"))
        * F.col("carbon_price_year") / (target + C.lit_d(1e-8))
    ).withColumn("scenario_label", C.title_label("scenario")) \
     .select("scenario", "scenario_label", "year", "carbon_price_year", "avg_cpd")


def ablation(inputs: DataFrame, scenario: str = "orderly", severity: float = config.SEVERITY_FACTOR,
             scaling: float = config.TRANSITION_SCALING) -> DataFrame:
    """Mean PD with no overlay, physical only, transition only, both; interaction term."""
    price = dims.scenario_price(scenario)
    phys = overlay.physical_pd("Baseline_PD", "hazard", severity)
    trans = overlay.transition_pd("Baseline_PD", "emission_intensity", "annual_inc", price, scaling)
    both = overlay.transition_pd(phys, "emission_intensity", "annual_inc", price, scaling)
    out = inputs.agg(
        F.avg("Baseline_PD").alias("mean_baseline"),
        F.avg(phys).alias("mean_physical"),
        F.avg(trans).alias("mean_transition"),
        F.avg(both).alias("mean_both"),
    )
    return out.withColumn(
        "interaction",
        (F.col("mean_both") - F.col("mean_baseline"))
        - ((F.col("mean_physical") - F.col("mean_baseline")) + (F.col("mean_transition") - F.col("mean_baseline"))),
    )


#: The modulus of the draws: a prime below 2^31, so every product of two residues fits a BIGINT.
DRAW_MODULUS = 2_147_483_647


def draw_steps(row: str, counter: str, seed: int) -> list[tuple[str, str]]:
    """A counter-based generator as SQL text that Spark and other engines read alike: (name, expression) in order.

    Residues of (row, counter) are mixed by squares and products; ``x3`` and ``x5`` are two draws below
    ``DRAW_MODULUS``.  Any row's draw can be had on its own, in any order and on any task.
    """
    m = DRAW_MODULUS
    return [("x0", f"(({row} % {m}) * 48271 + {counter} * 16807 + {seed}) % {m}"),
            ("x1", f"(x0 * x0 + 1013904223) % {m}"),
            ("x2", f"(x1 * 630360016 + x0) % {m}"),
            ("x3", f"(x2 * x2 + x1) % {m}"),
            ("x4", f"(x3 * 742938285 + x2) % {m}"),
            ("x5", f"(x4 * x4 + x3) % {m}")]


def proxy_sensitivity(inputs: DataFrame, error_rates=(0.10, 0.20, 0.30), trials: int = 100,
                      seed: int = config.RANDOM_STATE, scenario: str = "orderly",
                      severity: float = config.SEVERITY_FACTOR) -> DataFrame:
    """Replace the transition factor of a random share of loans by a random
    distinct factor; mean and population std over trials of the mean |CPD change|.

    What a loan's CPD changes by under each factor is computed once a loan (the distinct intensities are an
    array with at most one entry per sector).  Each (loan, rate, trial) then has two draws of its own of a
    counter-based generator: the first decides whether the factor is replaced, the second picks the new one.
    The fan-out is aggregated by rate and trial before any shuffle.
    """
    price = dims.scenario_price(scenario)
    factors = inputs.agg(F.array_sort(F.collect_set("emission_intensity")).alias("f")) \
        .select("f").scalar()
    phys = overlay.physical_pd("Baseline_PD", "hazard", severity)
    base_cpd = overlay.transition_pd(phys, "emission_intensity", "annual_inc", price)
    changes = F.transform("_factors", lambda f: F.abs(overlay.transition_pd(phys, f, "annual_inc", price) - base_cpd))
    fan = inputs.withColumn("_factors", factors).select("loan_id", base_cpd.isNotNull().alias("_counts"), changes.alias("_changes")) \
        .withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(error_rates) * trials - 1))))
    for name, text in draw_steps("loan_id", "run", seed):
        fan = fan.withColumn(name, F.expr(text))
    change = F.element_at("_changes", (F.floor(F.col("x5") * F.size("_changes") / float(DRAW_MODULUS)) + 1).cast("int"))
    rate = F.element_at(F.array(*map(C.lit_d, error_rates)), F.floor(F.col("run") / trials).cast("int") + 1)
    replaced = F.when(F.col("x3") < rate * DRAW_MODULUS, change).otherwise(C.lit_d(0.0))
    per_run = fan.groupBy("run").agg(F.avg(F.when(F.col("_counts"), replaced)).alias("mae"))
    return per_run.groupBy(rate.alias("rate")).agg(
        F.avg("mae").alias("mean_abs_cpd_change"), F.stddev_pop("mae").alias("std_abs_cpd_change"))
