"""Spark-side base plans shared by the registered queries.

``portfolio``: fixture loan rows -> cleaning (load_data) -> scorecard PD ->
CPD overlay for one scenario.  Everything up to here is one map-side stage
per input plus the fixture's joins; the registered queries add their own
aggregation on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempest import config
from tempest.operators import cleaning, overlay, scoring
from tempest.sources.loans import fixture_loans


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_loans(fixture_loans(spark, sf_dir))


def with_pd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scorecard_pd(clean(spark, sf_dir))


def portfolio(spark: SparkSession, sf_dir: str, scenario: str = "orderly",
              severity: float = config.SEVERITY_FACTOR, hazard="static") -> DataFrame:
    """Scored portfolio (R8).  Incomplete rows were dropped by cleaning (F1), so
    income needs no imputation here."""
    return overlay.score_cpd(with_pd(spark, sf_dir), scenario=scenario, severity=severity,
                             hazard=hazard, impute_income=False)


# Second logistic scorecard: a competing score on the same loans, so that
# two correlated scores can be compared (DeLong, ranking of models).
SECOND_INTERCEPT = -2.6
SECOND_WEIGHTS = [
    # (feature, centre, weight)
    ("dti", 15.0, 0.035),
    ("fico_range_low", 690.0, -0.004),
    ("int_rate", 12.0, 0.03),
]


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in input of the evaluation jobs: (id, label, p_a, p_b).

    ``label`` is the loan's default flag, ``p_a`` the scorecard PD and ``p_b``
    the second scorecard, both rounded to 3 decimals so that tied scores occur.
    The narrow table is checkpointed once: every metric reads it several times
    (counts, quantiles, subqueries), and none of them goes back to the join.
    """
    from tempest.session import cut_lineage
    from pyspark.sql import functions as F

    from tempest.plans.catalog import fixed_round

    df = scoring.scorecard_pd(with_pd(spark, sf_dir), weights=SECOND_WEIGHTS,
                              intercept=SECOND_INTERCEPT, out="_pd_b")
    return cut_lineage(df.select(F.col("loan_id").alias("id"), F.col("default").alias("label"),
                                 fixed_round(F.col("Baseline_PD"), 3).alias("p_a"),
                                 fixed_round(F.col("_pd_b"), 3).alias("p_b")))
