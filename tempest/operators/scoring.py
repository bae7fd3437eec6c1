"""Baseline PD scorers.

The CPD pipeline takes its baseline PD from any column expression or any
Spark ML model with a ``probability`` column (the pluggable point of the
method).  ``scorecard_pd`` is a fixed logistic scorecard; it is what the
SQL-checked queries use, because its output is a closed form the oracle can
recompute.  Fitted Spark ML models are applied by ``tempest.operators.model``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.functions import columns as C
from tempest.operators import cleaning

# Logistic scorecard: weights on centred features, logit scale.
SCORECARD_INTERCEPT = -3.0
SCORECARD_WEIGHTS = [
    # (feature, centre, weight)
    ("dti", 15.0, 0.02),
    ("fico_range_low", 690.0, -0.006),
    ("int_rate", 12.0, 0.06),
]


def scorecard_pd(df: DataFrame, weights=SCORECARD_WEIGHTS, intercept: float = SCORECARD_INTERCEPT,
                 impute: bool = True, out: str = "Baseline_PD") -> DataFrame:
    """sigmoid(intercept + sum(w * (x - centre))).

    Missing inputs are filled with the batch median (P12) inside the
    expression only; the caller's columns keep their original values.  The
    medians are one aggregate entering as a scalar subquery.
    """
    feats = [f for f, _, _ in weights]
    if impute:
        med = cleaning.medians_row(df, feats).select(F.struct(*feats).alias("m")).scalar()
        value = {f: F.coalesce(F.col(f), med.getField(f)) for f in feats}
    else:
        value = {f: F.col(f) for f in feats}
    z = C.lit_d(intercept)
    for f, centre, w in weights:
        z = z + C.lit_d(w) * (value[f] - C.lit_d(centre))
    return df.withColumn(out, C.sigmoid(z))
