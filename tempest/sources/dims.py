"""Dimension DataFrames built from the fixed values in ``tempest.config``.

Every dimension here has a size fixed by the method itself (at most ~90
rows), which is the proven bound that makes ``broadcast`` safe for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest import config

STATE_SCHEMA = T.StructType([
    T.StructField("state_key", T.StringType(), False),
    T.StructField("physical_risk", T.DoubleType(), False),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("coast_km", T.DoubleType(), False),
    T.StructField("elev_m", T.DoubleType(), False),
    T.StructField("country", T.StringType(), False),
])

SECTOR_SCHEMA = T.StructType([
    T.StructField("sector_key", T.StringType(), False),
    T.StructField("emission_intensity", T.DoubleType(), False),
    T.StructField("policy_exposure", T.DoubleType(), False),
])

SCENARIO_SCHEMA = T.StructType([
    T.StructField("scenario", T.StringType(), False),
    T.StructField("carbon_price", T.DoubleType(), False),
    T.StructField("scenario_order", T.IntegerType(), False),
])

# Upper bound on every dimension defined here; asserted in tests.
MAX_DIM_ROWS = 128


def _sql_literal(v, dt: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dt.simpleString()})"
    if isinstance(dt, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dt, T.DoubleType):
        return f"CAST({float(v)!r} AS DOUBLE)"
    return f"CAST({int(v)} AS {dt.simpleString()})"


def local_table(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    """A small fixed table as an inline ``VALUES`` relation.

    The plan holds the rows themselves (``LocalTableScan``): no Python worker
    and no RDD is involved when a task reads them, unlike a frame built from
    a Python list.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    fields = schema.fields
    body = ", ".join("(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(row, fields)) + ")"
                     for row in rows)
    names = ", ".join(f"`{f.name}`" for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def state_dim(spark: SparkSession) -> DataFrame:
    """State key, static hazard, coordinates, coast distance and elevation.

    Includes the ``OTHER`` row (fallbacks, no coordinates).  US rows come
    first, then Indian rows (O1: the two coordinate maps as one union).
    """
    rows = config.state_rows()
    return F.broadcast(local_table(spark, rows, STATE_SCHEMA))


def state_coords(spark: SparkSession) -> DataFrame:
    """States that have coordinates, with their location key (R2)."""
    from tempest.operators.climate import loc_key  # local import avoids a cycle

    return F.broadcast(
        state_dim(spark)
        .where(F.col("lat").isNotNull())
        .select("state_key", "lat", "lon", loc_key("lat", "lon").alias("loc_key"))
    )


def sector_dim(spark: SparkSession) -> DataFrame:
    return F.broadcast(local_table(spark, config.sector_rows(), SECTOR_SCHEMA))


def scenario_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, float(v), i) for i, (k, v) in enumerate(config.CARBON_PRICES.items())]
    return F.broadcast(local_table(spark, rows, SCENARIO_SCHEMA))


def org_sector_dim(spark: SparkSession) -> DataFrame:
    schema = "organization_type string, sector string"
    return F.broadcast(local_table(spark, config.org_sector_rows(), schema))


def tier_dim(spark: SparkSession) -> DataFrame:
    rows = [(lab, i) for i, lab in enumerate(config.RISK_LABELS)]
    return F.broadcast(local_table(spark, rows, "Risk_Category string, tier_order int"))


def scenario_price(scenario: str) -> float:
    """Carbon price of a scenario; unknown keys price at 100 (low-level rule)."""
    return float(config.CARBON_PRICES.get(scenario, config.UNKNOWN_SCENARIO_PRICE))


def validate_scenario(scenario: str) -> str:
    """scenario keys must be known (raised before any job runs)."""
    if scenario not in config.CARBON_PRICES:
        raise ValueError(
            f"Unknown scenario {scenario!r}; expected one of {list(config.CARBON_PRICES)}"
        )
    return scenario


def scenario_array():
    """Scenario dimension as a literal array of structs (for ``explode``).

    Fanning loans out over 4 scenarios with ``explode`` keeps the work in a
    single Generate operator inside the scan stage: no join, no shuffle.
    """
    return F.array(*[
        F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("carbon_price"),
                 F.lit(i).alias("scenario_order"))
        for i, (k, v) in enumerate(config.CARBON_PRICES.items())
    ])


def severity_array():
    return F.array(*[
        F.struct(F.lit(lab).alias("severity_label"), F.lit(float(v)).alias("severity"),
                 F.lit(i).alias("severity_order"))
        for i, (lab, v) in enumerate(config.SEVERITY_LEVELS)
    ])
