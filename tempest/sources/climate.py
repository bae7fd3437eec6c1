"""Climate observation sources.

* ``read_climate_json``: records ``{lat, lon, T2M: {YYYYMM: v}, PRECTOTCORR: {YYYYMM: v}}``
  (the monthly point format of the public climate service) read with an
  explicit MapType schema and exploded to long form.
* ``fixture_climate``: stand-in observations from the driver's tables: per
  supplier nation (mapped to a state's coordinates) and ship month,
  ``t2m = avg(discount) * 300`` and ``precip = sum(quantity) / 1000``; a
  month whose line count is a multiple of 17 reports the -999 sentinel for
  temperature.  Only rows in the observation schema come out of here.
* ``read_feature_table`` / ``append_features``: the keyed, versioned feature
  table that replaces the per-location JSON cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.operators.climate import PRECIP, T2M, loc_key
from tempest.sources import dims
from tempest.sources.keyed import KeyedTable
from tempest.sources.loans import FIXTURE_STATES, table

RAW_SCHEMA = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField(T2M, T.MapType(T.StringType(), T.DoubleType())),
    T.StructField(PRECIP, T.MapType(T.StringType(), T.DoubleType())),
])

OBS_COLUMNS = ["loc_key", "variable", "month", "value"]


def long_from_maps(raw: DataFrame) -> DataFrame:
    """Two month->value maps per location to (loc_key, variable, month, value)."""
    k = loc_key("lat", "lon")
    t = raw.select(k.alias("loc_key"), F.lit(T2M).alias("variable"), F.explode(F.col(T2M)).alias("month", "value"))
    p = raw.select(k.alias("loc_key"), F.lit(PRECIP).alias("variable"),
                   F.explode(F.col(PRECIP)).alias("month", "value"))
    return t.unionByName(p)


def write_climate_json(obs: DataFrame, path: str) -> None:
    """Long observations as one JSON record per location (``RAW_SCHEMA``)."""
    def months(name: str):
        here = F.when(F.col("variable") == name, F.struct("month", "value"))
        return F.map_from_entries(F.collect_list(here)).alias(name)

    place = F.split("loc_key", "_")
    (obs.groupBy("loc_key").agg(months(T2M), months(PRECIP))
     .select(place[0].cast("double").alias("lat"), place[1].cast("double").alias("lon"), T2M, PRECIP)
     .write.mode("overwrite").json(path))


def read_climate_json(spark: SparkSession, path: str) -> DataFrame:
    return long_from_maps(spark.read.schema(RAW_SCHEMA).json(path))


def fixture_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation_state = dims.local_table(spark, list(enumerate(FIXTURE_STATES)), "nationkey int, state_key string")
    coords = dims.state_coords(spark).select("state_key", "loc_key")
    loc = F.broadcast(nation_state.join(coords, "state_key").select("nationkey", "loc_key"))
    monthly = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(loc, F.col("s_nationkey") == loc.nationkey)
        .groupBy("loc_key", F.date_format("l_shipdate", "yyyyMM").alias("month"))
        .agg(F.avg("l_discount").alias("d"), F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    )
    t2m = F.when(F.col("n") % 17 == 0, F.lit(-999.0)).otherwise(F.col("d") * 300.0)
    return monthly.select(
        "loc_key", "month",
        F.array(F.struct(F.lit(T2M).alias("variable"), t2m.alias("value")),
                F.struct(F.lit(PRECIP).alias("variable"), (F.col("q") / 1000.0).alias("value"))).alias("vals"),
    ).select("loc_key", "month", F.inline("vals")).select(*OBS_COLUMNS)


def fixture_climate_sql() -> str:
    states = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(FIXTURE_STATES))
    return f"""
SELECT loc_key, month, v.variable, v.value FROM (
  SELECT CAST(round(st.lat, 1) AS VARCHAR) || '_' || CAST(round(st.lon, 1) AS VARCHAR) AS loc_key,
         strftime(l_shipdate, '%Y%m') AS month, avg(l_discount) AS d, sum(l_quantity) AS q, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN states st ON st.state_key = (CASE s_nationkey {states} ELSE NULL END)
  WHERE st.lat IS NOT NULL
  GROUP BY 1, 2) m,
LATERAL (SELECT 'T2M' AS variable, CASE WHEN n % 17 = 0 THEN -999.0 ELSE d * 300.0 END AS value
         UNION ALL SELECT 'PRECTOTCORR', q / 1000.0) v"""


def feature_table(spark: SparkSession, path: str) -> KeyedTable:
    """The stored features, one row per location."""
    return KeyedTable(spark, path, ["loc_key"])


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    return feature_table(spark, path).read()


def append_features(features: DataFrame, path: str) -> None:
    """Put newly computed locations into the keyed feature table; a repeated or broken job leaves one row per location."""
    feature_table(features.sparkSession, path).upsert(features)
