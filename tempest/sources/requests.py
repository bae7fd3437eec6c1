"""Loan scoring requests arriving over time (stand-in for the request stream).

The driver's ``events`` table is read as a file stream (``ts`` is the event
time) and mapped onto the request schema of the scoring service: the
required fields, a few optional ones (sometimes missing) and some values
outside the allowed ranges, so that validation has work to do.  The mapping
is SQL text shared with the DuckDB oracle; scoring happens in
``tempest.streaming.jobs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempest.sources.loans import nation_state_sql

REQUEST_COLUMNS: list[tuple[str, str]] = [
    ("request_id", "event_id"),
    ("event_time", "CAST(ts AS TIMESTAMP)"),
    ("dti", "CAST(value AS DOUBLE) % 120.0"),
    ("annual_inc", "CAST(20000 + (user_id % 50) * 2000 AS DOUBLE)"),
    ("fico_range_low", "CAST(290 + (event_id * 37) % 570 AS DOUBLE)"),
    ("int_rate", "CAST(5 + event_id % 30 AS DOUBLE) + 0.5"),
    ("installment", "50.0 + CAST(value AS DOUBLE) * 2.0"),
    ("loan_amnt", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 1000.0 + CAST(value AS DOUBLE) * 100.0 END"),
    ("emp_length", "CAST(user_id % 12 AS DOUBLE)"),
    ("addr_state", nation_state_sql("(user_id % 25)")),
    ("purpose", "CASE event_type WHEN 'view' THEN 'car' WHEN 'signup' THEN 'debt_consolidation' "
                "WHEN 'click' THEN 'small_business' WHEN 'purchase' THEN 'Home Improvement' END"),
    # optional fields: missing, in range or, now and then, out of range
    ("revol_util", "CASE WHEN event_id % 61 = 0 THEN -1.0 WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END"),
    ("revol_bal", "CASE WHEN event_id % 67 = 0 THEN -5.0 ELSE CAST(event_id % 9000 AS DOUBLE) END"),
    ("open_acc", "CASE WHEN event_id % 71 = 0 THEN -1.0 ELSE CAST(event_id % 12 AS DOUBLE) END"),
    ("total_acc", "CASE WHEN event_id % 73 = 0 THEN -1.0 ELSE CAST(event_id % 30 AS DOUBLE) END"),
    ("pub_rec", "CASE WHEN event_id % 79 = 0 THEN -1.0 ELSE CAST(event_id % 2 AS DOUBLE) END"),
    ("delinq_2yrs", "CASE WHEN event_id % 83 = 0 THEN -1.0 ELSE CAST(event_id % 3 AS DOUBLE) END"),
    ("inq_last_6mths", "CASE WHEN event_id % 89 = 0 THEN -1.0 ELSE CAST(event_id % 4 AS DOUBLE) END"),
    ("acc_open_past_24mths", "CASE WHEN event_id % 97 = 0 THEN -1.0 ELSE CAST(event_id % 6 AS DOUBLE) END"),
    ("mort_acc", "CASE WHEN event_id % 101 = 0 THEN -1.0 ELSE CAST(event_id % 4 AS DOUBLE) END"),
    ("total_bc_limit", "CASE WHEN event_id % 103 = 0 THEN -1.0 ELSE CAST(event_id % 20000 AS DOUBLE) END"),
    ("total_rev_hi_lim", "CASE WHEN event_id % 107 = 0 THEN -1.0 ELSE CAST(event_id % 30000 AS DOUBLE) END"),
    ("mo_sin_rcnt_tl", "CASE WHEN event_id % 109 = 0 THEN -1.0 ELSE CAST(event_id % 40 AS DOUBLE) END"),
    ("mo_sin_old_rev_tl_op", "CASE WHEN event_id % 113 = 0 THEN -1.0 ELSE CAST(event_id % 300 AS DOUBLE) END"),
    ("num_actv_rev_tl", "CASE WHEN event_id % 127 = 0 THEN -1.0 ELSE CAST(event_id % 9 AS DOUBLE) END"),
    ("percent_bc_gt_75", "CASE WHEN event_id % 131 = 0 THEN -1.0 WHEN event_id % 59 = 0 THEN 101.0 ELSE CAST(event_id % 101 AS DOUBLE) END"),
    ("bc_util", "CASE WHEN event_id % 137 = 0 THEN -1.0 ELSE CAST(event_id % 110 AS DOUBLE) END"),
    ("mths_since_recent_inq", "CASE WHEN event_id % 139 = 0 THEN -1.0 WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 24 AS DOUBLE) END"),
    ("severity_factor", "CASE WHEN event_id % 149 = 0 THEN 1.5 WHEN event_id % 151 = 0 THEN -0.1 "
                        "WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) / 8.0 END"),
    ("transition_scaling", "CASE WHEN event_id % 157 = 0 THEN 1.5 WHEN event_id % 163 = 0 THEN -0.1 "
                           "WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 4 AS DOUBLE) / 8.0 END"),
    # all four scenarios, none at all and, now and then, unknown keys
    ("scenario", "CASE WHEN event_id % 167 = 0 THEN 'net_zero' WHEN event_id % 173 = 0 THEN 'Orderly' WHEN event_id % 10 = 3 THEN NULL "
                 "WHEN event_id % 4 = 0 THEN 'orderly' WHEN event_id % 4 = 1 THEN 'disorderly' WHEN event_id % 4 = 2 THEN 'hot_house' "
                 "ELSE 'too_little_too_late' END"),
]

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a file stream (glob path: the folder holds other tables too)."""
    events = spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parq*")
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in REQUEST_COLUMNS])


def request_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a static frame (batch form of the stream)."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in REQUEST_COLUMNS])


def requests_sql() -> str:
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in REQUEST_COLUMNS)
    return f"SELECT\n  {cols}\nFROM events"
