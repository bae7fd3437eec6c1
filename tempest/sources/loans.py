"""Loan portfolio sources.

* ``read_loan_csv`` (S1): CSV scan of the 32 raw columns, everything read
  as STRING and typed later with ``try_*`` casts, optional demo row limit.
* ``read_upload_csv`` (S2): header-driven CSV scan of all columns.
* ``fixture_loans``: the driver's test tables hold no loans, so this maps
  ``orders`` + ``customer`` + per-order ``lineitem`` totals onto the raw
  loan schema.  It only produces rows in that schema (text fields such as
  '12.5%', '10+ years', 'Jan-2010', unknown states and purposes included);
  all cleaning, scoring and aggregation happen in the operators.

The fixture is a list of SQL expressions so the same stand-in rows can be
produced by Spark (``selectExpr``) and by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest import config

def read_loan_csv(spark: SparkSession, path: str, limit: int | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Scan the 32 raw columns (plus ``keep``, e.g. an id) as STRING; the CSV reader prunes the rest.

    ``limit``: a demo's bound on the rows, off by default.
    """
    df = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    missing = [c for c in config.RAW_COLS if c not in df.columns]
    if missing:
        raise ValueError(f"CSV lacks raw columns: {missing}")
    df = df.select(*[F.col(c) for c in keep], *[F.col(c).cast("string") for c in config.RAW_COLS])
    return df.limit(limit) if limit is not None else df


def read_upload_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns, header-driven, everything STRING."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# Fixture mapping of the driver's tables onto the raw loan schema.
# ---------------------------------------------------------------------------
FIXTURE_STATES = [
    "CA", "TX", "NY", "FL", "LA", "IL", "OH", "PA", "GA", "NC", "WA", "AZ",
    "Odisha", "Kerala", "Maharashtra", "Tamil Nadu", "Bihar", "Uttar Pradesh",
    "Rajasthan", "West Bengal", "Gujarat",
]
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _case(expr: str, mapping: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in mapping)
    return f"CASE {expr} {whens} ELSE {default} END"


def nation_state_sql(col: str) -> str:
    """Nation key to a state text (22 blank-padded FL, 21 empty, 23 unknown, 24 NULL)."""
    m = [(str(i), f"'{s}'") for i, s in enumerate(FIXTURE_STATES)]
    m += [("21", "''"), ("22", "' FL '"), ("23", "'ZZ'")]
    return _case(col, m, "NULL")


_K = "o_orderkey"
_C = "o_custkey"

FIXTURE_LOAN_COLUMNS: list[tuple[str, str]] = [
    ("loan_id", _K),
    # loans with much debt, a low score and a high rate default more often, next to chance
    ("loan_status", f"CASE WHEN {_K} % 29 = 0 THEN NULL "
                    f"WHEN {_K} % 1010 + 559 - ({_K} * 37) % 560 + 20 * ({_K} % 26) + ({_K} * 7919) % 970 <= 1900 THEN 'Fully Paid' "
                    f"WHEN {_K} % 3 = 0 THEN 'Charged Off' WHEN {_K} % 3 = 1 THEN 'Default' ELSE 'Late (31-120 days)' END"),
    ("loan_amnt", "o_totalprice / 20"),
    ("dti", f"CASE WHEN {_K} % 41 = 0 THEN NULL ELSE CAST({_K} % 1010 AS DOUBLE) / 10 END"),
    ("annual_inc", f"CASE WHEN {_C} % 53 = 0 THEN NULL ELSE (c_acctbal + 1500) * 12 END"),
    ("fico_range_low", f"CAST(300 + ({_K} * 37) % 560 AS DOUBLE)"),
    ("int_rate", f"CASE WHEN {_K} % 97 = 0 THEN 'n/a' ELSE CONCAT(CAST(5 + {_K} % 26 AS STRING), '.5%') END"),
    ("installment", f"o_totalprice / 20 / (CASE WHEN {_K} % 3 = 0 THEN 60 ELSE 36 END) * CAST(1.15 AS DOUBLE)"),
    ("emp_length", f"CASE WHEN {_C} % 13 = 0 THEN 'n/a' WHEN {_C} % 12 >= 10 THEN '10+ years' "
                   f"WHEN {_C} % 12 = 0 THEN '< 1 year' ELSE CONCAT(CAST({_C} % 12 AS STRING), ' years') END"),
    ("home_ownership", _case(f"{_C} % 3", [("0", "'RENT'"), ("1", "'OWN'")], "'MORTGAGE'")),
    ("purpose", f"CASE WHEN {_K} % 101 = 0 THEN NULL WHEN {_K} % 7 = 0 THEN 'Debt Consolidation' ELSE "
                + _case("c_mktsegment", [("'AUTOMOBILE'", "'Car'"), ("'MACHINERY'", "'manufacturing'"),
                                         ("'BUILDING'", "'Home Improvement'"),
                                         ("'HOUSEHOLD'", "'renewable_energy'")], "'furniture'")
                + " END"),
    ("addr_state", nation_state_sql("c_nationkey")),
    ("revol_util", f"CASE WHEN {_K} % 89 = 0 THEN NULL ELSE CONCAT(CAST({_K} % 120 AS STRING), '%') END"),
    ("revol_bal", "sum_qty * 150"),
    ("open_acc", "n_lines"),
    ("total_acc", f"n_lines + {_K} % 20"),
    ("pub_rec", f"CASE WHEN {_K} % 5 = 0 THEN 1 ELSE 0 END"),
    ("delinq_2yrs", f"{_K} % 4"),
    ("inq_last_6mths", f"{_K} % 6"),
    ("term", f"CASE WHEN {_K} % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END"),
    ("sub_grade", f"CONCAT(CHR(CAST(65 + {_K} % 8 AS INTEGER)), CAST(({_K} * 7) % 6 AS STRING))"),
    ("verification_status", _case(f"{_K} % 4", [("0", "'Not Verified'"), ("1", "'Source Verified'"),
                                               ("2", "'Verified'")], "'Unknown'")),
    ("earliest_cr_line", f"CASE WHEN {_K} % 50 = 0 THEN 'bad' ELSE CONCAT("
                         + _case(f"{_K} % 12", [(str(i), f"'{m}'") for i, m in enumerate(_MONTHS)], "NULL")
                         + f", '-', CAST(1985 + {_K} % 30 AS STRING)) END"),
    ("acc_open_past_24mths", f"{_K} % 9"),
    ("mort_acc", f"{_C} % 4"),
    ("total_bc_limit", "(c_acctbal + 1000) * 3"),
    ("total_rev_hi_lim", "(c_acctbal + 1000) * 5"),
    ("mo_sin_rcnt_tl", f"{_K} % 30"),
    ("mo_sin_old_rev_tl_op", f"50 + {_K} % 300"),
    ("num_actv_rev_tl", f"{_K} % 12"),
    ("percent_bc_gt_75", f"({_K} * 7) % 101"),
    ("bc_util", f"({_K} * 13) % 120"),
    ("mths_since_recent_inq", f"CASE WHEN {_K} % 11 = 0 THEN NULL ELSE {_K} % 24 END"),
    ("issue_d", "CAST(o_orderdate AS DATE)"),
]


def fixture_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan rows (schema of ``config.RAW_COLS`` plus ``loan_id``) from the test tables.

    Joins: orders x customer on the customer key (sort-merge at scale, no
    broadcast: customer grows with the data) and a left join to per-order
    lineitem totals (the aggregate is hash-partitioned on the order key, so
    the join reuses that partitioning).
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"))
    )
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    )
    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in FIXTURE_LOAN_COLUMNS])


def fixture_loans_sql() -> str:
    """The same stand-in rows as SQL text (used by the DuckDB oracle)."""
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in FIXTURE_LOAN_COLUMNS)
    return (
        "SELECT\n  " + cols + "\nFROM orders\n"
        "JOIN customer ON o_custkey = c_custkey\n"
        "LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty "
        "FROM lineitem GROUP BY l_orderkey) li ON o_orderkey = li.l_orderkey"
    )
