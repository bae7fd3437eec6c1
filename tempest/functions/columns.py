"""Column expressions shared by the operators.

All of these are plain Catalyst expressions (no Python at run time), so
they stay inside whole-stage code generation.  ANSI mode is on in Spark 4:
parsing of untrusted text uses ``try_*`` functions and every division that
can meet a zero is a ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempest import config


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def to_double(c) -> Column:
    """Numeric coercion, invalid text to NULL (pandas ``to_numeric(errors='coerce')``).

    NaN text becomes NULL as well, so aggregates skip it like pandas does.
    """
    x = col_(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def to_double_or(c, default: float) -> Column:
    """Numeric coercion with invalid / missing to a default."""
    return F.coalesce(to_double(c), lit_d(default))


def percent_to_double(c) -> Column:
    """P2: '12.5%' -> 12.5; bad text -> NULL."""
    return to_double(F.replace(col_(c).cast("string"), F.lit("%"), F.lit("")))


def first_digits(c, default: float) -> Column:
    """First run of digits as a number, else ``default``."""
    digits = F.regexp_extract(col_(c).cast("string"), r"(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), lit_d(default))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """NULL-preserving clip (``least``/``greatest`` alone skip NULL)."""
    x = col_(c)
    y = x
    if lo is not None:
        y = F.greatest(y, lit_d(lo))
    if hi is not None:
        y = F.least(y, lit_d(hi))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(y)


def safe_div(num, den) -> Column:
    return F.try_divide(col_(num), col_(den))


def strip_key(c) -> Column:
    """Python ``str.strip()`` (all leading/trailing whitespace)."""
    return F.regexp_replace(col_(c).cast("string"), r"^\s+|\s+$", "")


def sector_key(c) -> Column:
    """Lower case, spaces to underscores."""
    return F.replace(F.lower(col_(c).cast("string")), F.lit(" "), F.lit("_"))


def right_closed_bin(c, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """``pd.cut(..., include_lowest=True)``.

    First interval closed on both sides, the others (a, b]; outside -> NULL.
    (Spark ML ``Bucketizer`` is left-closed and cannot be used here.)
    """
    x = col_(c)
    labels = list(labels) if labels is not None else [float(i) for i in range(len(edges) - 1)]
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (x >= lit_d(lo)) & (x <= lit_d(hi)) if i == 0 else (x > lit_d(lo)) & (x <= lit_d(hi))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def risk_tier(c) -> Column:
    """Low / Medium / High / Critical with 0 included."""
    return right_closed_bin(c, config.RISK_BINS, config.RISK_LABELS)


def is_high_or_critical(c) -> Column:
    """F5."""
    return col_(c).isin("High", "Critical")


def sub_grade_ordinal(c) -> Column:
    """P5: A1=1 ... G5=35 by rule, others 18."""
    g = col_(c).cast("string")
    valid = g.rlike("^[A-G][1-5]$")
    ordinal = (F.ascii(F.substring(g, 1, 1)) - 65) * 5 + F.substring(g, 2, 1).try_cast("int")
    return F.when(valid, ordinal.cast("double")).otherwise(lit_d(config.SUB_GRADE_DEFAULT))


def verification_ordinal(c) -> Column:
    """P6."""
    x = col_(c)
    expr = None
    for k, v in config.VERIFICATION_MAP.items():
        expr = F.when(x == k, lit_d(v)) if expr is None else expr.when(x == k, lit_d(v))
    return expr.otherwise(lit_d(0.0))


def credit_history_months(c) -> Column:
    """Months from 'Mon-YYYY' to 2018-01-01; unparsable -> 180."""
    d = F.try_to_date(col_(c).cast("string"), "MMM-yyyy")
    days = F.datediff(F.to_date(F.lit(config.CREDIT_HISTORY_ANCHOR)), d)
    return F.coalesce(days.cast("double") / lit_d(config.DAYS_PER_MONTH), lit_d(180.0))


def default_flag(c) -> Column:
    """1 when the status is a default status, NULL status -> 0."""
    return F.when(col_(c).isin(*config.DEFAULT_STATUSES), F.lit(1)).otherwise(F.lit(0))


def uplift_pct(pd_col, cpd_col) -> Column:
    """R9."""
    return (col_(cpd_col) - col_(pd_col)) / (col_(pd_col) + lit_d(config.UPLIFT_EPS)) * lit_d(100.0)


def sigmoid(z) -> Column:
    return lit_d(1.0) / (lit_d(1.0) + F.exp(-col_(z)))


def title_label(c) -> Column:
    """P36: 'hot_house' -> 'Hot House'."""
    return F.initcap(F.replace(col_(c), F.lit("_"), F.lit(" ")))


def bubble_radius(n) -> Column:
    """max(6, min(25, 4 + 2.5 * ln(1 + n)))."""
    return F.greatest(lit_d(6.0), F.least(lit_d(25.0), lit_d(4.0) + lit_d(2.5) * F.log1p(col_(n).cast("double"))))


def fixed_round_col(c, d: int) -> Column:
    """Round half up at ``d`` decimals by ``floor(x * 10^d + 0.5) / 10^d`` (same double in every engine)."""
    scale = float(10 ** d)
    return (F.floor(col_(c) * scale + 0.5) / scale).cast("double")

