"""Exact quantiles without a task that holds a column's distinct values.

``quantiles`` interpolates linearly between the order statistics, as ``percentile`` does, but in steps
that all stay distributed: rows are reduced to (group, value, count) where they are read; a value's
bucket (1/1024 of an octave, a fixed function of the value that keeps its order) gives a small table
of counts per bucket; its running sums tell which buckets hold the wanted order statistics; only the
values of those buckets are put in order.

That shuffles every distinct value once. A table that lies written is better read twice (``reread``): the
first time only buckets are counted, the second only rows of the wanted buckets leave the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 1024
_LOWEST = 1100  # below the exponent of every double


def value_bucket(v: Column) -> Column:
    """A long that never falls as the double ``v`` rises: one logarithm, whose result never falls either."""
    key = F.floor(F.ln(F.abs(v)) * (STEPS / math.log(2.0)) + _LOWEST * STEPS)
    return F.coalesce(key * F.signum(v), F.lit(0.0)).cast("long")  # the logarithm of 0 is null


def _same(names: Sequence[str], prefix: str) -> Column | None:
    out = None
    for c in names:
        eq = F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        out = eq if out is None else out & eq
    return out


def quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (), out: str = "q",
              reread: bool = False) -> DataFrame:
    """``by`` and an array of the quantiles ``probs`` of ``value`` (missing values left out).

    Without ``by`` one row; then the quantiles of no values are an array of nulls. ``reread``: ``df`` is cheap to
    read twice, so only counts of buckets and the values of the wanted ones are shuffled.
    """
    by = list(by)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if reread:
        counts = counts.withColumn("_n", F.lit(1))
    else:
        counts = counts.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_b", value_bucket(F.col("_v")))
    group = Window.partitionBy(*by)
    buckets = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_w"))
    buckets = buckets.select(*by, "_b", (F.sum("_w").over(group.orderBy("_b")) - F.col("_w")).alias("_start"), "_w",
                             F.sum("_w").over(group).alias("_total"))
    position = [F.lit(float(p)) * (F.col("_total") - 1).cast("double") for p in probs]
    wanted = [x.cast("long") for p in position for x in (F.floor(p), F.ceil(p))]
    holds = F.lit(False)
    for x in wanted:
        holds = holds | ((F.col("_start") <= x) & (x < F.col("_start") + F.col("_w")))
    keys = [*by, "_b"]
    same = F.col("_b") == F.col("_k_b")
    same = same & _same(by, "_k") if by else same
    near = buckets.where(holds).select(*[F.col(c).alias(f"_k{c}") for c in keys], "_start", "_total")
    if reread:  # near: two rows a quantile at most
        rows = counts.join(F.broadcast(near), same).groupBy(*keys, "_start", "_total", "_v").agg(F.sum("_n").alias("_n"))
    else:
        rows = counts.join(near, same)
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    rows = rows.select(*by, "_v", "_total", (F.col("_start") + upto).alias("_to"), "_n")
    here = [F.max(F.when((F.col("_to") - F.col("_n") <= x) & (x < F.col("_to")), F.col("_v"))).alias(f"_s{i}") for i, x in enumerate(wanted)]
    found = rows.groupBy(*by).agg(F.max("_total").alias("_total"), *here)

    def between(i: int, p: Column) -> Column:
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*by, F.array(*[between(i, p) for i, p in enumerate(position)]).alias(out))


def column_quantiles(df: DataFrame, cols: Sequence[str], p: float = 0.5, reread: bool = False) -> DataFrame:
    """One row with the quantile ``p`` of each column, under the column's name."""
    long_df = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_c", "_x")
    q = quantiles(long_df, "_x", [p], ["_c"], reread=reread)
    return q.agg(*[F.max(F.when(F.col("_c") == c, F.col("q")[0])).alias(c) for c in cols])


def quantile(df: DataFrame, value: str | Column, p: float) -> Column:
    """One quantile of a column as a scalar subquery."""
    return quantiles(df, value, [p]).select(F.col("q")[0]).scalar()
