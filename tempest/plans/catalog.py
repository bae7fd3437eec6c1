"""Registry of named queries and their DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame``; its oracle is SQL
text over the driver's tables.  Queries whose output is model-fitted or
random register no SQL and get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, Callable[[], str] | str] = {}
DOCS: dict[str, str] = {}


def register(name: str, sql: Callable[[], str] | str | None = None, ids: str = ""):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        DOCS[name] = ids
        return fn
    return deco


def oracle_text(name: str) -> str:
    s = ORACLE[name]
    return s() if callable(s) else s


def finish(df: DataFrame, money: tuple[str, ...] = (), digits: int = 6, money_digits: int = 2) -> DataFrame:
    """Round DOUBLE outputs (6 decimals, money 2) so both engines print equal values.

    ``floor(x * 10^d + 0.5) / 10^d`` is plain IEEE arithmetic and gives the
    same double in every engine, unlike ``round`` (Spark rounds the decimal
    text half-up, other engines round the binary value), which disagree on
    exact ties such as 179.8152075.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = money_digits if f.name in money else digits
            cols.append(fixed_round(F.col(f"`{f.name}`"), d).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def fixed_round(c, d: int = 6):
    scale = float(10 ** d)
    return (F.floor(c * scale + 0.5) / scale).cast("double")


def r(expr: str, digits: int = 6) -> str:
    scale = repr(float(10 ** digits))
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"
