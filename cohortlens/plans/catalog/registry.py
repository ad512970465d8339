"""Named queries over the driver tables, each with the SQL it must agree with, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r(expression: str, digits: int = 6) -> str:
    """SQL rounding half up, written so that both engines do the same arithmetic."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def round_columns(df: DataFrame, names: str, digits: int = 6) -> DataFrame:
    """Rounds the named columns (space separated), so summing order does not show."""
    return df.withColumns({n: rounded(n, digits) for n in names.split()})


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """Lower and upper 90 % Wilson bound as SQL."""
    k, n = f"CAST({k} AS DOUBLE)", f"nullif(CAST({n} AS DOUBLE), 0)"
    p, z, z2 = f"({k} / {n})", "1.645", "2.706025"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n}))"

    def clip(bound: str) -> str:
        return f"CASE WHEN {bound} IS NOT NULL THEN least(greatest({bound}, 0.0), 1.0) END"

    return clip(f"({centre} - {half})"), clip(f"({centre} + {half})")


def direction_sql(lo: str, hi: str) -> str:
    return (
        f"CASE WHEN {lo} IS NULL OR {hi} IS NULL THEN 'none' WHEN {lo} > 0 THEN 'above' "
        f"WHEN {hi} < 0 THEN 'below' ELSE 'same' END"
    )
