"""Number formats for reports: missing values become a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _or_dash(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(DASH)).otherwise(text)


def _fixed(x: Column, digits: int) -> Column:
    """Fixed decimals, exact ties to the even digit, no thousands separators."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def pct(x: Column) -> Column:
    """0.29 -> '29.0%'."""
    return percent(100 * x)


def percent(x: Column) -> Column:
    """29.0 -> '29.0%'."""
    return one_decimal(x, "%")


def pct_short(x: Column) -> Column:
    """No decimals from 9.5 % up, one below."""
    text = F.when(F.abs(x) >= 0.095, _fixed(100 * x, 0)).otherwise(_fixed(100 * x, 1))
    return _or_dash(x, F.concat(text, F.lit("%")))


def usd(x: Column) -> Column:
    """1200000 -> '$1.2M', 350000 -> '$350k', 800 -> '$800'."""
    millions = F.concat(F.regexp_replace(_fixed(x / 1e6, 1), r"\.0$", ""), F.lit("M"))
    text = (
        F.when(F.bround(x / 1e3) >= 1000, millions)
        .when(x >= 1e3, F.concat(_fixed(x / 1e3, 0), F.lit("k")))
        .otherwise(_fixed(x, 0))
    )
    return _or_dash(x, F.concat(F.lit("$"), text))


def one_decimal(x: Column, suffix: str = "") -> Column:
    return _or_dash(x, F.concat(_fixed(x, 1), F.lit(suffix)))


def years(x: Column) -> Column:
    return one_decimal(x, " yrs")


def signed(x: Column, suffix: str = "", digits: int = 1) -> Column:
    """'+2.8' or '−3.9' with a true minus sign."""
    plus = F.when(x >= 0, F.lit("+")).otherwise(F.lit(""))
    return _or_dash(x, F.replace(F.concat(plus, _fixed(x, digits), F.lit(suffix)), F.lit("-"), F.lit("−")))


def points(x: Column) -> Column:
    return signed(x, " pts")


def count(n: Column) -> Column:
    return F.format_number(n, 0)
