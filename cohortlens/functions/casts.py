"""Typed projections and null rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if(c: Column, *sentinels) -> Column:
    """Null where ``c`` equals a sentinel such as 0 or an empty string."""
    return F.when(~c.isin(*sentinels), c)


def is_true(c: Column) -> Column:
    """A flag with unknown read as false."""
    return F.coalesce(c, F.lit(False))


def leading_token(c: Column, allowed: Iterable[str]) -> Column:
    """First word, upper-cased, when it is one of ``allowed``: '4YR JR' -> '4YR'."""
    token = F.upper(F.split_part(F.trim(c), F.lit(" "), F.lit(1)))
    return F.when(token.isin(*allowed), token)


def whole_number(c: Column) -> Column:
    """Text as an int, null when it is not one; '5.0' is 5.

    The text is looked at first: a failing cast costs an exception, and labels often fail.
    """
    text = c.cast("string")
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)(?:\.0*)?\s*$", 1)
    return F.when(digits != "", digits).try_cast("int")


def parse_money(c: Column) -> Column:
    """'$1,250,000' or '1250000' as a double; anything else is null."""
    bare = F.regexp_replace(c.cast("string"), r"[$,\s]", "")
    number = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(number, bare).try_cast("double")


def yes_no(c: Column) -> Column:
    """'Y' -> true, 'N' -> false, anything else null."""
    return F.when(c == "Y", F.lit(True)).when(c == "N", F.lit(False))


def text_flag(c: Column) -> Column:
    """'True' in any case is true; every other text, and null, is false."""
    return is_true(F.lower(c) == "true")


def relabel(c: Column, old: str, new: str) -> Column:
    return F.when(c == old, F.lit(new)).otherwise(c)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null for a zero denominator."""
    return num / null_if(den, 0)
