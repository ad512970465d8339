"""Ages, elapsed years and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def completed_years(start: Column, end: Column) -> Column:
    """Whole years from start to end, turning over on the anniversary."""
    return F.floor(F.months_between(end, start) / 12).cast("int")


def age_one_decimal(birth: Column, at: Column) -> Column:
    """Completed years plus the part of a year since the last birthday, cut to one decimal."""
    years = completed_years(birth, at)
    birthday = F.add_months(birth, years * 12)
    return F.floor(10 * (years + F.datediff(at, birthday) / DAYS_PER_YEAR)) / 10


def elapsed_years(start: Column, end: Column) -> Column:
    """Years between two dates, one decimal."""
    return F.round(F.datediff(end, start) / DAYS_PER_YEAR, 1)


def first_date_of_range(text: Column) -> Column:
    """First day named in text like 'June 10–11, 2020'; null when there is none."""
    pattern = r"(?s)([A-Z][a-z]+)\s+(\d{1,2})\b.*?(\d{4})"
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.to_date(F.try_to_timestamp(F.concat_ws(" ", *parts), F.lit("MMMM d yyyy")))


def by_period(period: Column, cut: int, until: Column, after: Column) -> Column:
    """The snapshot in force: ``until`` up to and including ``cut``, ``after`` later."""
    return F.when(period <= cut, until).otherwise(after)


def step_by_period(period: Column, steps: list[tuple[int, int]], last: int) -> Column:
    """Step function: value of the first step whose end is at or after ``period``."""
    out = F
    for end, value in steps:
        out = out.when(period <= end, value)
    return out.otherwise(last)
