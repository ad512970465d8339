"""Rates, means and their 90 % intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.casts import null_if

Z90 = 1.645  # two-sided 90 %


def wilson_rate(
    p: Column, n: Column, z: float = Z90, *, clip: bool = False, empty_unit: bool = True
) -> tuple[Column, Column]:
    """Wilson score interval around rate ``p`` over ``n`` trials.

    With no trials the interval is (0, 1) when ``empty_unit``, else unknown.
    """
    size = null_if(n.cast("double"), 0.0)
    z2 = z * z
    denom = 1 + z2 / size
    centre = (p + z2 / (2 * size)) / denom
    half = z * F.sqrt(p * (1 - p) / size + z2 / (4 * size * size)) / denom
    lo, hi = centre - half, centre + half
    if clip:
        lo = F.when(lo.isNotNull(), F.least(F.greatest(lo, F.lit(0.0)), F.lit(1.0)))
        hi = F.when(hi.isNotNull(), F.least(F.greatest(hi, F.lit(0.0)), F.lit(1.0)))
    if empty_unit:
        lo = F.when(n == 0, F.lit(0.0)).otherwise(lo)
        hi = F.when(n == 0, F.lit(1.0)).otherwise(hi)
    return lo, hi


def wilson(k: Column, n: Column, z: float = Z90) -> tuple[Column, Column]:
    """Wilson interval for ``k`` successes in ``n`` trials, kept within [0, 1]; null at n = 0."""
    p = k.cast("double") / null_if(n.cast("double"), 0.0)
    return wilson_rate(p, n, z, clip=True, empty_unit=False)


def mean_interval(mean: Column, std: Column, n: Column, z: float = Z90) -> tuple[Column, Column]:
    """mean ± z·s/√n; unknown for a single row, whose sample deviation is unknown."""
    half = z * (std / F.sqrt(null_if(n.cast("double"), 0.0)))
    return mean - half, mean + half


def direction(lo: Column, hi: Column) -> Column:
    """'above' or 'below' when the interval is clear of zero, 'same' when it touches it."""
    return (
        F.when(lo.isNull() | hi.isNull(), F.lit("none"))
        .when(lo > 0, F.lit("above"))
        .when(hi < 0, F.lit("below"))
        .otherwise(F.lit("same"))
    )


def share_pct(flag: Column, *, empty: float | None = None) -> Column:
    """Percent of rows where ``flag`` holds (unknown counts as no), an aggregate expression."""
    pct = 100 * F.avg(F.coalesce(flag, F.lit(False)).cast("double"))
    return pct if empty is None else F.coalesce(pct, F.lit(float(empty)))
