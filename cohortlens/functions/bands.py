"""Bands, tiers and first-rule-wins labels as CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(
    c: Column,
    edges: Sequence[tuple[float, str]],
    last: str | None,
    *,
    inclusive: bool = True,
    null_label: str | None = None,
    overrides: Sequence[tuple[Column, str]] = (),
) -> Column:
    """Label of the first edge at or above ``c`` (strictly above when not ``inclusive``).

    ``overrides`` are conditions that win before any edge; ``null_label`` names the band of a
    missing value, which stays null by default; ``last`` labels values past every edge.
    """
    out = F
    for condition, label in overrides:
        out = out.when(condition, F.lit(label))
    out = out.when(c.isNull(), F.lit(null_label))
    for edge, label in edges:
        out = out.when(c <= edge if inclusive else c < edge, F.lit(label))
    return out.otherwise(F.lit(last))


def range_band(
    c: Column, ranges: Sequence[tuple[int, int | None, str]], otherwise: str | None = None
) -> Column:
    """Label of the closed range holding ``c``; an open end is ``None``."""
    out = F
    for first, last, label in ranges:
        inside = c >= first if last is None else c.between(first, last)
        out = out.when(inside, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def ratio_band(
    ratio: Column, low: float, high: float, labels: tuple[str, str, str]
) -> Column:
    """Below / within / above a tolerance; a null ratio has no band."""
    below, within, above = labels
    return F.when(ratio < low, below).when(ratio <= high, within).when(ratio > high, above)


def first_rule(rules: Sequence[tuple[Column, Column | str]], otherwise=None) -> Column:
    """Result of the first rule whose condition holds."""
    out = F
    for condition, result in rules:
        out = out.when(condition, result if isinstance(result, Column) else F.lit(result))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def tier_order(
    value: Column,
    thresholds: Sequence[float],
    *,
    in_window: Column,
    credited: Column,
    reached: Column,
) -> Column:
    """Ordinal outcome: 0 not credited, 1 never reached, then one step per threshold.

    Rows outside the window, and credited rows that reached but whose value is unknown, have
    no tier.
    """
    steps = F.lit(2)
    for t in thresholds:
        steps = steps + (value >= t).cast("int")
    return F.when(in_window, F.when(~credited, 0).when(~reached, 1).otherwise(steps))


def ordinal_label(order: Column, labels: Sequence[str]) -> Column:
    """Label at a 0-based position; null stays null."""
    return F.get(F.array(*[F.lit(x) for x in labels]), order.cast("int"))


def label_order(c: Column, labels: Sequence[str]) -> Column:
    """Declared position of a label, 0-based, for sorting categories; unknown labels are null."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), c)
    return F.when(position > 0, (position - 1).cast("int"))
