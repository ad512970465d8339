"""Cohort filters, populations and per-row metric values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import is_true
from cohortlens.operators.spread import hot_keys, lookup_join


@dataclass(frozen=True)
class FilterSpec:
    """Inclusive ranges and IN-lists per column; an empty list means every value."""

    ranges: Mapping[str, tuple] = field(default_factory=dict)
    members: Mapping[str, Sequence] = field(default_factory=dict)

    def condition(self) -> Column:
        out = F.lit(True)
        for column, (first, last) in self.ranges.items():
            out = out & F.col(column).between(first, last)
        for column, chosen in self.members.items():
            if chosen:
                out = out & F.col(column).isin(*chosen)
        return out

    def baseline(self, keep: Sequence[str]) -> FilterSpec:
        """The same period with every other choice cleared."""
        return FilterSpec({c: r for c, r in self.ranges.items() if c in keep})

    def chosen(self) -> tuple:
        """What the spec narrows, in a form two specs can be compared by."""
        lists = {c: tuple(v) for c, v in self.members.items() if v}
        return dict(self.ranges), lists


def apply_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.filter(spec.condition())


def matching_preset(spec: FilterSpec, presets: Mapping[str, FilterSpec]) -> str | None:
    """Name of the first preset that narrows exactly what ``spec`` does."""
    return next((name for name, p in presets.items() if p.chosen() == spec.chosen()), None)


@dataclass(frozen=True)
class Rules:
    """Whether entities that were not credited count in outcome denominators."""

    count_uncredited: bool = False


@dataclass(frozen=True)
class OutcomeColumns:
    """Column names of a fact table of entity events and their outcomes."""

    period: str = "draft_year"
    sequence: str = "pick_number"
    eligible: str = "outcome_eligible"
    credited: str = "signed"
    reached: str = "reached_mlb"
    high: str = "became_regular"
    money: str = "bonus_usd"
    value: str = "career_war"
    delay: str = "years_to_debut"
    tier: str = "outcome_tier"
    exp_reached: str = "exp_mlb_all"
    exp_high: str = "exp_regular_all"
    reached_diff: str = "mlb_minus_exp"
    high_diff: str = "regular_minus_exp"


@dataclass(frozen=True)
class Metric:
    """How a metric reads a row: its value, and which rows it is defined on."""

    key: str
    kind: Literal["rate", "mean", "median"]
    outcome: bool
    unit: str
    value: Callable[[Rules], Column]
    known_only: bool = False
    keep: Callable[[], Column] | None = None


def standard_metrics(c: OutcomeColumns | None = None) -> dict[str, Metric]:
    """The eight metrics over an outcome fact table."""
    c = c or OutcomeColumns()

    def flag(name):
        return lambda rules: is_true(F.col(name)).cast("double")

    def plain(name):
        return lambda rules: F.col(name).cast("double")

    def points(observed, expected, credited_diff):
        def value(rules):
            if rules.count_uncredited:
                return 100 * (is_true(F.col(observed)).cast("double") - F.col(expected))
            return 100 * F.col(credited_diff)

        return value

    metrics = [
        Metric("mlb_vs_slot", "mean", True, "pts", points(c.reached, c.exp_reached, c.reached_diff), True),
        Metric("regular_vs_slot", "mean", True, "pts", points(c.high, c.exp_high, c.high_diff), True),
        Metric("mlb_pct", "rate", True, "pct", flag(c.reached)),
        Metric("regular_pct", "rate", True, "pct", flag(c.high)),
        Metric("median_bonus", "median", False, "usd", plain(c.money), True),
        Metric("signed_pct", "rate", False, "pct", flag(c.credited)),
        Metric("war_per_player", "mean", True, "war", plain(c.value), True),
        Metric("years_to_debut", "median", True, "years", plain(c.delay), True, lambda: is_true(F.col(c.reached))),
    ]
    return {m.key: m for m in metrics}


def in_population(rules: Rules | None = None, c: OutcomeColumns | None = None) -> Column:
    """Eligible rows, and only credited ones unless the rules count the others."""
    c = c or OutcomeColumns()
    eligible = is_true(F.col(c.eligible))
    if rules is not None and rules.count_uncredited:
        return eligible
    return eligible & is_true(F.col(c.credited))


def population(df: DataFrame, rules: Rules | None = None, c: OutcomeColumns | None = None) -> DataFrame:
    return df.filter(in_population(rules, c))


def metric_values(
    df: DataFrame, metric: Metric, rules: Rules | None = None, c: OutcomeColumns | None = None
) -> DataFrame:
    """The rows a metric is computed over, with its per-row value in ``x``."""
    rules = rules or Rules()
    rows = population(df, rules, c) if metric.outcome else df
    if metric.keep is not None:
        rows = rows.filter(metric.keep())
    rows = rows.withColumn("x", metric.value(rules))
    return rows.filter(F.col("x").isNotNull()) if metric.known_only else rows


def money_population(
    df: DataFrame,
    c: OutcomeColumns | None = None,
    *,
    periods: tuple[int, int] | None = None,
    known: Sequence[str] = (),
    within: Column | None = None,
) -> DataFrame:
    """Credited outcome rows with money and tier known; the narrower view also wants a period
    window, further known columns and a cut such as the first rounds."""
    c = c or OutcomeColumns()
    rows = population(df, Rules(), c)
    condition = F.col(c.money).isNotNull() & F.col(c.tier).isNotNull()
    if periods:
        condition = condition & F.col(c.period).between(*periods)
    for name in known:
        condition = condition & F.col(name).isNotNull()
    return rows.filter(condition if within is None else condition & within)


def money_points(
    df: DataFrame, c: OutcomeColumns | None = None, *, axis_floor: float = 1000.0
) -> DataFrame:
    """Credited outcome rows with money above zero, and the value drawn on a log axis."""
    c = c or OutcomeColumns()
    rows = population(df, Rules(), c).filter(F.col(c.money) > 0)
    return rows.withColumn("axis_value", F.greatest(F.col(c.money), F.lit(axis_floor)))


def leading_cut(
    df: DataFrame, full: DataFrame, group: str, order: str, label: str, last, *, spread: Sequence[str]
) -> DataFrame:
    """Rows up to the last position labelled ``last`` in their group.

    The cut comes from the unfiltered table, so rows without a label inside it stay, and groups
    that never reach the label drop out.
    """
    cuts = full.filter(F.col(label) == last).groupBy(group).agg(F.max(order).alias("_cut"))
    hot = hot_keys(df, [group])
    kept = lookup_join(df, cuts, [group], spread=spread, how="inner", hot=hot)
    return kept.filter(F.col(order) <= F.col("_cut")).drop("_cut")


def options(
    df: DataFrame, column: str, narrow: Mapping[str, Sequence] | None = None, tail: Sequence[str] = ()
) -> DataFrame:
    """Values to offer under the other choices, alphabetical, special groups last."""
    spec = FilterSpec(members=narrow or {})
    values = apply_filter(df, spec).select(column).filter(F.col(column).isNotNull()).distinct()
    place = F.array_position(F.array(*[F.lit(t) for t in tail]), F.col(column)) if tail else F.lit(0)
    return values.withColumn("_place", place).orderBy("_place", column).drop("_place")


def export_table(
    df: DataFrame, columns: Mapping[str, Column | str], order: Sequence[Column | str]
) -> DataFrame:
    """Named output columns in display order."""
    ordered = df.orderBy(*order)
    return ordered.select(
        [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()]
    )
