"""Data-quality checks: one pass for all row rules, reductions for the rest, one result table.

A result row is (name, category, status, value, threshold, detail, examples); ``examples`` holds
up to 20 offending rows as JSON text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import is_true, whole_number
from cohortlens.functions.intervals import share_pct, wilson_rate
from cohortlens.operators.expect import curve_rises
from cohortlens.operators.spread import duplicated

MAX_EXAMPLES = 20
COLUMNS = ["name", "category", "status", "value", "threshold", "detail"]


@dataclass(frozen=True)
class Check:
    """A rule decided by one aggregate over the table.

    ``value`` is an aggregate, ``status`` turns it into pass / warn / fail, and ``bad`` selects
    the rows shown as examples.
    """

    name: str
    category: str
    value: Column
    status: Callable[[Column], Column]
    detail: str
    threshold: float | None = None
    bad: Column | None = None
    show: tuple[str, ...] = ()
    more: Column | None = None  # an aggregate in words that is added to the detail


def any_is(level: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v > 0, F.lit(level)).otherwise(F.lit("pass"))


def rule(name: str, category: str, bad: Column, level: str, detail: str, show=()) -> Check:
    """No row may break the rule; unknown does not break it."""
    broken = is_true(bad)
    return Check(
        name, category, F.count_if(broken), any_is(level), detail, 0.0, broken, tuple(show)
    )


def implication(name: str, premise: Column, conclusion: Column, detail: str, show=()) -> Check:
    """Where the premise holds the conclusion must, else the build fails."""
    broken = is_true(premise) & ~is_true(conclusion)
    return rule(name, "business_logic", broken, "fail", detail, show)


def outside_range(name: str, column: str, low: float, high: float, detail: str, show=()) -> Check:
    """Known values outside an inclusive range are worth a warning."""
    bad = F.col(column).isNotNull() & ~F.col(column).between(low, high)
    return rule(name, "validity", bad, "warn", detail, [*show, column])


def join_coverage(
    name: str, column: str, detail: str, show=(), *, among: Column | None = None,
    warn_below: float | None = 100.0, fail_below: float = 99.0,
) -> Check:
    """Percent of rows (``among`` some of them) whose joined column is known."""
    inside = F.lit(True) if among is None else is_true(among)
    known = F.col(column).isNotNull()
    pct = F.round(F.coalesce(100 * F.avg(F.when(inside, known.cast("double"))), F.lit(100.0)), 2)

    def status(v: Column) -> Column:
        out = F.when(v < fail_below, F.lit("fail"))
        if warn_below is not None:
            out = out.when(v < warn_below, F.lit("warn"))
        return out.otherwise(F.lit("pass"))

    return Check(name, "joins", pct, status, detail, fail_below, inside & ~known, tuple(show))


def share(
    name: str, flag: Column, detail: str, *, among: Column | None = None,
    warn_above: float | None = None, within: Sequence[tuple[str, Column]] = (),
) -> Check:
    """Percent of rows where ``flag`` holds; informational unless ``warn_above`` is given.

    The detail gives the share again for each (name, condition) of ``within``.
    """
    inside = F.lit(True) if among is None else is_true(among)

    def pct(rows: Column) -> Column:
        found = 100 * F.avg(F.when(rows, is_true(flag).cast("double")))
        return F.round(F.coalesce(found, F.lit(100.0)), 2)

    value = pct(inside)
    parts = [F.concat(pct(inside & is_true(c)).cast("string"), F.lit(f"% of {n}")) for n, c in within]

    def status(v: Column) -> Column:
        if warn_above is None:
            return F.lit("pass")
        return F.when(v > warn_above, F.lit("warn")).otherwise(F.lit("pass"))

    more = F.concat_ws("; ", *parts) if parts else None
    return Check(name, "coverage", value, status, detail, warn_above, more=more)


def run_row_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks from a single pass over the table."""
    found = [c.value.cast("double").alias(f"_v{i}") for i, c in enumerate(checks)]
    found += [c.more.alias(f"_m{i}") for i, c in enumerate(checks) if c.more is not None]
    values = df.agg(*found)

    def detail(i: int, c: Check) -> Column:
        return F.lit(c.detail) if c.more is None else F.concat_ws("; ", F.lit(c.detail), F.col(f"_m{i}"))

    results = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("name"),
                F.lit(c.category).alias("category"),
                c.status(F.col(f"_v{i}")).alias("status"),
                F.col(f"_v{i}").alias("value"),
                F.lit(c.threshold).cast("double").alias("threshold"),
                detail(i, c).alias("detail"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return values.select(F.explode(results).alias("r")).select("r.*")


def offenders_result(
    offenders: DataFrame, name: str, category: str, level: str, detail: str,
    *, threshold: float | None = 0.0, value: Column | None = None, named: str | None = None,
) -> DataFrame:
    """A check whose offenders come from a reduction: their number, or another aggregate.

    ``named`` is a column whose values the detail lists; for offenders that are few by their nature.
    """
    names = F.lit(None).cast("string")
    if named is not None:
        names = F.array_join(F.sort_array(F.collect_set(named)).cast("array<string>"), ", ")
    found = offenders.agg(
        F.count(F.lit(1)).alias("_n"),
        (F.count(F.lit(1)) if value is None else value).cast("double").alias("value"),
        names.alias("_names"),
    )
    listed = F.concat(F.lit(f"{detail}: "), F.when(F.col("_names") == "", F.lit("none")).otherwise(F.col("_names")))
    return found.select(
        F.lit(name).alias("name"),
        F.lit(category).alias("category"),
        any_is(level)(F.col("_n")).alias("status"),
        "value",
        F.lit(threshold).cast("double").alias("threshold"),
        (F.lit(detail) if named is None else listed).alias("detail"),
    )


def row_count(df: DataFrame, source: DataFrame) -> DataFrame:
    """Joins must neither gain nor lose rows."""
    expected = source.agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("row_count").alias("name"),
        F.lit("completeness").alias("category"),
        F.when(F.col("value") == expected, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        "value",
        expected.cast("double").alias("threshold"),
        F.lit("rows of the fact table against rows of its source").alias("detail"),
    )


def key_offenders(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share their grain key with another row."""
    return duplicated(df, keys)


def unique_result(df: DataFrame, keys: Sequence[str], name: str, detail: str) -> DataFrame:
    """Rows that share their grain key, counted by one reduction; ``key_offenders`` shows them."""
    shared = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    rows = F.coalesce(F.sum("_rows"), F.lit(0))
    return offenders_result(shared, name, "uniqueness", "fail", detail, value=rows)


def final_offenders(df: DataFrame, entity: str, flag: str) -> DataFrame:
    """Entities without exactly one final record."""
    finals = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count_if(F.col(flag)).alias("final_rows")
    )
    return finals.filter(F.col("final_rows") != 1)


def missing_periods(df: DataFrame, period: str, first: int, last: int) -> DataFrame:
    """Expected periods no row has."""
    wanted = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(period))
    return wanted.join(df.select(period).distinct(), period, "left_anti")


def period_result(
    df: DataFrame, period: str, first: int, last: int, name: str = "years_present"
) -> DataFrame:
    size = last - first + 1
    return offenders_result(
        missing_periods(df, period, first, last), name, "completeness", "fail",
        f"periods {first}-{last} present; missing", threshold=float(size),
        value=F.lit(size) - F.count(F.lit(1)), named=period,
    )


def max_label_offenders(df: DataFrame, period: str, label: str, expected: Column) -> DataFrame:
    """Periods whose highest numeric label is not the expected one; none at all is wrong too."""
    got = df.groupBy(period).agg(F.max(whole_number(F.col(label))).alias("max_label"))
    got = got.withColumn("expected", expected)
    return got.filter(~F.col("max_label").eqNullSafe(F.col("expected")))


def coverage_by_period(
    df: DataFrame, period: str, column: str, among: Column
) -> DataFrame:
    """Percent of known values per period among the rows that should have one."""
    return df.filter(among).groupBy(period).agg(
        F.round(share_pct(F.col(column).isNotNull()), 2).alias("pct_known")
    )


def low_periods(by_period: DataFrame, warn_below: float) -> DataFrame:
    """Periods whose coverage is low."""
    return by_period.filter(F.col("pct_known") < warn_below)


def coverage_result(by_period: DataFrame, name: str, warn_below: float, detail: str) -> DataFrame:
    """Warns when any period's coverage is low; the value is the lowest, the detail lists them."""
    period = F.col(by_period.columns[0])
    low = F.collect_set(F.when(F.col("pct_known") < warn_below, period))
    found = by_period.agg(
        F.min("pct_known").alias("value"),
        F.array_join(F.sort_array(low).cast("array<string>"), ", ").alias("_low"),
    )
    status = F.when(F.col("value") < warn_below, F.lit("warn")).otherwise(F.lit("pass"))
    listed = F.when(F.col("_low") == "", F.lit("none")).otherwise(F.col("_low"))
    return found.select(
        F.lit(name).alias("name"),
        F.lit("coverage").alias("category"),
        status.alias("status"),
        F.col("value").cast("double").alias("value"),
        F.lit(float(warn_below)).alias("threshold"),
        F.concat(F.lit(f"{detail}; below {warn_below:g}%: "), listed).alias("detail"),
    )


def monotone_result(curve: DataFrame, x: str, names: Sequence[str]) -> DataFrame:
    """Positions where an expected curve climbs above an earlier value."""
    return offenders_result(
        curve_rises(curve, x, names), "slot_curve_monotone", "model", "fail",
        "positions where a curve lies above its value at an earlier position",
    )


def calibration_offenders(deciles: DataFrame) -> DataFrame:
    """Bins whose observed rate lies outside the interval around the expected one."""
    lo, hi = wilson_rate(F.col("expected"), F.col("n"))
    return deciles.withColumns({"interval_low": lo, "interval_high": hi}).filter(
        ~F.col("observed").between(F.col("interval_low"), F.col("interval_high"))
    )


def calibration_result(deciles: DataFrame) -> DataFrame:
    return offenders_result(
        calibration_offenders(deciles), "slot_model_calibrated", "model", "warn",
        "held-out bins whose observed rate is outside the interval around the expected rate",
    )


def examples(df: DataFrame, name: str, order: Sequence[Column | str], show: Sequence[str] = ()) -> DataFrame:
    """(name, place, example): the first offending rows in a fixed order, as JSON text."""
    columns = list(show) or df.columns
    first = df.orderBy(*order).limit(MAX_EXAMPLES)
    return first.select(
        F.lit(name).alias("name"),
        F.monotonically_increasing_id().alias("place"),  # the limit leaves one sorted partition
        F.to_json(F.struct(*columns)).alias("example"),
    )


def attach_examples(results: DataFrame, found: Sequence[DataFrame]) -> DataFrame:
    """Results with their examples; at most 20 per check are ever gathered."""
    if not found:
        return results.withColumn("examples", F.array().cast("array<string>"))
    stacked = found[0]
    for more in found[1:]:
        stacked = stacked.unionByName(more)
    listed = F.sort_array(F.collect_list(F.struct("place", "example")))
    lists = stacked.groupBy("name").agg(F.transform(listed, lambda e: e["example"]).alias("examples"))
    empty = F.array().cast("array<string>")
    joined = results.join(lists, "name", "left")
    return joined.withColumn("examples", F.coalesce("examples", empty))


def tally(results: DataFrame) -> DataFrame:
    """How many checks pass, warn and fail, and whether the build may go on."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")]
    return results.agg(*counts).withColumn("gate_open", F.col("n_fail") == 0)
