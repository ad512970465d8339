"""Group statistics with intervals, rankings and comparisons with a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.intervals import direction, mean_interval, wilson
from cohortlens.operators.cohort import (
    Metric,
    OutcomeColumns,
    Rules,
    in_population,
    metric_values,
)
from cohortlens.operators.spread import exact_medians


def stat_of_values(values: DataFrame, by: Sequence[str], kind: str, x: str = "x") -> DataFrame:
    """(by..., value, lo, hi, n) of the values in ``x``; rows without a group are left out."""
    by = list(by)
    for b in by:
        values = values.filter(F.col(b).isNotNull())
    nothing = F.lit(None).cast("double")
    if kind == "median":
        medians = exact_medians(values, by, x, "value", n_out="n")
        if by:
            return medians.select(*by, "value", nothing.alias("lo"), nothing.alias("hi"), "n")
        size = values.agg(F.count(x).alias("n"))
        middle = medians.select("value").scalar()
        return size.select(middle.alias("value"), nothing.alias("lo"), nothing.alias("hi"), "n")
    n = F.count(x)
    if kind == "rate":
        sums = values.groupBy(*by).agg(n.alias("n"), F.sum(x).alias("total"))
        lo, hi = wilson(F.col("total"), F.col("n"))
        value = F.col("total") / F.when(F.col("n") > 0, F.col("n"))
    else:
        sums = values.groupBy(*by).agg(
            n.alias("n"), F.avg(x).alias("value"), F.stddev_samp(x).alias("std")
        )
        lo, hi = mean_interval(F.col("value"), F.col("std"), F.col("n"))
        value = F.col("value")
    return sums.select(*by, value.alias("value"), lo.alias("lo"), hi.alias("hi"), "n")


def summary(values: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """The five numbers behind every statistic: n, total, mean, sample deviation, median."""
    by = list(by)
    basic = values.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("total"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
    )
    medians = exact_medians(values, by, x)
    if not by:
        return basic.withColumn("median", medians.scalar())
    return basic.join(medians, by, "left")


def stat(
    df: DataFrame,
    metric: Metric,
    rules: Rules | None = None,
    by: Sequence[str] = (),
    c: OutcomeColumns | None = None,
) -> DataFrame:
    """A metric over the whole cohort or per group; an empty cohort is null with n = 0."""
    return stat_of_values(metric_values(df, metric, rules, c), by, metric.kind)


def stat_table(
    df: DataFrame,
    metrics: Sequence[Metric],
    rules: Rules | None = None,
    c: OutcomeColumns | None = None,
) -> DataFrame:
    """Several metrics of one cohort: (metric, value, lo, hi, n).

    Rates and means share a single pass; the medians share another.
    """
    rules = rules or Rules()
    inside = in_population(rules, c)
    defined = {}
    for m in metrics:
        x = m.value(rules)
        keep = F.lit(True) if m.keep is None else m.keep()
        defined[m.key] = F.when(keep & inside if m.outcome else keep, x)
    sums = [m for m in metrics if m.kind != "median"]
    out = None
    if sums:
        wide = df.agg(
            *[F.count(defined[m.key]).alias(f"n_{m.key}") for m in sums],
            *[F.sum(defined[m.key]).alias(f"t_{m.key}") for m in sums],
            *[F.avg(defined[m.key]).alias(f"m_{m.key}") for m in sums],
            *[F.stddev_samp(defined[m.key]).alias(f"s_{m.key}") for m in sums],
        )
        entries = []
        for m in sums:
            n, total = F.col(f"n_{m.key}"), F.col(f"t_{m.key}")
            if m.kind == "rate":
                lo, hi = wilson(total, n)
            else:
                lo, hi = mean_interval(F.col(f"m_{m.key}"), F.col(f"s_{m.key}"), n)
            entries.append(
                F.struct(
                    F.lit(m.key).alias("metric"), F.col(f"m_{m.key}").alias("value"), lo.alias("lo"),
                    hi.alias("hi"), n.alias("n"),
                )
            )
        out = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    medians = [m for m in metrics if m.kind == "median"]
    if medians:
        entries = [F.struct(F.lit(m.key).alias("metric"), defined[m.key].alias("x")) for m in medians]
        values = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("x IS NOT NULL")
        found = stat_of_values(values, ["metric"], "median")
        wanted = df.sparkSession.createDataFrame([(m.key,) for m in medians], "metric string")
        found = wanted.join(found, "metric", "left").na.fill(0, ["n"])
        out = found if out is None else out.unionByName(found)
    return out


def ranking(
    df: DataFrame,
    by: str,
    metric: Metric,
    min_n: int,
    rules: Rules | None = None,
    c: OutcomeColumns | None = None,
) -> DataFrame:
    """Groups of at least ``min_n`` rows, best first: (group, value, lo, hi, n)."""
    table = stat(df, metric, rules, [by], c).withColumnRenamed(by, "group")
    return rank_order(table.filter(F.col("n") >= min_n))


def rank_order(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("value").desc_nulls_last(), F.col("n").desc(), "group")


def hidden_groups(df: DataFrame, by: str, visible: DataFrame) -> DataFrame:
    """How many groups of the cohort a ranking does not show, groups without metric rows too."""
    present = df.agg(F.countDistinct(by).alias("present"))
    shown = visible.agg(F.count(F.lit(1)).alias("visible")).scalar()
    return present.select(
        "present", shown.alias("visible"), (F.col("present") - shown).alias("hidden")
    )


def with_direction(table: DataFrame, reference: Column | float, out: str = "sig") -> DataFrame:
    """Whether each interval lies clear of a fixed reference."""
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    return table.withColumn(out, direction(F.col("lo") - ref, F.col("hi") - ref))


def delta_vs(table: DataFrame, reference: Column | float) -> DataFrame:
    """Value and interval shifted by a fixed reference, with the direction of the difference."""
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    shifted = table.withColumns({c: F.col(c) - ref for c in ("value", "lo", "hi")})
    return shifted.withColumn("sig", direction(F.col("lo"), F.col("hi")))
