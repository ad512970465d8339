"""Profile tables: counts, completeness, frequencies, repeats and shape facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import whole_number
from cohortlens.operators.spread import hot_keys, lookup_join


def counts_by(df: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Rows per group and how many meet each condition."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]
    )


def label_profile(df: DataFrame, by: str, label: str) -> DataFrame:
    """Rows, highest numeric label and number of non-numeric labels per group."""
    number = whole_number(F.col(label))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(number).alias("max_label"),
        F.count_if(number.isNull()).alias("n_other"),
    )


def completeness(df: DataFrame, by: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Percent of non-null cells of every column, emptiest first; per group when ``by`` is given."""
    names = list(columns) or [c for c in df.columns if c != by]
    aggs = [(100 * F.avg(F.col(f"`{c}`").isNotNull().cast("double"))).alias(c) for c in names]
    ids = [by] if by else []
    wide = df.groupBy(*ids).agg(*aggs)
    long = wide.unpivot(ids, names, "column_name", "pct_non_null")
    return long.orderBy(*ids, "pct_non_null", "column_name")


def sentinel_share(df: DataFrame, by: str, column: str, sentinel: str) -> DataFrame:
    """Percent of rows equal to a sentinel per group; a null cell is not the sentinel."""
    hit = F.coalesce(F.col(column).cast("string") == sentinel, F.lit(False))
    return df.groupBy(by).agg((100 * F.avg(hit.cast("double"))).alias("pct_sentinel"))


def value_freq(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """Every value, null included, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(n))
    return counts.orderBy(F.col(n).desc(), F.col(column).asc_nulls_last())


def top_values(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    """The most frequent known values, the default choice of lines for a chart."""
    return value_freq(df.filter(F.col(column).isNotNull()), column).limit(k)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct known values per column.

    Each column is reduced on its own, so rows are not multiplied by the number of columns
    before their first reduction.
    """
    out = None
    for c in columns:
        part = df.select(c).distinct().agg(F.count(c).alias("n_distinct")).select(
            F.lit(c).alias("column_name"), "n_distinct"
        )
        out = part if out is None else out.unionByName(part)
    return out


def repeat_entities(df: DataFrame, entity: str) -> DataFrame:
    """How many entities occur more than once, the rows they cover, and the most for one."""
    times = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    return times.agg(
        F.count_if(repeated).alias("n_repeated"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("rows_covered"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_appearances"),
    )


def repeat_examples(df: DataFrame, entity: str, order: Sequence[str], k: int = 5) -> DataFrame:
    """All rows of the k entities that occur most often."""
    times = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    top = times.filter("_n > 1").orderBy(F.col("_n").desc(), entity).limit(k).select(entity)
    return df.join(F.broadcast(top), entity, "left_semi").orderBy(entity, *order)  # k keys


def alias_groups(df: DataFrame, canonical: str, raw: str) -> DataFrame:
    """Canonical names written in more than one way: one row per spelling, with their number.

    Spellings stay rows, so a canonical name may have any number of them.
    """
    pairs = df.filter(F.col(raw).isNotNull() & F.col(canonical).isNotNull()).select(canonical, raw)
    pairs = pairs.distinct()
    several = pairs.groupBy(canonical).agg(F.count(F.lit(1)).alias("n_raw")).filter("n_raw > 1")
    hot = hot_keys(pairs, [canonical])
    named = lookup_join(pairs, several, [canonical], spread=[raw], how="inner", hot=hot)
    return named.orderBy(canonical, raw)


def alias_counts(df: DataFrame, canonical: str, raw: str, flag: Column) -> DataFrame:
    """Size of a reference table: names, canonical names, alias groups, flagged rows.

    Counts only, so it also serves canonical names with any number of spellings.
    """
    per_name = df.groupBy(canonical, raw).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(flag).alias("_flagged")
    )
    per_canonical = per_name.groupBy(canonical).agg(
        F.count(raw).alias("_raws"), F.sum("_rows").alias("_rows"), F.sum("_flagged").alias("_flagged")
    )
    return per_canonical.agg(
        F.sum("_rows").alias("n_rows"),
        F.count(canonical).alias("n_canonical"),
        F.count_if((F.col("_raws") > 1) & F.col(canonical).isNotNull()).alias("n_alias_groups"),
        F.sum("_flagged").alias("n_flagged"),
    )


def agreement_share(
    left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str
) -> DataFrame:
    """Share of matched rows on which two sources give the same value; unknown is no match."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return left.join(right, list(on)).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg(same.cast("double"))).alias("pct_equal")
    )


def empty_periods(df: DataFrame, period: str, column: str, below: float = 0.5) -> DataFrame:
    """Periods in which a column is never, or mostly not, filled."""
    filled = df.groupBy(period).agg(F.avg(F.col(column).isNotNull().cast("double")).alias("share_known"))
    return filled.filter(F.col("share_known") < below).select(
        period, "share_known", (F.col("share_known") == 0).alias("never_known")
    )


def mismatch_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Percent of rows on which two fields differ, unknown counted as different."""
    differs = ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return df.agg((100 * F.avg(differs.cast("double"))).alias("pct_mismatch"))


def stable_sample(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """The same n distinct values for a seed however the data is partitioned, sorted."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    drawn = values.orderBy(F.md5(F.concat(F.col(column).cast("string"), F.lit(f"|{seed}"))), column).limit(n)
    return drawn.orderBy(column)
