"""Typed staging, source priority, tagged unions and cross-source checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import whole_number
from cohortlens.operators.spread import hot_keys, lookup_join


def typed_projection(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """out -> (source column, type); values that do not fit the type become null."""
    kinds = dict(df.dtypes)

    def typed(src: str, t: str) -> Column:
        if kinds[src] == "string" and t == "int":
            return whole_number(F.col(src))
        return F.col(src).try_cast(t)

    return df.select([typed(src, t).alias(out) for out, (src, t) in columns.items()])


def choose_source(
    df: DataFrame,
    rules: Sequence[tuple[Column, str]],
    values: Mapping[str, Column],
    out_value: str,
    out_source: str,
) -> DataFrame:
    """Names the winning source by the first rule that holds, then takes that source's value."""
    source = F
    for condition, name in rules:
        source = source.when(condition, F.lit(name))
    df = df.withColumn(out_source, source)
    value = F
    for name, column in values.items():
        value = value.when(F.col(out_source) == name, column)
    return df.withColumn(out_value, value)


def tagged_union(parts: Mapping[str, DataFrame], tag: str = "kind") -> DataFrame:
    """Stacks sources, each row carrying its source's name."""
    out = None
    for name, df in parts.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sum_by_kind(
    df: DataFrame, key: Sequence[str], value: str, kinds: Sequence[str], total: str,
    *, tag: str = "kind", digits: int = 2, prefix: str = "",
) -> DataFrame:
    """Per key: one filtered sum per kind, absent kinds 0, and the rounded total."""
    per_kind = [
        F.coalesce(F.sum(F.when(F.col(tag) == k, F.col(value))), F.lit(0.0)).alias(prefix + k)
        for k in kinds
    ]
    whole = F.round(F.coalesce(F.sum(value), F.lit(0.0)), digits).alias(total)
    return df.groupBy(*key).agg(*per_kind, whole)


def orphans(rows: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner. The partner side shrinks to distinct keys before it moves."""
    return rows.join(other.select(*on).distinct(), list(on), "left_anti")


def with_match_flag(
    rows: DataFrame, other: DataFrame, on: Sequence[str], out: str, *, spread: Sequence[str]
) -> DataFrame:
    """Marks rows whose key occurs on the other side; every row is kept once."""
    keys = other.select(*on).distinct().withColumn(out, F.lit(True))
    marked = lookup_join(rows, keys, on, spread=spread, hot=hot_keys(rows, on))
    return marked.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def id_union(parts: Sequence[tuple[DataFrame, str]], out: str = "id") -> DataFrame:
    """Distinct non-null ids over several sources, each reduced before it is shuffled."""
    ids = [df.select(F.col(c).alias(out)).filter(F.col(out).isNotNull()).distinct() for df, c in parts]
    union = ids[0]
    for more in ids[1:]:
        union = union.unionByName(more)
    return union.distinct()


def changed_values(
    before: DataFrame, after: DataFrame, key: str, value: str, suffixes: tuple[str, str]
) -> DataFrame:
    """Keys present in both snapshots whose value differs; both values side by side."""
    old, new = (f"{value}{s}" for s in suffixes)
    pairs = before.select(key, F.col(value).alias(old)).join(
        after.select(key, F.col(value).alias(new)), key
    )
    return pairs.filter(~F.col(old).eqNullSafe(F.col(new)))


def override_lookup(
    rows: DataFrame, overrides: DataFrame, key: str, default: str, override: str, out: str,
    *, spread: Sequence[str],
) -> DataFrame:
    """The override's value where the key has one, else the row's own."""
    found = lookup_join(rows, overrides.select(key, override), [key], spread=spread)
    return found.withColumn(out, F.coalesce(F.col(override), F.col(default))).drop(override)


def crosscheck(
    pairs: DataFrame, a: str, b: str, *, rel_tol: float = 0.01
) -> DataFrame:
    """How often two sources agree where both know the value.

    Relative gaps count only over a positive base, so a base of zero never passes as close.
    """
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    gap = F.abs(F.col(a) - F.col(b))
    exact = F.col(a) == F.col(b)
    close = exact | F.coalesce(gap / F.when(F.col(b) > 0, F.col(b)) <= rel_tol, F.lit(False))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(exact.cast("double"))).alias("exact_pct"),
        (100 * F.avg(close.cast("double"))).alias("within_pct"),
    )


def largest_disagreements(
    pairs: DataFrame, a: str, b: str, keys: Sequence[str], n: int = 10
) -> DataFrame:
    """The n rows whose two values lie furthest apart."""
    diff = F.col(a) - F.col(b)
    apart = pairs.withColumn("diff", diff).filter(F.col("diff") != 0)
    return apart.orderBy(F.abs("diff").desc(), *keys).limit(n)
