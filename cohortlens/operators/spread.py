"""Building blocks that stay even when one key holds a large share of the rows.

None of them sends a key's raw rows to one task: groups are reduced on the map side, ranks come
from range partitions, and lookups of hot keys are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

HOT_KEYS = 1_000  # frequent keys that are treated apart, at most
TRACKED = 50_000  # keys a frequency sketch holds; a key's count is off by less than 1 / 30,000 of the rows
FEW_KEYS = 100_000  # repeated keys that are sent to every task
WINDOW = 100_000  # distinct values of a group that one window may sort


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """(``_hash``, ``_share``) of the most frequent keys: what part of all rows each one has.

    A mergeable sketch over all rows counts them in one scan of the key columns. The keys are fetched
    once, so both sides of a join treat the same ones apart; they only decide how rows travel.
    """
    known = F.when(_known(on), _key_hash(on))
    top = F.call_function("approx_top_k", known, F.lit(HOT_KEYS), F.lit(TRACKED))
    seen = df.agg(top.alias("_top"), F.count(F.lit(1)).alias("_n")).first()
    listed = [(t["item"], t["count"] / seen["_n"]) for t in seen["_top"] if t["item"] is not None]
    return df.sparkSession.createDataFrame(listed, "_hash long, _share double")  # HOT_KEYS rows at most


def _key_hash(on: Sequence[str]) -> Column:
    """A key's hash, the same for equal whole numbers of different widths."""
    return F.xxhash64(*[F.col(c).cast("string") for c in on])


def _known(on: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & F.col(c).isNotNull()
    return out


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    spread: Sequence[str] = (),
    how: str = "left",
    salts: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Joins a lookup holding one row per key to rows whose keys may be hot.

    Rows of a key are dealt over ``salts`` tasks by a hash of ``spread`` (grain columns), or by
    the task they come from when there is no grain, and the lookup is repeated per salt. For a
    lookup too large to repeat, ``hot`` (see ``hot_keys``) gives the frequent keys' shares: a key is
    dealt over as many places as its share of all tasks, twice over, and its lookup row is repeated as
    often; all other keys travel plainly. Null keys match nothing and are dealt out. A lookup that
    Spark measures below its broadcast threshold is still broadcast.
    """
    tasks = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = salts or 16
    dealt_by = F.xxhash64(F.lit("salt"), *spread) if spread else F.spark_partition_id()
    salt = F.pmod(dealt_by, F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        places = hot.select("_hash", F.ceil(2 * F.col("_share") * tasks).cast("int").alias("_places"))
        places = F.broadcast(places.filter("_places > 1"))  # HOT_KEYS rows
        rows, lookup = (t.withColumn("_hash", _key_hash(on)).join(places, "_hash", "left") for t in (rows, lookup))
        size = F.when(~_known(on), tasks).otherwise(F.coalesce("_places", F.lit(1)))
        salt = F.pmod(dealt_by, size).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1)
    dealt = rows.withColumn("_salt", salt)
    repeated = lookup.withColumn("_salt", F.explode(copies))
    if hot is not None:
        dealt, repeated = dealt.drop("_hash", "_places"), repeated.drop("_hash", "_places")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ascending ``order``, by map-side reduction.

    ``order`` should be total. Write ``nulls_last(c)`` for a key whose nulls sort last.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(
        *[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`") for c in rest]
    )
    first = df.groupBy(*keys).agg(F.min(ranked).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def nulls_last(c: Column) -> Column:
    return F.struct(c.isNull(), c)


def flag_last(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], out: str = "is_final"
) -> DataFrame:
    """Flags the latest row per entity; ``entity + order`` must identify a row.

    The latest order values per entity are found by reduction and matched back on the full key,
    so an entity with very many rows is hashed by row, not by entity. Rows without an entity
    count as one entity.
    """
    latest = df.groupBy(*entity).agg(F.max(F.struct(*order)).alias("_last"))
    latest = latest.select(
        *[F.col(c).alias(f"_{c}") for c in entity], *[F.col(f"_last.{c}").alias(f"_{c}") for c in order]
    ).withColumn("_hit", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*entity, *order)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = df.join(latest, condition, "left")
    return joined.select(*df.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias(out))


def majority(df: DataFrame, key: Sequence[str], value: Column, out: str = "vote") -> DataFrame:
    """Most common value per key; null when there is none or the lead is tied.

    Works on counts per (key, value): the largest and the smallest value holding the top count
    agree only when there is no tie.
    """
    votes = df.withColumn("_v", value).groupBy(*key, "_v").agg(F.count("_v").alias("_n"))
    top = F.max(F.when(F.col("_n") > 0, F.struct("_n", "_v")))
    least = F.min(F.when(F.col("_n") > 0, F.struct((-F.col("_n")).alias("_n"), F.col("_v").alias("_v"))))
    vote = F.when(top["_v"] == least["_v"], top["_v"])
    return votes.groupBy(*key).agg(vote.alias(out))


def with_group_total(
    counts: DataFrame, by: Sequence[str], column: str, out: str = "group_total"
) -> DataFrame:
    """Adds the group's total to rows that are already counts."""
    totals = counts.groupBy(*by).agg(F.sum(column).alias(out))
    return counts.join(totals, list(by), "left")


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once.

    Keys are counted on the map side. Up to ``FEW_KEYS`` repeated keys go to the rows, which then stay
    where they are; beyond that the rows of a repeated key are spread over tasks.
    """
    repeated = cut_lineage(df.groupBy(*keys).count().filter("count > 1").drop("count"))
    if repeated.count() <= FEW_KEYS:
        return df.join(F.broadcast(repeated), list(keys), "left_semi")
    return lookup_join(df, repeated, list(keys), how="left_semi", hot=hot_keys(df, keys))


def exact_medians(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    out: str = "median",
    *,
    n_out: str | None = None,
    accuracy: int = 50_000,
    reach: float = 1e-4,
) -> DataFrame:
    """Exact median of ``x`` per group (and its row count), without gathering a group's values.

    A mergeable sketch gives each group a bracket that surely holds its middle values; exact
    counts below the bracket plus the distinct values inside it then give the true ranks. Where a
    group has more than ``WINDOW`` of those, they are range partitioned, and only the partitions
    that hold its middle are looked at. The job fails if a bracket ever missed.
    """
    by = list(by)
    rows = df.filter(F.col(x).isNotNull()).select(
        *(by or [F.lit(0).alias("_all")]), F.col(x).cast("double").alias("_x")
    )
    keys = by or ["_all"]
    sketch = F.percentile_approx("_x", [0.5 - reach, 0.5 + reach], accuracy)
    brackets = rows.groupBy(*keys).agg(F.count("_x").alias("_n"), sketch.alias("_b"))
    brackets = brackets.select(*keys, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    placed = _attach_brackets(rows, brackets, keys)

    below = F.col("_x") < F.col("_lo")
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    pieces = (
        placed.filter(below | inside)
        .select(*keys, "_n", inside.alias("_in"), F.when(inside, F.col("_x")).alias("_v"))
        .groupBy(*keys, "_n", "_in", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    pieces = cut_lineage(pieces)
    first_rank = F.floor((F.col("_n") + 1) / 2)
    second_rank = F.floor(F.col("_n") / 2) + 1
    most = pieces.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > WINDOW:
        pieces = _around_ranks(pieces, keys, first_rank, second_rank)
        start, window = F.col("_start"), W.partitionBy(*keys, "_part")
    else:
        start, window = F.lit(0), W.partitionBy(*keys)
    running = window.orderBy("_in", "_v").rowsBetween(W.unboundedPreceding, 0)
    upto = pieces.withColumn("_upto", start + F.sum("_c").over(running)).filter("_in")

    def at(rank: Column) -> Column:
        return F.max(
            F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_v"))
        )

    middle = upto.groupBy(*keys, "_n").agg(
        at(first_rank).alias("_a"), at(second_rank).alias("_z")
    )
    missed = F.col("_a").isNull() | F.col("_z").isNull()
    value = F.when(missed, F.raise_error(F.lit("median bracket missed its ranks")).cast("double"))
    size = [F.col("_n").alias(n_out)] if n_out else []
    return middle.select(*by, value.otherwise((F.col("_a") + F.col("_z")) / 2).alias(out), *size)


def _around_ranks(pieces: DataFrame, keys: list[str], first_rank: Column, last_rank: Column) -> DataFrame:
    """Counted values of the range partitions in which a group's ranks lie, at most two a group, each
    with the group's rows before it (``_start``)."""
    order = [*keys, "_in", "_v"]
    stored = cut_lineage(pieces.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = stored.withColumn("_part", F.spark_partition_id())
    sizes = placed.groupBy(*keys, "_n", "_part").agg(F.sum("_c").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))

    def holds(rank: Column) -> Column:
        return (F.col("_start") < rank) & (rank <= F.col("_start") + F.col("_size"))

    wanted = starts.filter(holds(first_rank) | holds(last_rank))
    wanted = wanted.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_part").alias("_at"), "_start")
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return placed.join(wanted, same).drop("_at", *[f"_g_{k}" for k in keys])


def _attach_brackets(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's bracket. The HOT_KEYS largest groups are broadcast, so their rows
    stay where they are; only the rows of smaller groups meet their bracket by key."""
    if keys == ["_all"]:
        return rows.join(F.broadcast(brackets), keys)  # one row
    brackets = brackets.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    columns = [*keys, "_x", "_n", "_lo", "_hi"]
    hot = brackets.orderBy(F.col("_n").desc(), *[f"_g_{k}" for k in keys]).limit(HOT_KEYS)
    tried = rows.join(F.broadcast(hot), same, "left")
    warm = tried.filter(F.col("_n").isNotNull()).select(columns)
    rest = tried.filter(F.col("_n").isNull()).select(*keys, "_x")
    return warm.unionByName(rest.join(brackets, same).select(columns))


def global_position(
    df: DataFrame, order: Sequence[str], out: str = "position", size: str | None = None
) -> DataFrame:
    """0-based place of every row in a total order, computed without a one-task sort.

    Rows are range partitioned, stored, and numbered inside their partition; the partition sizes
    (one row per partition) then shift each number to its global place. ``size`` also adds the
    number of rows.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    numbered = stored.select(
        *df.columns,
        F.shiftright("_id", 33).alias("_part"),
        F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at"),
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(W.partitionBy()).alias("_total"),
    )
    placed = numbered.join(starts, "_part")
    total = [F.col("_total").alias(size)] if size else []
    return placed.select(*df.columns, (F.col("_start") + F.col("_at")).alias(out), *total)


def equal_count_bins(
    df: DataFrame, order: Sequence[str], n_bins: int, out: str = "bin"
) -> DataFrame:
    """1-based bins of near-equal size along a total order; earlier bins take the remainder."""
    placed = global_position(df, order, "_pos", "_n")
    return placed.select(*df.columns, _bin(F.col("_pos"), F.col("_n"), n_bins).alias(out))


def bins_within(
    df: DataFrame, by: Sequence[str], order: Sequence[str], n_bins: int, out: str = "bin"
) -> DataFrame:
    """1-based bins of near-equal size within each value of ``by``, along a total order.

    One range partitioning over (by, order) serves all groups: a group lies in neighbouring
    partitions, and its sizes there (a row per group and partition) shift the numbers inside a
    partition to places in the group, however large it is.
    """
    every = [*by, *order]
    stored = cut_lineage(
        df.repartitionByRange(*every).sortWithinPartitions(*every).withColumn(
            "_id", F.monotonically_increasing_id()
        )
    )
    placed = stored.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    group = W.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(group).alias("_n"),
    )
    same = F.col("_part") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = placed.join(sizes, same)
    return rows.select(
        *df.columns, _bin(F.col("_id") + F.col("_shift"), F.col("_n"), n_bins).alias(out)
    )


def _bin(pos: Column, n: Column, n_bins: int) -> Column:
    """1-based bin of a 0-based place among ``n``; earlier bins take the remainder."""
    small, extra = F.floor(n / n_bins), F.pmod(n, F.lit(n_bins))
    edge = extra * (small + 1)
    early = F.floor(pos / (small + 1))
    late = extra + F.floor((pos - edge) / F.greatest(small, F.lit(1)))
    return (F.when(pos < edge, early).otherwise(late) + 1).cast("int")


def rise_over_running_min(
    df: DataFrame,
    position: str,
    values: Sequence[str],
    block: int = 4096,
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds ``rise_<value>``: how far each value lies above the lowest one at or before it.

    ``position`` is a whole number, unique within ``by``. The running minimum is taken inside
    blocks of positions, below the minimum of all earlier blocks, so no task sees a whole series.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    lows = blocked.groupBy(*by, "_block").agg(*[F.min(v).alias(f"_low_{v}") for v in values])
    earlier = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    floors = lows.select(
        *by, "_block", *[F.min(f"_low_{v}").over(earlier).alias(f"_floor_{v}") for v in values]
    )
    inside = W.partitionBy(*by, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    joined = blocked.join(floors, [*by, "_block"])
    rises = [
        (F.col(v) - F.least(F.min(v).over(inside), F.col(f"_floor_{v}"))).alias(f"rise_{v}")
        for v in values
    ]
    return joined.select(*df.columns, *rises)
