"""Entity resolution: verified joins, key matching and evidence votes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.functions.text import person_key, same_last_initial, token_sort_score
from cohortlens.operators.spread import lookup_join, majority

NAME_MATCH_MIN = 85


def verified_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_names: Sequence[Column],
    right_name: str,
    *,
    withhold: Sequence[str] = (),
    min_score: float = NAME_MATCH_MIN,
    prefix: str = "",
) -> DataFrame:
    """Left join on ``keys`` checked by name.

    A joined row whose best name score is below ``min_score`` (or unknown) is flagged and its
    ``withhold`` values become null; the row stays. The first of ``left_names`` also decides
    ``same_last_name_initial``, a hint that does not clear the flag.
    """
    names = [person_key(c).alias(f"_name{i}") for i, c in enumerate(left_names)]
    rows = left.select("*", *names)
    other = right.select("*", person_key(F.col(right_name)).alias("_other")).withColumn(
        "_hit", F.lit(True)
    )
    joined = rows.join(other, list(keys), "left")
    matched = F.coalesce(F.col("_hit"), F.lit(False))
    scores = [token_sort_score(F.col(f"_name{i}"), F.col("_other")) for i in range(len(names))]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    judged = joined.withColumns(
        {
            f"{prefix}matched": matched,
            "name_match_score": F.when(matched, best),
            "same_last_name_initial": same_last_initial(F.col("_other"), F.col("_name0")),
        }
    )
    close = F.coalesce(F.col("name_match_score") >= min_score, F.lit(False))
    judged = judged.withColumn("name_mismatch", F.col(f"{prefix}matched") & ~close)
    kept = {c: F.when(~F.col("name_mismatch"), F.col(c)) for c in withhold}
    return judged.withColumns(kept).drop("_hit", "_other", *[f"_name{i}" for i in range(len(names))])


def candidate_index(candidates: DataFrame, group: str | None = "state") -> DataFrame:
    """Candidates per key as (key, compat, lowest id, highest id).

    ``candidates`` has key, id and, when given, ``group`` — the attribute that must not conflict
    (null fits everything). One row per key serves probes without a group, and one per
    (key, group) serves the others; the two ids are equal exactly when one candidate is left.
    """
    ids = [F.min("id").alias("low"), F.max("id").alias("high")]
    whole = candidates.groupBy("key").agg(*ids).withColumn("compat", F.lit("*"))
    if group is None:
        return whole
    same = candidates.groupBy("key", F.coalesce(F.col(group), F.lit("")).alias("compat")).agg(*ids)
    return whole.unionByName(same.select("key", "low", "high", "compat"))


def match_by_keys(
    probes: DataFrame, candidates: DataFrame, *, group: str | None = "state", salts: int = 8
) -> DataFrame:
    """Per entity the one candidate its keys point to.

    ``probes``: entity, via, via_rank, key and, when given, the ``group`` attribute. Names are
    tried by ``via_rank`` and longest key first; candidates of a conflicting group are out, and
    a key left with several candidates is ambiguous and skipped. Gives (entity, match_id, via,
    ambiguous): ambiguous only when nothing matched.

    Candidates are reduced to one row per key before the join, so a common key never pairs all
    its probes with all its candidates.
    """
    index = candidate_index(candidates.filter(F.col("key") != ""), group)
    probes = probes.filter(F.col("key") != "")
    known = F.col(group) if group else F.lit(None).cast("string")
    wanted = F.when(known.isNull() | (known == ""), F.array(F.lit("*"))).otherwise(
        F.array(F.lit(""), known)
    )
    asked = probes.withColumn("compat", F.explode(wanted))
    found = lookup_join(asked, index, ["key", "compat"], spread=["entity", "key"], salts=salts)
    per_key = found.groupBy("entity", "via", "via_rank", "key").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    single = F.col("low") == F.col("high")
    choice = F.min(
        F.when(
            single,
            F.struct(
                F.col("via_rank"),
                (-F.length("key")).alias("shortness"),
                F.col("key"),
                F.col("low").alias("id"),
                F.col("via"),
            ),
        )
    )
    picked = per_key.groupBy("entity").agg(
        choice.alias("c"), F.max(F.col("low") != F.col("high")).alias("several")
    )
    return picked.select(
        "entity",
        F.col("c.id").alias("match_id"),
        F.col("c.via").alias("via"),
        (F.col("c").isNull() & F.coalesce("several", F.lit(False))).alias("ambiguous"),
    )


def evidence_votes(
    evidence: DataFrame, key: Sequence[str], votes: Mapping[str, Column]
) -> DataFrame:
    """One majority per kind of evidence and key, from a single count of (key, kind, value)."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in votes.items()]
    )
    long = evidence.select(*key, F.explode(kinds).alias("e")).select(*key, "e.kind", "e.value")
    per_kind = majority(long, [*key, "kind"], F.col("value"))
    return per_kind.groupBy(*key).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("vote"))).alias(k) for k in votes]
    )


def classify(
    df: DataFrame, explicit: Column, explicit_wins: Sequence[str], votes: Sequence[tuple[str, str]],
    *, out: str = "level", rule: str = "rule", explicit_rule: str = "name_regex",
) -> DataFrame:
    """Label by evidence priority, with the deciding rule recorded.

    An explicit label in ``explicit_wins`` comes first, then each (vote column, rule name) in
    order, then any explicit label, else UNKNOWN.
    """
    df = df.withColumn("_own", explicit)
    wins = F.col("_own").isin(*explicit_wins)
    label = F.when(wins, F.col("_own"))
    name = F.when(wins, F.lit(explicit_rule))
    for column, rule_name in votes:
        label = label.when(F.col(column).isNotNull(), F.col(column))
        name = name.when(F.col(column).isNotNull(), F.lit(rule_name))
    label = label.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(F.lit("UNKNOWN"))
    name = name.when(F.col("_own").isNotNull(), F.lit(explicit_rule)).otherwise(F.lit("unknown"))
    return df.withColumns({out: label, rule: name}).drop("_own")


def consistent_pairs(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """Pairs (left, right) of distinct keys that could name the same place.

    An inverted index of distinctive words and an index of acronyms propose the pairs, so keys that
    share nothing never meet. Every pair is in the result once, however many words it shares.
    """
    asked = left.select(F.col(key).alias("left")).filter("left <> ''").distinct()
    known = right.select(F.col(key).alias("right")).filter("right <> ''").distinct()
    by_word = asked.select("left", F.explode(T.distinctive_words(F.col("left"))).alias("_clue"))
    words = known.select("right", F.explode(F.array_distinct(F.split("right", " "))).alias("_clue"))
    short = asked.filter((F.length("left") >= 2) & ~F.col("left").contains(" ")).withColumn("_clue", F.col("left"))
    initials = known.select("right", F.explode(T.acronyms(F.col("right"))).alias("_clue"))
    proposed = by_word.join(words, "_clue").unionByName(short.join(initials, "_clue"))
    return proposed.select("left", "right").distinct()
