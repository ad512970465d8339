"""Second-source rows verified against the primary source by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.resolve import verified_join
from cohortlens.operators.staging import crosscheck, largest_disagreements
from cohortlens.plans.draft import GRAIN
from cohortlens.sources.tables import with_missing_columns

NAME_PARTS = {
    "person_full_name": "string",
    "person_last_name": "string",
    "person_use_name": "string",
    "person_first_name": "string",
}


def build_backfill(picks: DataFrame, second: DataFrame) -> DataFrame:
    """One row per pick of the second source's years, with its values or why they are withheld."""
    picks = with_missing_columns(picks, NAME_PARTS)
    years = second.select("draft_year").distinct()
    rows = picks.join(years, "draft_year", "left_semi").select(
        *GRAIN, "person_id", *NAME_PARTS
    )
    renamed = second.select(
        "draft_year",
        F.col("overall_pick").alias("pick_number"),
        F.col("signed").cast("boolean").alias("bbref_signed"),
        F.col("bonus_usd").cast("double").alias("bbref_bonus_usd"),
        F.col("name").alias("bbref_name"),
        *[
            F.col(c).alias(out)
            for c, out in (
                ("drafted_out_of", "bbref_drafted_out_of"),
                ("from_type", "bbref_from_type"),
                ("bbref_player_url", "bbref_player_url"),
            )
            if c in second.columns
        ],
    )

    def with_last(first: str):
        return F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce("person_last_name", F.lit("")))

    names = [F.col("person_full_name"), with_last("person_use_name"), with_last("person_first_name")]
    out = verified_join(
        rows, renamed, GRAIN, names, "bbref_name",
        withhold=["bbref_signed", "bbref_bonus_usd"], prefix="bbref_",
    )
    out = out.withColumnRenamed("person_full_name", "mlb_name")
    return out.drop("person_last_name", "person_use_name", "person_first_name")


def money_pairs(backfill: DataFrame, picks: DataFrame, year: int) -> DataFrame:
    own = picks.filter(F.col("draft_year") == year).select(*GRAIN, "signing_bonus_usd")
    return backfill.join(own, GRAIN)


def crosscheck_year(backfill: DataFrame, picks: DataFrame, year: int = 2017):
    """Agreement of the two sources' money in a year both cover, and the largest gaps."""
    pairs = money_pairs(backfill, picks, year)
    summary = crosscheck(pairs, "bbref_bonus_usd", "signing_bonus_usd")
    top = largest_disagreements(pairs, "bbref_bonus_usd", "signing_bonus_usd", GRAIN)
    return summary, top
