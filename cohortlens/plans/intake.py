"""Landed documents to interim tables, and which requested ids never came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import parse_money
from cohortlens.operators.staging import id_union, orphans
from cohortlens.sources.nested import flatten_nested
from cohortlens.sources.tables import absent_columns, require_columns

PEOPLE_COLUMNS = ("id", "full_name", "birth_date", "mlb_debut_date", "birth_country")
PEOPLE_FAMILIES = ("primary_position", "bat_side", "pitch_hand")
VALUE_ID = "mlb_ID"


def flatten_draft(documents: DataFrame, year: int) -> DataFrame:
    """One row per pick of a yearly document, every field kept, money as a number."""
    picks = flatten_nested(documents, ["drafts.rounds", "picks"], {"draft_year": year})
    money = F.col("signing_bonus") if "signing_bonus" in picks.columns else F.lit(None)
    return picks.withColumn("signing_bonus_usd", parse_money(money))


def flatten_people(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per person, and the expected columns the documents do not carry."""
    people = flatten_nested(documents, ["people"])
    return people, absent_columns(people, PEOPLE_COLUMNS, PEOPLE_FAMILIES)


def people_missing(picks: DataFrame, people: DataFrame) -> DataFrame:
    """Ids picked but not among the people, each once."""
    asked = id_union([(picks, "person_id")], "person_id")
    return orphans(asked, people.select(F.col("id").alias("person_id")), ["person_id"])


def value_table(raw: DataFrame, name: str) -> DataFrame:
    """A season-value table; without its id column it is an error page, not a table."""
    return require_columns(raw, [VALUE_ID], name)


