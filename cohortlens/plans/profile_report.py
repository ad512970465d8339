"""Profile of the interim tables: one DataFrame per report table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bands import range_band
from cohortlens.functions.casts import is_true, whole_number
from cohortlens.operators import profile as P
from cohortlens.operators.report import coverage_pivot
from cohortlens.operators.spread import hot_keys, lookup_join
from cohortlens.operators.staging import id_union, orphans, with_match_flag
from cohortlens.plans.backfill import crosscheck_year
from cohortlens.plans.draft import GRAIN

# Fields followed by year and the round bands of the coverage tables.
KEY_FIELDS = (
    "signing_bonus_usd", "pick_value", "person_birth_date", "school_name", "school_school_class",
    "school_state", "person_primary_position_abbreviation",
)
ROUND_BANDS = [(1, 5, "1-5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, None, "21+")]
BAND_ORDER = ["1-5", "6-10", "11-20", "21+", "supplemental"]
MAX_EXAMPLES = 10
SAMPLE_SIZE = 25


def round_band() -> Column:
    return range_band(whole_number(F.col("pick_round")), ROUND_BANDS, "supplemental")


def _coverage(rows: DataFrame, flag: Column) -> DataFrame:
    banded = rows.withColumn("band", round_band())
    return coverage_pivot(banded, "draft_year", "band", BAND_ORDER, flag).orderBy("draft_year")


def pick_tables(picks: DataFrame) -> dict[str, DataFrame]:
    """Counts, completeness, frequencies and repeats of the primary source."""
    supplemental = whole_number(F.col("pick_round")).isNull() & F.col("pick_round").isNotNull()
    present = [c for c in KEY_FIELDS if c in picks.columns]
    tables = {
        "picks_per_year": P.label_profile(picks, "draft_year", "pick_round").orderBy("draft_year"),
        "supplemental_labels": picks.filter(supplemental).select("pick_round").distinct().orderBy("pick_round"),
        "distinct": P.distinct_counts(picks, ["person_id", "school_name"]),
        "completeness": P.completeness(picks),
        "key_fields_by_year": P.completeness(picks, "draft_year", present),
        "zero_slot_by_year": P.sentinel_share(picks, "draft_year", "pick_value", "0"),
        "bonus_coverage": _coverage(picks, F.col("signing_bonus_usd").isNotNull()),
        "school_sample": P.stable_sample(picks, "school_name", SAMPLE_SIZE),
        "repeats": P.repeat_entities(picks, "person_id"),
        "repeat_examples": P.repeat_examples(picks, "person_id", GRAIN),
        "years_without_bonus": P.empty_periods(picks, "draft_year", "signing_bonus_usd").filter("never_known"),
        "years_with_few_classes": P.empty_periods(picks, "draft_year", "school_school_class"),
    }
    for c in ("school_school_class", "person_primary_position_abbreviation"):
        if c in picks.columns:
            tables[f"values_{c}"] = P.value_freq(picks, c, "picks")
    if "person_draft_year" in picks.columns:
        tables["draft_year_mismatch"] = P.mismatch_share(picks, "person_draft_year", "draft_year")
    return tables


def people_tables(
    picks: DataFrame, people: DataFrame, bat: DataFrame, pitch: DataFrame
) -> dict[str, DataFrame]:
    """Bio and debut coverage, and whether debuted people have a value row in either table."""
    bios = people.select(F.col("id").alias("person_id"), "birth_date", "mlb_debut_date").withColumn(
        "_in", F.lit(True)
    )
    hot = hot_keys(picks, ["person_id"])
    joined = lookup_join(picks.select(*GRAIN, "person_id"), bios, ["person_id"], spread=GRAIN, hot=hot)

    def pct(column: str) -> Column:
        return 100 * F.avg(F.col(column).isNotNull().cast("double"))

    covered = joined.groupBy("draft_year").agg(
        F.count(F.lit(1)).alias("picks"),
        pct("_in").alias("pct_in_people"),
        pct("birth_date").alias("pct_birth_date"),
        pct("mlb_debut_date").alias("pct_mlb_debut"),
    )
    ids = id_union([(bat, "mlb_ID"), (pitch, "mlb_ID")], "id").select(F.col("id").cast("long").alias("id"))
    debuted = people.filter(F.col("mlb_debut_date").isNotNull())
    marked = with_match_flag(debuted, ids, ["id"], "matched", spread=["id"])
    seasons = bat.select("year_ID").unionByName(pitch.select("year_ID")).agg(F.max("year_ID").alias("last_season"))
    tables = {
        "people_coverage": covered.orderBy("draft_year"),
        "value_match": marked.agg(
            F.count(F.lit(1)).alias("debuted"),
            F.count_if("matched").alias("matched"),
            (100 * F.avg(F.col("matched").cast("double"))).alias("pct_matched"),
        ),
        "last_season": seasons,
        "value_unmatched": marked.filter(~F.col("matched")).orderBy("id").limit(MAX_EXAMPLES),
    }
    position = "person_primary_position_abbreviation"
    if position in picks.columns and "primary_position_abbreviation" in people.columns:
        now = people.select(F.col("id").alias("person_id"), "primary_position_abbreviation")
        tables["position_agreement"] = P.agreement_share(
            picks.select("person_id", position), now, ["person_id"], position, "primary_position_abbreviation"
        )
    return tables


def backfill_tables(
    picks: DataFrame, second: DataFrame, backfill: DataFrame, check_year: int = 2017
) -> dict[str, DataFrame]:
    """Join quality of the second source, and money coverage before and after it."""
    years = second.select("draft_year").distinct()
    own = picks.join(years, "draft_year", "left_semi")
    joined = backfill.groupBy("draft_year").agg(
        F.count_if("bbref_matched").alias("joined"), F.count_if("name_mismatch").alias("name_mismatch")
    )
    counts = own.groupBy("draft_year").agg(F.count(F.lit(1)).alias("mlb_picks"))
    others = second.groupBy("draft_year").agg(F.count(F.lit(1)).alias("bbref_rows"))
    rows = counts.join(others, "draft_year", "full").join(joined, "draft_year", "left")
    keyed = second.withColumnRenamed("overall_pick", "pick_number")
    merged = own.select(*GRAIN, "pick_round", "signing_bonus_usd").join(
        backfill.select(*GRAIN, "bbref_bonus_usd", "bbref_signed"), GRAIN, "left"
    )
    either = F.coalesce("signing_bonus_usd", "bbref_bonus_usd").isNotNull()
    summary, top = crosscheck_year(backfill, picks, check_year)
    mismatched = backfill.filter("name_mismatch")
    shown = (*GRAIN, "mlb_name", "bbref_name", "name_match_score")
    return {
        "backfill_rows": rows.orderBy("draft_year"),
        "backfill_match": backfill.agg(
            F.count(F.lit(1)).alias("picks"),
            F.count_if("bbref_matched").alias("matched"),
            F.count_if("name_mismatch").alias("name_mismatch"),
            F.count_if(F.col("name_mismatch") & F.col("same_last_name_initial")).alias("nicknames"),
        ),
        "mismatch_examples": mismatched.orderBy(*GRAIN).limit(MAX_EXAMPLES).select(*shown),
        "second_source_orphans": orphans(keyed, picks, GRAIN),
        "coverage_before": _coverage(merged, F.col("signing_bonus_usd").isNotNull()),
        "coverage_after": _coverage(merged, either),
        "coverage_after_signed": _coverage(merged.filter(is_true(F.col("bbref_signed"))), either),
        "crosscheck": summary,
        "crosscheck_top": top,
    }


def school_tables(picks: DataFrame, schools: DataFrame) -> dict[str, DataFrame]:
    """Size of the school reference and how many college picks it gives a conference."""
    review = F.lower(F.col("needs_review").cast("string")) == "true"
    named = schools.select(F.col("school_name_raw").alias("school_name"), "school_type", "conference_2024")
    joined = lookup_join(picks.select(*GRAIN, "school_name"), named, ["school_name"], spread=GRAIN)
    has = is_true(F.col("conference_2024") != "").cast("double")
    four = F.col("school_type") == "4YR"
    college = four | (F.col("school_type") == "JC")
    return {
        "schools": P.alias_counts(schools, "school_canonical", "school_name_raw", review),
        "schools_by_type": P.counts_by(schools, ["school_type", "division"], {}),
        "schools_by_source": P.value_freq(schools, "type_source", "schools"),
        "school_aliases": P.alias_groups(schools, "school_canonical", "school_name_raw"),
        "conference_share": joined.agg(
            F.count_if(college).alias("college_picks"),
            (100 * F.avg(F.when(college, has))).alias("pct_of_college"),
            (100 * F.avg(F.when(four, has))).alias("pct_of_four_year"),
            F.count_if(F.col("school_type").isNull()).alias("not_listed"),
        ),
    }


def build_profile(inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All profile tables that the given inputs allow."""
    picks = inputs["draft_picks"]
    tables = pick_tables(picks)
    tables |= people_tables(picks, inputs["people"], inputs["war_bat"], inputs["war_pitch"])
    if "bbref_draft" in inputs and "bonus_backfill" in inputs:
        tables |= backfill_tables(picks, inputs["bbref_draft"], inputs["bonus_backfill"])
    if "schools" in inputs:
        tables |= school_tables(picks, inputs["schools"])
    return tables
