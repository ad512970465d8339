"""The fact-table job: typed picks to one wide row per pick with outcomes and expectations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import bands, casts, dates
from cohortlens.operators.cohort import FilterSpec, OutcomeColumns
from cohortlens.operators.expect import Fit, curve_table, fit_curves, with_expected, with_residuals
from cohortlens.operators.spread import flag_last, hot_keys, keep_first, lookup_join, nulls_last
from cohortlens.operators.staging import choose_source, sum_by_kind, tagged_union

GRAIN = ["draft_year", "pick_number"]

# Labels, edges, patterns and windows that decide the results.
TIERS = ["Didn't sign", "Never reached MLB", "Cup of coffee", "Role player", "Regular", "Star"]
TIER_THRESHOLDS = (1, 5, 15)
TOP_TIERS = ["Regular", "Star"]
REGULAR_VALUE = 5
OUTCOME_YEARS = (2012, 2019)
CLASS_YEARS = (2012, 2025)
LAST_VALUE_SEASON = 2026
LAST_OLD_ALIGNMENT = 2024
NO_SCHOOL = "No school / unclassified"
PICK_RANGES = [
    (1, 10), (11, 20), (21, 30), (31, 50), (51, 75), (76, 100),
    (101, 150), (151, 200), (201, 300), (301, 500), (501, None),
]
SLOT_EDGES = [(10, "1–10"), (30, "11–30"), (100, "31–100"), (300, "101–300")]
ROUND_RANGES = [(1, 5, "1–5"), (6, 10, "6–10"), (11, 20, "11–20"), (21, None, "21+")]
BONUS_EDGES = [
    (100_000, "<$100k"), (500_000, "$100k–$500k"), (1_000_000, "$500k–$1M"), (3_000_000, "$1M–$3M"),
]
AGE_EDGES = [(18, "≤18"), (19, "19"), (20, "20"), (21, "21"), (22, "22")]
RATIO_BANDS = ("under slot", "at slot", "over slot")
POSITION_SETS = [(("1B", "3B"), "1B/3B"), (("2B", "SS"), "2B/SS"), (("LF", "CF", "RF", "OF"), "OF")]
PITCHERS, HITTERS = ("RHP", "LHP"), ("C", "1B/3B", "2B/SS", "OF", "Other")
HIGH_SCHOOL_NAME = (
    r"\bHS\b|High School|(?<!Military )(?<!Naval )(?<!Air Force )(?<!Coast Guard )Academy"
    r"|\bPrep\b|Secondary|\bSS\b|Colegio|\bSchool\b(?! of)"
)
PLACEHOLDER_SCHOOL = "No School"
PRESETS = {
    "SEC college arms": FilterSpec(
        members={
            "school_type": ("4-year college",),
            "conference_group": ("Southeastern",),
            "position_group": PITCHERS,
        }
    ),
    "Prep shortstops": FilterSpec(
        members={"school_type": ("High school",), "position_group": ("2B/SS",)}
    ),
    "JUCO bats": FilterSpec(members={"school_type": ("Junior college",), "position_group": HITTERS}),
    "Top-100 college hitters": FilterSpec(
        ranges={"pick_number": (1, 100)},
        members={"school_type": ("4-year college",), "position_group": HITTERS},
    ),
    "$1M+ high schoolers": FilterSpec(
        members={"school_type": ("High school",), "bonus_band": ("$1M–$3M", "$3M+")}
    ),
}


def stage_picks(raw: DataFrame) -> DataFrame:
    c = F.col
    return raw.select(
        c("draft_year").cast("int").alias("draft_year"),
        c("pick_number").cast("int").alias("pick_number"),
        c("pick_round").cast("string").alias("round_label"),
        casts.whole_number(c("pick_round")).alias("round_number"),
        "team_name",
        c("person_id").cast("long").alias("person_id"),
        c("person_full_name").alias("player_name"),
        c("school_name").alias("school_name_raw"),
        casts.leading_token(c("school_school_class"), ("HS", "4YR", "JC")).alias("school_class_level"),
        c("person_primary_position_abbreviation").alias("position"),
        c("person_pitch_hand_code").alias("pitch_hand"),
        casts.null_if(c("signing_bonus_usd").cast("double"), 0).alias("mlb_bonus_usd"),
        casts.null_if(c("pick_value").try_cast("double"), 0).alias("slot_value_usd"),
    )


def stage_people(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        F.col("id").cast("long").alias("person_id"),
        F.col("birth_date").try_cast("date").alias("birth_date"),
        F.col("mlb_debut_date").try_cast("date").alias("mlb_debut_date"),
    )
    order = [nulls_last(F.col("mlb_debut_date")), nulls_last(F.col("birth_date"))]
    return keep_first(typed, ["person_id"], order)


def career_value(bat: DataFrame, pitch: DataFrame) -> DataFrame:
    def seasons(raw):
        kept = raw.filter(F.col("mlb_ID").isNotNull() & (F.col("year_ID") <= LAST_VALUE_SEASON))
        return kept.select(
            F.col("mlb_ID").cast("long").alias("mlb_id"), F.col("WAR").cast("double").alias("war")
        )

    both = tagged_union({"bat": seasons(bat), "pitch": seasons(pitch)})
    return sum_by_kind(both, ["mlb_id"], "war", ["bat", "pitch"], "career_war", prefix="war_")


def accepted_backfill(backfill: DataFrame, second: DataFrame) -> DataFrame:
    """Second-source rows whose name was verified, or differs only by a nickname."""
    trusted = F.col("bbref_matched") & (
        ~casts.is_true(F.col("name_mismatch")) | casts.is_true(F.col("same_last_name_initial"))
    )
    verified = backfill.filter(trusted).select(*GRAIN)
    rows = second.select(
        F.col("draft_year").cast("int").alias("draft_year"),
        F.col("overall_pick").cast("int").alias("pick_number"),
        F.col("signed").cast("boolean").alias("bbref_signed"),
        F.col("bonus_usd").cast("double").alias("bbref_bonus_usd"),
        F.col("from_type").alias("bbref_from_type"),
    )
    return verified.join(rows, GRAIN)


def with_money(df: DataFrame) -> DataFrame:
    year, own, other = F.col("draft_year"), F.col("mlb_bonus_usd"), F.col("bbref_bonus_usd")
    rules = [
        ((year <= 2016) & other.isNotNull(), "bbref"),
        ((year >= 2017) & own.isNotNull(), "mlb"),
        ((year == 2017) & other.isNotNull(), "bbref"),
    ]
    df = choose_source(df, rules, {"mlb": own, "bbref": other}, "bonus_usd", "bonus_source")
    df = df.withColumn("bonus_vs_slot", casts.safe_ratio(F.col("bonus_usd"), F.col("slot_value_usd")))
    return df.withColumn(
        "bonus_vs_slot_band", bands.ratio_band(F.col("bonus_vs_slot"), 0.95, 1.05, RATIO_BANDS)
    )


def with_school(df: DataFrame) -> DataFrame:
    """School type by the first rule that holds, then the columns that depend on it."""
    name = F.col("school_name_raw")
    evidence = (
        casts.is_true(name.rlike(HIGH_SCHOOL_NAME))
        | casts.is_true(F.col("school_class_level") == "HS")
        | casts.is_true(F.upper("bbref_from_type") == "HS")
    )
    # A missing name leaves the placeholder test unknown, so evidence does not count for it.
    high_school = (F.trim(name) != PLACEHOLDER_SCHOOL) & evidence
    school_type = bands.first_rule(
        [
            (high_school, "High school"),
            (F.col("ref_school_type") == "4YR", "4-year college"),
            (F.col("ref_school_type") == "JC", "Junior college"),
        ],
        "Unknown",
    )
    aligned = dates.by_period(
        F.col("draft_year"), LAST_OLD_ALIGNMENT, F.col("conference_pre2024"), F.col("conference_2024")
    )
    df = df.withColumns(
        {
            "school_type": school_type,
            "ref_division": casts.null_if(F.col("ref_division"), ""),
            "_aligned": casts.null_if(aligned, ""),
        }
    )
    is_hs = F.col("school_type") == "High school"
    four_year = F.col("school_type") == "4-year college"
    top = four_year & casts.is_true(F.col("ref_division") == "D1")
    conference = F.when(top, F.col("_aligned"))
    return df.withColumns(
        {
            "school": F.when(is_hs, name).otherwise(F.coalesce("school_canonical", name)),
            "division": F.when(~is_hs, F.col("ref_division")),
            "conference": conference,
            "conference_group": bands.first_rule(
                [
                    (conference.isNotNull(), conference),
                    (four_year, "Other 4-year"),
                    (F.col("school_type").isin("Junior college", "High school"), F.col("school_type")),
                ],
                "Unknown",
            ),
        }
    )


def position_group():
    position, hand = F.col("position"), F.col("pitch_hand")
    rules = [((position == "P") & (hand == h), label) for h, label in (("R", "RHP"), ("L", "LHP"))]
    rules.append((position == "C", "C"))
    rules += [(position.isin(*members), label) for members, label in POSITION_SETS]
    return bands.first_rule(rules, "Other")


def bonus_band():
    return bands.band(
        F.col("bonus_usd"), BONUS_EDGES, "$3M+", inclusive=False, null_label="Unknown",
        overrides=[(~F.col("signed"), "Unsigned")],
    )


def with_outcomes(df: DataFrame) -> DataFrame:
    """Outcome columns on the credited record, eligibility and tiers."""
    final, debut = F.col("is_final_draft"), F.col("mlb_debut_date")
    value = F.when(debut.isNull(), F.lit(0.0)).otherwise(F.col("career_value"))
    df = df.withColumns(
        {
            "reached_mlb": F.when(final, debut.isNotNull()),
            "years_to_debut": F.when(final, dates.elapsed_years(F.col("draft_start_date"), debut)),
            "career_war": F.when(final, value),
            "outcome_eligible": F.col("draft_year").between(*OUTCOME_YEARS) & final,
        }
    )
    return with_tiers(df)


def with_tiers(df: DataFrame) -> DataFrame:
    order = bands.tier_order(
        F.col("career_war"),
        TIER_THRESHOLDS,
        in_window=F.col("draft_year").between(*OUTCOME_YEARS),
        credited=F.col("is_final_draft") & F.col("signed"),
        reached=F.col("reached_mlb"),
    )
    df = df.withColumn("outcome_tier_order", order)
    return df.withColumns(
        {
            "outcome_tier": bands.ordinal_label(F.col("outcome_tier_order"), TIERS),
            "became_regular": F.when(F.col("outcome_eligible"), F.col("career_war") >= REGULAR_VALUE),
        }
    )


FACT_COLUMNS = [
    "draft_year", "pick_number", "round_label", "round_number", "team_name", "person_id",
    "player_name", "school_name_raw",
    "birth_date", "draft_start_date", "age_at_draft", "age_band", "position", "pitch_hand",
    "position_group",
    "slot_band", "round_band",
    "school_type", "school", "division", "conference", "conference_group",
    "bonus_usd", "bonus_source", "bonus_band", "slot_value_usd", "bonus_vs_slot",
    "bonus_vs_slot_band",
    "is_final_draft", "signed", "mlb_debut_date", "reached_mlb", "years_to_debut", "career_war",
    "outcome_eligible", "outcome_tier", "outcome_tier_order", "became_regular",
]


def build_fact(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """One row per pick with every dimension and outcome.

    Joins on the grain share one partitioning. Lookups by person and by school are salted, so
    rows without a person, or one name on a third of all rows, do not meet in one task.
    """
    picks = stage_picks(inputs["draft_picks"])
    second = accepted_backfill(inputs["bonus_backfill"], inputs["bbref_draft"])
    value = career_value(inputs["war_bat"], inputs["war_pitch"]).select(
        F.col("mlb_id").alias("person_id"), F.col("career_war").alias("career_value")
    )
    people = stage_people(inputs["people"]).join(value, "person_id", "left")
    schools = inputs["schools"].select(
        "school_name_raw",
        "school_canonical",
        F.col("school_type").alias("ref_school_type"),
        F.col("division").alias("ref_division"),
        "conference_pre2024",
        "conference_2024",
    )
    starts = inputs["draft_dates"].select(
        F.col("draft_year").cast("int").alias("draft_year"),
        F.col("draft_start_date").cast("date").alias("draft_start_date"),
    )
    df = picks.join(second, GRAIN, "left")
    df = flag_last(df, ["person_id"], GRAIN, "is_final_draft")
    df = lookup_join(df, people, ["person_id"], spread=GRAIN, hot=hot_keys(picks, ["person_id"]))
    df = lookup_join(df, schools, ["school_name_raw"], spread=GRAIN)
    df = lookup_join(df, starts, ["draft_year"], spread=["pick_number"])
    df = with_school(with_money(df))

    signed = F.col("is_final_draft") & (
        casts.is_true(F.col("bbref_signed"))
        | casts.is_true(F.col("bonus_usd") > 0)
        | F.col("mlb_debut_date").isNotNull()
    )
    birth, start = F.col("birth_date"), F.col("draft_start_date")
    df = df.withColumns(
        {
            "signed": signed,
            "age_at_draft": dates.age_one_decimal(birth, start),
            "age_band": bands.band(dates.completed_years(birth, start), AGE_EDGES, "23+"),
            "position_group": position_group(),
            "slot_band": bands.band(F.col("pick_number"), SLOT_EDGES, "301+", null_label="301+"),
            "round_band": bands.range_band(F.col("round_number"), ROUND_RANGES, "Supplemental"),
        }
    )
    df = df.withColumn("bonus_band", bonus_band())
    return with_outcomes(df).select(*FACT_COLUMNS)


@dataclass(frozen=True)
class Built:
    fact: DataFrame
    curve: DataFrame
    fits: dict[str, Fit]


RESIDUALS = [
    ("reached_mlb", "exp_mlb_signed", "mlb_minus_exp"),
    ("became_regular", "exp_regular_signed", "regular_minus_exp"),
]


def add_expectations(fact: DataFrame) -> Built:
    """Fits the four curves and adds expected values and residuals to every row."""
    c = OutcomeColumns()
    fits, last = fit_curves(fact)
    expected = with_residuals(with_expected(fact, fits, c), RESIDUALS, c)
    return Built(expected, curve_table(fact, fits, last, c.sequence), fits)


def build(inputs: Mapping[str, DataFrame]) -> Built:
    return add_expectations(build_fact(inputs))


def for_display(fact: DataFrame) -> DataFrame:
    """Fact rows with the 'Unknown' school labels renamed for readers."""
    return fact.withColumns(
        {c: casts.relabel(F.col(c), "Unknown", NO_SCHOOL) for c in ("school_type", "conference_group")}
    )
