"""The nineteen checks on the fact table, their report tables, and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import is_true
from cohortlens.functions.dates import step_by_period
from cohortlens.operators import quality as Q
from cohortlens.operators.expect import curve_rises, evaluate, held_out_deciles, standard_curves
from cohortlens.operators.profile import value_freq
from cohortlens.operators.report import coverage, share_of_parent
from cohortlens.session import cut_lineage
from cohortlens.plans.draft import CLASS_YEARS, GRAIN, OUTCOME_YEARS, TIERS

# Curve columns, limits and the yearly number of rounds.
CURVES = ("exp_mlb_signed", "exp_mlb_all", "exp_regular_signed", "exp_regular_all")
AGE_RANGE, BONUS_RANGE = (16, 26), (0, 15_000_000)
ROUND_STEPS, LATEST_ROUNDS = [(2019, 40), (2020, 5)], 20
COLLEGES = ("4-year college", "Junior college")
WHO = ("draft_year", "pick_number", "player_name")


def expected_rounds():
    return step_by_period(F.col("draft_year"), ROUND_STEPS, LATEST_ROUNDS)


def row_checks() -> list[Q.Check]:
    """Every check one pass over the rows can decide."""
    c = F.col
    outside = F.lit(False)
    for name in CURVES:
        outside = outside | c(name).isNull() | (c(name) < 0) | (c(name) > 1)
    in_window = c("draft_year").between(*OUTCOME_YEARS)
    tier_wrong = (in_window & ~is_true(c("outcome_tier").isin(*TIERS))) | (
        ~in_window & c("outcome_tier").isNotNull()
    )
    early = c("mlb_debut_date") <= c("draft_start_date")
    return [
        Q.join_coverage("people_join", "birth_date", "% of rows with a birth date", WHO),
        Q.join_coverage(
            "war_join", "career_war", "% of debuted final records with a value", WHO,
            among=c("is_final_draft") & is_true(c("reached_mlb")), warn_below=None,
        ),
        Q.outside_range("age_at_draft_range", "age_at_draft", *AGE_RANGE, "rows outside the age range", WHO),
        Q.outside_range("bonus_range", "bonus_usd", *BONUS_RANGE, "money outside its range", WHO),
        Q.rule("debut_after_draft", "validity", early, "warn", "debut on or before the event date",
               (*WHO, "draft_start_date", "mlb_debut_date")),
        Q.share("college_d1_conference_share", c("conference").isNotNull(),
                "% of college picks with a conference", among=c("school_type").isin(*COLLEGES),
                within=[("four-year picks", c("school_type") == COLLEGES[0])]),
        Q.share("unknown_school_type_share", c("school_type") == "Unknown",
                "% of picks without a school type", warn_above=5.0),
        Q.implication("no_signed_non_final", c("signed"), c("is_final_draft"),
                      "non-final rows marked signed", WHO),
        Q.implication("debuted_players_signed", c("reached_mlb"), c("signed"),
                      "debuted final records not marked signed", WHO),
        Q.rule("slot_expectation_complete", "model", outside, "fail",
               "rows missing an expected value or with one outside [0, 1]", (*WHO, *CURVES)),
        Q.rule("outcome_tiers_complete", "business_logic", tier_wrong, "fail",
               "rows with a missing tier in the window or a tier outside it", (*WHO, "outcome_tier")),
    ]


def run_checks(
    fact: DataFrame, source: DataFrame, curve: DataFrame, deciles: DataFrame
) -> DataFrame:
    """All nineteen results, without examples."""
    first_ten = F.col("round_number").between(1, 10)
    coverage_years = Q.coverage_by_period(fact, "draft_year", "bonus_usd", first_ten)
    results = [
        Q.row_count(fact, source),
        Q.unique_result(fact, GRAIN, "unique_pick", "rows share their grain key"),
        Q.offenders_result(Q.final_offenders(fact, "person_id", "is_final_draft"),
                           "one_final_draft_per_person", "uniqueness", "fail",
                           "people without exactly one final record"),
        Q.period_result(fact, "draft_year", *CLASS_YEARS),
        Q.offenders_result(
            Q.max_label_offenders(fact, "draft_year", "round_number", expected_rounds()),
            "max_round_by_year", "completeness", "fail", "years whose highest round is unexpected",
        ),
        Q.run_row_checks(fact, row_checks()),
        Q.coverage_result(coverage_years, "bonus_coverage_rounds_1_10", 90,
                          "lowest yearly % of round 1-10 picks with money"),
        Q.monotone_result(curve, "pick_number", CURVES),
        Q.calibration_result(deciles),
    ]
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def offending_rows(fact: DataFrame, curve: DataFrame, deciles: DataFrame) -> dict[str, DataFrame]:
    """Examples per check, each a bounded top list that is only run when asked for."""
    found = {
        check.name: Q.examples(fact.filter(check.bad), check.name, GRAIN, check.show)
        for check in row_checks()
        if check.bad is not None
    }
    reductions = {
        "unique_pick": (Q.key_offenders(fact, GRAIN).select(*WHO), GRAIN),
        "one_final_draft_per_person": (
            Q.final_offenders(fact, "person_id", "is_final_draft"), ["person_id"]),
        "years_present": (Q.missing_periods(fact, "draft_year", *CLASS_YEARS), ["draft_year"]),
        "bonus_coverage_rounds_1_10": (
            Q.low_periods(
                Q.coverage_by_period(fact, "draft_year", "bonus_usd", F.col("round_number").between(1, 10)), 90
            ),
            ["draft_year"],
        ),
        "max_round_by_year": (
            Q.max_label_offenders(fact, "draft_year", "round_number", expected_rounds()), ["draft_year"]),
        "slot_curve_monotone": (curve_rises(curve, "pick_number", CURVES), ["curve", "pick_number"]),
        "slot_model_calibrated": (Q.calibration_offenders(deciles), ["decile"]),
        "unknown_school_type_share": (
            value_freq(fact.filter(F.col("school_type") == "Unknown"), "school_name_raw", "picks"),
            [F.col("picks").desc(), "school_name_raw"]),
    }
    for name, (rows, order) in reductions.items():
        found[name] = Q.examples(rows, name, order)
    return found


def quality_report(fact: DataFrame, source: DataFrame, curve: DataFrame) -> dict[str, DataFrame]:
    """Checks with examples, their tally, and the report tables.

    The nineteen statuses are looked at first, so examples are only searched for the checks
    that did not pass.
    """
    evaluation = evaluate(fact)
    all_deciles = cut_lineage(held_out_deciles(fact, evaluation.held_out, standard_curves(), GRAIN))
    deciles = all_deciles.filter(F.col("curve") == "exp_mlb_signed").drop("curve")
    results = cut_lineage(run_checks(fact, source, curve, deciles))
    open_checks = {r["name"] for r in results.select("name", "status").collect() if r["status"] != "pass"}
    examples = offending_rows(fact, curve, deciles)
    wanted = [df for name, df in examples.items() if name in open_checks]
    tiered = fact.filter(F.col("draft_year").between(*OUTCOME_YEARS))
    return {
        "checks": Q.attach_examples(results, wanted),
        "summary": Q.tally(results),
        "bonus_coverage_by_year_round_band": coverage(fact, ["draft_year", "round_band"], "bonus_usd"),
        "school_type_mix_by_year": share_of_parent(fact, ["draft_year"], ["school_type"], "picks"),
        "outcome_tier_mix_by_year": share_of_parent(
            tiered, ["draft_year"], ["outcome_tier_order", "outcome_tier"], "picks"),
        "slot_model": evaluation.report,
        "slot_model_deciles": all_deciles.withColumns(
            {c: F.round(c, 4) for c in ("expected", "observed")}
        ),
        "slot_model_at_picks": evaluation.at_positions(),
    }


def enforce(report: dict[str, DataFrame]) -> None:
    """Stops the build when any check failed."""
    failed = [r["name"] for r in report["checks"].filter("status = 'fail'").select("name").collect()]
    if failed:
        raise RuntimeError(f"quality gate closed: {', '.join(sorted(failed))}")
