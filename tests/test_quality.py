"""Every check must fail or warn on a copy of good data broken for it."""

import pytest
from draft_rows import inputs
from pyspark.sql import functions as F

from cohortlens.operators import quality as Q
from cohortlens.plans import draft, quality_gate
from cohortlens.session import cut_lineage


@pytest.fixture(scope="module")
def fact(spark):
    built = cut_lineage(draft.build_fact(inputs(spark)))
    for name in quality_gate.CURVES:
        built = built.withColumn(name, F.lit(0.25))
    return built


@pytest.fixture(scope="module")
def curve(spark):
    return spark.range(1, 60).select(
        F.col("id").alias("pick_number"), *[(1 / F.col("id")).alias(n) for n in quality_gate.CURVES]
    )


DECILES = [(d, 100, d / 10, d / 10) for d in range(1, 10)]


@pytest.fixture(scope="module")
def run(spark, fact, curve):
    def results(df=None, curve_=None, deciles=DECILES):
        bins = spark.createDataFrame(deciles, "decile int, n long, expected double, observed double")
        out = quality_gate.run_checks(df if df is not None else fact, fact, curve_ if curve_ is not None else curve, bins)
        return {r["name"]: (r["status"], r["value"]) for r in out.collect()}

    return results


def test_nineteen_checks_on_good_data(run):
    got = run()
    assert len(got) == 19
    fine = {"row_count", "unique_pick", "one_final_draft_per_person", "people_join", "age_at_draft_range", "bonus_range",
            "debut_after_draft", "no_signed_non_final", "debuted_players_signed", "slot_expectation_complete",
            "outcome_tiers_complete", "slot_curve_monotone", "slot_model_calibrated", "college_d1_conference_share"}
    assert {n for n in fine if got[n][0] != "pass"} == set()
    assert got["years_present"] == ("fail", 13.0)  # no 2023 class in the rows
    assert got["max_round_by_year"][0] == "fail" and got["bonus_coverage_rounds_1_10"][0] == "warn"


def _where(year, pick):
    return (F.col("draft_year") == year) & (F.col("pick_number") == pick)


def _set(df, column, value, year=2017, pick=5):
    kind = dict(df.dtypes)[column]
    return df.withColumn(column, F.when(_where(year, pick), F.lit(value).cast(kind)).otherwise(F.col(column)))


MUTATIONS = {
    "unique_pick": ("fail", lambda df: df.unionByName(df.filter(_where(2017, 5)))),
    "row_count": ("fail", lambda df: df.filter(~_where(2017, 5))),
    "one_final_draft_per_person": ("fail", lambda df: _set(df, "is_final_draft", False)),
    "people_join": ("fail", lambda df: _set(df, "birth_date", None)),
    "war_join": ("fail", lambda df: _set(df, "career_war", None)),
    "age_at_draft_range": ("warn", lambda df: _set(df, "age_at_draft", 41.0)),
    "bonus_range": ("warn", lambda df: _set(df, "bonus_usd", 15_000_001.0)),
    "debut_after_draft": ("warn", lambda df: df.withColumn("mlb_debut_date", F.col("draft_start_date"))),
    "no_signed_non_final": ("fail", lambda df: _set(df, "signed", True, 2013, 270)),
    "debuted_players_signed": ("fail", lambda df: _set(df, "signed", False)),
    "slot_expectation_complete": ("fail", lambda df: _set(df, "exp_mlb_all", 1.01)),
    "outcome_tiers_complete": ("fail", lambda df: _set(df, "outcome_tier", None)),
    "unknown_school_type_share": ("warn", lambda df: df.withColumn("school_type", F.lit("Unknown"))),
}


@pytest.mark.parametrize("name", sorted(MUTATIONS))
def test_each_check_notices_its_break(run, fact, name):
    status, mutate = MUTATIONS[name]
    assert run(mutate(fact))[name][0] == status


def test_a_tier_outside_the_window_fails(run, fact):
    assert run(_set(fact, "outcome_tier", "Star", 2024, 10))["outcome_tiers_complete"] == ("fail", 1.0)


def test_curve_and_calibration(run, curve):
    risen = curve.withColumn("exp_mlb_all", F.when(F.col("pick_number") == 40, F.lit(0.5)).otherwise(F.col("exp_mlb_all")))
    assert run(curve_=risen)["slot_curve_monotone"] == ("fail", 1.0)
    off = [*DECILES, (10, 100, 0.5, 0.8)]
    assert run(deciles=off)["slot_model_calibrated"] == ("warn", 1.0)


def test_empty_set_counts_as_complete(spark, fact):
    check = Q.join_coverage("c", "birth_date", "", among=F.col("draft_year") == 1900)
    assert Q.run_row_checks(fact, [check]).first()["value"] == 100.0


def test_full_report_finds_examples_only_where_needed(fact, curve):
    broken = _set(fact, "age_at_draft", 41.0)
    report = quality_gate.quality_report(broken, fact, curve)
    checks = {r["name"]: r for r in report["checks"].collect()}
    assert len(checks) == 19
    assert "41.0" in checks["age_at_draft_range"]["examples"][0]
    assert checks["unique_pick"]["examples"] == []
    assert len(checks["max_round_by_year"]["examples"]) <= 20
    tally = report["summary"].first()
    assert tally["n_pass"] + tally["n_warn"] + tally["n_fail"] == 19 and tally["gate_open"] is False
    assert report["school_type_mix_by_year"].count() > 0
    with pytest.raises(RuntimeError, match="years_present"):
        quality_gate.enforce(report)
    mix = report["outcome_tier_mix_by_year"].filter("draft_year = 2019").collect()
    assert sum(r["picks"] for r in mix) == 2
