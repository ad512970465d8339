"""The profile report and document intake on the hand-made inputs."""

import json

import pytest
from draft_rows import PICK_ROWS, inputs
from pyspark.sql import functions as F

from cohortlens.plans import intake, profile_report
from cohortlens.sources.nested import read_json_documents


@pytest.fixture(scope="module")
def given(spark):
    tables = inputs(spark)
    schools = tables["schools"].withColumns({"type_source": F.lit("mlb_class"), "needs_review": F.lit("False")})
    return {**tables, "schools": schools}


@pytest.fixture(scope="module")
def report(given):
    return profile_report.build_profile(given)


def test_every_table_computes(report):
    assert len(report) >= 28
    for name, table in report.items():
        table.collect(), name


def test_counts_and_repeats(report, rows):
    years = {r["draft_year"]: (r["n_rows"], r["max_label"], r["n_other"]) for r in report["picks_per_year"].collect()}
    assert years[2012] == (1, None, 1) and years[2019] == (2, 30, 0)
    assert rows(report["supplemental_labels"]) == [("CB-A",)]
    assert rows(report["repeats"]) == [(1, 2, 2)]
    assert [r["person_id"] for r in report["repeat_examples"].collect()] == [1, 1]
    assert sum(r["picks"] for r in report["values_school_school_class"].collect()) == len(PICK_ROWS)


def test_people_and_values(report):
    match = report["value_match"].first()
    assert (match["debuted"], match["matched"]) == (5, 4)  # one debuted person has no value row
    assert [r["id"] for r in report["value_unmatched"].collect()] == [9]
    assert report["last_season"].first()["last_season"] == 2027


def test_backfill(report):
    rows = {r["draft_year"]: (r["mlb_picks"], r["bbref_rows"], r["joined"], r["name_mismatch"]) for r in report["backfill_rows"].collect()}
    assert rows[2014] == (2, 2, 2, 2) and rows[2012] == (1, 2, 1, 0)
    assert report["backfill_match"].first()["nicknames"] == 1
    assert [(r["draft_year"], r["pick_number"]) for r in report["second_source_orphans"].collect()] == [(2012, 586)]
    before = {r["draft_year"]: r["1-5"] for r in report["coverage_before"].collect()}
    after = {r["draft_year"]: r["1-5"] for r in report["coverage_after"].collect()}
    assert (before[2016], after[2016]) == (0.0, 100.0) and after[2014] is None
    assert report["crosscheck"].first()["n"] == 1 and report["crosscheck_top"].first()["diff"] == -100000.0


def test_schools(report):
    size = report["schools"].first()
    assert (size["n_rows"], size["n_canonical"], size["n_alias_groups"], size["n_flagged"]) == (5, 5, 0, 0)
    share = report["conference_share"].first()
    assert share["college_picks"] == 11 and share["not_listed"] == len(PICK_ROWS) - 11


def test_intake(spark, tmp_path, rows):
    (tmp_path / "people.json").write_text(json.dumps({"people": [
        {"id": 1, "fullName": "Ann", "birthDate": "2000-01-01", "primaryPosition": {"abbreviation": "P"}},
        {"id": 2, "fullName": "Bob", "batSide": {"code": "L"}},
    ]}))
    people, absent = intake.flatten_people(read_json_documents(spark, str(tmp_path / "people.json")))
    assert absent == ["mlb_debut_date", "birth_country", "pitch_hand_*"]
    assert sorted(rows(people.select("id", "full_name", "primary_position_abbreviation"))) == [(1, "Ann", "P"), (2, "Bob", None)]
    picks = spark.createDataFrame([(1,), (3,), (3,), (None,)], "person_id long")
    assert rows(intake.people_missing(picks, people)) == [(3,)]
    with pytest.raises(ValueError, match="mlb_ID"):
        intake.value_table(people, "war_bat")
    (tmp_path / "draft.json").write_text(json.dumps({"drafts": {"rounds": [{"round": "1", "picks": [
        {"pickNumber": 1, "signingBonus": "$1,250,000"}, {"pickNumber": 2, "signingBonus": None}]}]}}))
    drafted = intake.flatten_draft(read_json_documents(spark, str(tmp_path / "draft.json")), 2023)
    assert sorted(rows(drafted.select("draft_year", "pick_number", "signing_bonus_usd"))) == [(2023, 1, 1250000.0), (2023, 2, None)]
