import pytest
from draft_rows import PICK_ROWS, inputs
from pyspark.sql import functions as F

from cohortlens.plans import draft


@pytest.fixture(scope="module")
def built(spark):
    result = draft.build(inputs(spark))
    return result, {(r["draft_year"], r["pick_number"]): r for r in result.fact.collect()}


@pytest.fixture(scope="module")
def row(built):
    return lambda year, pick: built[1][(year, pick)]


def test_grain_and_contract(built):
    assert len(built[1]) == len(PICK_ROWS) == built[0].fact.count()
    expected = set(draft.FACT_COLUMNS) | set(built[0].fits) | {"mlb_minus_exp", "regular_minus_exp"}
    assert set(built[0].fact.columns) == expected


def test_outcomes_only_on_the_final_record(row):
    first, final = row(2013, 270), row(2016, 45)
    assert (first["is_final_draft"], final["is_final_draft"]) == (False, True)
    assert first["reached_mlb"] is None and first["career_war"] is None and not first["signed"]
    assert first["bonus_band"] == "Unsigned"
    assert final["reached_mlb"] and final["years_to_debut"] == 2.0
    assert final["career_war"] == pytest.approx(15.4) and final["outcome_tier"] == "Star"
    assert (first["outcome_tier"], first["became_regular"]) == ("Didn't sign", None)


def test_money_source_priority(row):
    assert (row(2016, 45)["bonus_source"], row(2016, 45)["bonus_usd"]) == ("bbref", 1365000.0)
    assert (row(2017, 5)["bonus_source"], row(2017, 5)["bonus_usd"]) == ("mlb", 4200000.0)
    assert (row(2017, 610)["bonus_source"], row(2017, 610)["bonus_usd"]) == ("bbref", 130000.0)
    zero = row(2018, 1150)
    assert zero["bonus_usd"] is None and zero["slot_value_usd"] is None and zero["bonus_source"] is None


def test_ratio_and_money_bands(row):
    assert row(2016, 45)["bonus_vs_slot_band"] == "at slot"  # exactly 1.05
    assert row(2017, 5)["bonus_vs_slot_band"] == "at slot"
    assert row(2024, 10)["bonus_vs_slot_band"] == "under slot"
    assert row(2019, 331)["bonus_vs_slot_band"] is None
    assert [row(*k)["bonus_band"] for k in ((2024, 10), (2025, 11), (2021, 110), (2019, 331), (2020, 150))] == [
        "$3M+", "$1M–$3M", "$500k–$1M", "$100k–$500k", "<$100k",
    ]
    assert row(2019, 900)["bonus_band"] == "Unsigned"


def test_verified_names(row):
    nickname, other = row(2014, 360), row(2014, 390)
    assert nickname["bonus_usd"] == 75000.0 and nickname["signed"]
    assert other["bonus_usd"] is None and not other["signed"]
    assert other["school_type"] == "4-year college"  # the rejected row's HS type is not used


def test_schools(row):
    early, late = row(2024, 10), row(2025, 11)
    assert (early["conference"], late["conference"]) == ("Old League", "New League")
    assert early["school"] == late["school"] == "State Technical University"
    for key in ((2013, 270), (2021, 110), (2015, 101)):  # by name, class, second source
        assert row(*key)["school_type"] == row(*key)["conference_group"] == "High school"
        assert row(*key)["school"] == row(*key)["school_name_raw"] and row(*key)["conference"] is None
    assert row(2022, 200)["school_type"] == "Unknown"  # a placeholder is no high school
    assert row(2012, 31)["conference_group"] == "Unknown"
    assert row(2018, 1150)["conference_group"] == "Junior college"
    assert row(2019, 331)["conference_group"] == "Other 4-year"
    assert row(2020, 150)["conference_group"] == "Service"


def test_age_is_cut_to_one_decimal_and_turns_on_the_birthday(row):
    assert (row(2024, 10)["age_at_draft"], row(2024, 10)["age_band"]) == (20.9, "20")
    assert (row(2025, 11)["age_at_draft"], row(2025, 11)["age_band"]) == (21.0, "21")
    assert row(2021, 110)["age_band"] == "≤18" and row(2012, 31)["age_band"] == "23+"


def test_positions_slots_and_rounds(row):
    keys = ((2016, 45), (2018, 1150), (2014, 360), (2014, 390), (2017, 5), (2024, 10), (2019, 331))
    assert [row(*k)["position_group"] for k in keys] == [
        "RHP", "LHP", "C", "1B/3B", "2B/SS", "OF", "Other",
    ]
    assert [row(*k)["slot_band"] for k in ((2024, 10), (2025, 11), (2015, 101), (2019, 900))] == [
        "1–10", "11–30", "101–300", "301+",
    ]
    assert [row(*k)["round_band"] for k in ((2012, 31), (2022, 200), (2019, 331), (2017, 610), (2018, 1150))] == [
        "Supplemental", "6–10", "11–20", "11–20", "21+",
    ]


def test_value_and_tiers(row):
    assert row(2012, 31)["career_war"] == 1.0 and row(2012, 31)["outcome_tier"] == "Role player"
    assert row(2017, 5)["outcome_tier"] == "Regular" and row(2017, 5)["became_regular"] is True
    assert row(2017, 610)["outcome_tier"] == "Never reached MLB" and row(2017, 610)["career_war"] == 0.0
    assert row(2025, 11)["outcome_tier"] is None and row(2025, 11)["became_regular"] is None
    assert row(2019, 900)["outcome_tier"] == "Didn't sign" and row(2019, 900)["became_regular"] is False


def test_expectations(built, row):
    for r in built[1].values():
        assert all(0 <= r[c] <= 1 for c in built[0].fits)
    assert row(2013, 270)["mlb_minus_exp"] is None and row(2024, 10)["mlb_minus_exp"] is None
    hit = row(2017, 5)
    assert hit["mlb_minus_exp"] == pytest.approx(1 - hit["exp_mlb_signed"])
    assert built[0].curve.count() == max(r[2] for r in PICK_ROWS)


def test_display_labels(built, rows):
    shown = draft.for_display(built[0].fact)
    assert "Unknown" not in {r[0] for r in rows(shown.select("school_type").distinct())}


def test_no_join_moves_whole_people_by_id(spark):
    """Lookups by person and school carry a salt, so a hot key is spread."""
    plan = draft.build_fact(inputs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_salt") >= 3
    assert "Window" not in plan


def test_tier_edges(spark, rows):
    values = [0.99, 1.0, 4.99, 5.0, 14.99, 15.0, None]
    df = spark.createDataFrame([(2015, True, True, True, v) for v in values],
                               "draft_year int, is_final_draft boolean, signed boolean, reached_mlb boolean, career_war double")
    df = df.withColumn("outcome_eligible", F.lit(True))
    got = rows(draft.with_tiers(df).select("career_war", "outcome_tier_order"))
    assert dict(got) == {0.99: 2, 1.0: 3, 4.99: 3, 5.0: 4, 14.99: 4, 15.0: 5, None: None}
