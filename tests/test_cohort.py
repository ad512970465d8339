"""Metrics, trends and report rules on a cohort small enough to count by hand."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, report, stats
from cohortlens.operators.cohort import FilterSpec, Rules
from cohortlens.plans.draft import PRESETS, TIERS, TOP_TIERS
from cohortlens.session import cut_lineage

M = cohort.standard_metrics
ALL = Rules(count_uncredited=True)
SCHEMA = (
    "draft_year int, pick_number int, round_number int, school string, conference string, school_type string, "
    "is_final_draft boolean, signed boolean, outcome_eligible boolean, reached_mlb boolean, career_war double, "
    "became_regular boolean, bonus_usd double, years_to_debut double, outcome_tier string, exp_mlb_all double, "
    "exp_regular_all double, mlb_minus_exp double, regular_minus_exp double"
)
# Groups of players: class, school, signed, final, values of those who reached the top, others.
GROUPS = [
    (2016, "Harbor", True, True, (9.0, 5.5, 2.0), 3),
    (2016, "Harbor", False, True, (), 1),
    (2016, "Ridge", True, True, (1.5, 0.2, 16.0), 6),
    (2016, "Lake", True, True, (4.0,), 2),
    (2016, "Lake", False, False, (), 1),
    (2016, "Mill", True, True, (), 5),
    (2021, "Harbor", True, True, (3.0,), 3),
    (2021, "Mill", True, True, (), 2),
]
PLAYERS = [
    (year, school, signed, final, value)
    for year, school, signed, final, values, others in GROUPS
    for value in (*values, *[None] * others)
]
CONFERENCE = {"Harbor": "Coast", "Ridge": "Hill"}


def _rows():
    for i, (year, school, signed, final, value) in enumerate(PLAYERS, start=1):
        eligible = final and year <= 2019
        reached = (value is not None) if final else None
        war = (value or 0.0) if final else None
        high = (war >= 5) if eligible else None
        if year > 2019:
            tier = None
        elif not (final and signed):
            tier = TIERS[0]
        elif not reached:
            tier = TIERS[1]
        else:
            tier = TIERS[2 + sum(war >= t for t in (1, 5, 15))]
        scored = eligible and signed
        yield (
            year, i, i % 4 + 1 if i % 5 else None, school, CONFERENCE.get(school),
            "4-year college" if school in CONFERENCE else school, final, signed, eligible, reached, war, high,
            1000.0 * i if signed and i % 3 else None, 2.5 if reached else None, tier, 0.25, 0.1,
            reached - 0.25 if scored else None, high - 0.1 if scored else None,
        )


@pytest.fixture(scope="module")
def fact(spark):
    return cut_lineage(spark.createDataFrame(list(_rows()), SCHEMA))


def _one(df):
    r = df.first()
    return r["value"], r["n"]


def test_populations(fact):
    assert cohort.population(fact).count() == 23
    assert cohort.population(fact, ALL).count() == 24
    assert _one(stats.stat(fact, M()["mlb_pct"])) == (pytest.approx(7 / 23), 23)
    assert _one(stats.stat(fact, M()["mlb_pct"], ALL)) == (pytest.approx(7 / 24), 24)
    assert _one(stats.stat(fact, M()["regular_pct"])) == (pytest.approx(3 / 23), 23)


def test_each_metric_has_its_own_rows(fact):
    assert _one(stats.stat(fact, M()["signed_pct"])) == (pytest.approx(29 / 31), 31)
    assert _one(stats.stat(fact, M()["years_to_debut"])) == (2.5, 7)
    assert _one(stats.stat(fact, M()["war_per_player"]))[0] == pytest.approx(38.2 / 23)
    assert _one(stats.stat(fact, M()["mlb_vs_slot"]))[0] == pytest.approx(100 * (7 / 23 - 0.25))
    assert _one(stats.stat(fact, M()["mlb_vs_slot"], ALL))[0] == pytest.approx(100 * (7 / 24 - 0.25))


def test_all_metrics_at_once_equal_one_by_one(fact):
    for rules in (Rules(), ALL):
        together = {r["metric"]: (r["value"], r["lo"], r["hi"], r["n"])
                    for r in stats.stat_table(fact, list(M().values()), rules).collect()}
        for key, metric in M().items():
            r = stats.stat(fact, metric, rules).first()
            assert together[key] == pytest.approx((r["value"], r["lo"], r["hi"], r["n"]))


def test_an_empty_cohort_is_unknown(fact):
    nobody = fact.filter("draft_year = 1900")
    for key in ("mlb_pct", "mlb_vs_slot", "median_bonus"):
        r = stats.stat(nobody, M()[key]).first()
        assert (r["value"], r["lo"], r["hi"], r["n"]) == (None, None, None, 0)


def test_ranking_and_hidden_groups(fact):
    ranked = stats.ranking(fact, "school", M()["mlb_pct"], 5)
    assert [(r["group"], r["n"]) for r in ranked.collect()] == [("Harbor", 6), ("Ridge", 9), ("Mill", 5)]
    assert stats.hidden_groups(fact, "school", ranked).first()["hidden"] == 1
    only_2021 = fact.filter("draft_year = 2021")  # groups without any metric row are hidden too
    assert stats.hidden_groups(only_2021, "school", stats.ranking(only_2021, "school", M()["mlb_pct"], 1)).first()["hidden"] == 2
    by_conference = stats.stat(fact, M()["mlb_pct"], by=["conference"])
    assert {r["conference"] for r in by_conference.collect()} == {"Coast", "Hill"}  # no group, no row


def test_one_row_groups_have_no_direction(fact):
    single = stats.stat(fact.filter("pick_number = 1"), M()["mlb_vs_slot"])
    assert stats.delta_vs(single, 0.0).first()["sig"] == "none"


def test_filters(fact):
    spec = FilterSpec(ranges={"draft_year": (2016, 2016), "pick_number": (1, 20)}, members={"conference": ("Coast",), "school": ()})
    assert cohort.apply_filter(fact, spec).count() == 7
    assert cohort.apply_filter(fact, spec.baseline(["draft_year"])).count() == 25
    assert cohort.apply_filter(fact, FilterSpec(members={"conference": ("Hill", "None")})).count() == 9
    same = FilterSpec(members={"school_type": ("High school",), "position_group": ("2B/SS",), "school": ()})
    assert cohort.matching_preset(same, PRESETS) == "Prep shortstops"
    assert cohort.matching_preset(FilterSpec(), PRESETS) is None


def test_filter_reaches_the_scan(fact, tmp_path):
    path = str(tmp_path / "fact")
    fact.write.parquet(path)
    fact.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spec = FilterSpec(ranges={"draft_year": (2016, 2016)}, members={"school": ("Harbor", "Ridge")})
    narrowed = stats.stat(cohort.apply_filter(fact.sparkSession.read.parquet(path), spec), M()["mlb_pct"], by=["school"])
    plan = narrowed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(draft_year,2016)" in plan and "In(school, [Harbor,Ridge])" in plan
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "career_war" not in schema and "reached_mlb" in schema


def test_tier_tables(fact):
    dist = {r["tier"]: r["n"] for r in report.tier_distribution(fact, TIERS).collect()}
    assert list(dist) == TIERS[1:] and dist == {
        "Never reached MLB": 16, "Cup of coffee": 1, "Role player": 3, "Regular": 2, "Star": 1,
    }
    assert report.share_at_least(report.tier_distribution(fact, TIERS), TOP_TIERS).first()[0] == pytest.approx(3 / 23)
    assert report.tier_distribution(fact, TIERS, ALL).first()["n"] == 1
    mix = report.tier_mix(cohort.population(fact), "school", ["Ridge", "Nobody"], TIERS[1:]).collect()
    assert len(mix) == 10 and sum(r["n"] for r in mix) == 9
    assert {r["pct"] for r in mix if r["group"] == "Nobody"} == {None}
    empty = report.tier_distribution(fact.filter("draft_year = 1900"), TIERS).collect()
    assert {(r["n"], r["pct"]) for r in empty} == {(0, None)}


def test_trend_reference_rules(fact):
    east, west = F.col("conference") == "Coast", F.col("conference") == "Hill"
    both = F.col("conference").isNotNull()

    def roles(cohort_, lines):
        return {(r["line"], r["role"]) for r in report.trend_share(fact, cohort_, lines, "draft_year").collect()}

    assert roles(F.lit(True), {}) == {("This group", "line")}
    assert roles(both, {"E": east}) == {("E", "line"), ("This group", "reference")}
    assert roles(both, {"E": east, "W": west}) == {("E", "line"), ("W", "line")}  # the lines cover it
    assert roles(F.lit(True), {"E": east}) == {("E", "line")}  # the cohort is everyone
    shares = {(r["line"], r["draft_year"]): r["value"] for r in report.trend_share(fact, both, {"W": west}, "draft_year").collect()}
    assert shares[("W", 2016)] == pytest.approx(9 / 25) and shares[("W", 2021)] == 0.0

    def metric_roles(cohort_, lines):
        out = report.trend_metric(fact, cohort_, lines, M()["mlb_pct"])
        return {(r["line"], r["role"], r["draft_year"], r["n"]) for r in out.collect()}

    assert metric_roles(F.lit(True), {}) == {("This group", "line", 2016, 23)}
    assert metric_roles(east, {}) == {("This group", "line", 2016, 6), ("All draftees", "reference", 2016, 23)}
    assert metric_roles(F.lit(True), {"E": east}) == {("E", "line", 2016, 6), ("All draftees", "reference", 2016, 23)}


def test_leading_rounds(spark, rows):
    df = spark.createDataFrame(
        [(2015, 1, 1), (2015, 2, None), (2015, 3, 5), (2015, 4, None), (2015, 5, 6), (2016, 1, 1), (2016, 2, 4), (2017, 1, 5)],
        "draft_year int, pick_number int, round_number int",
    )
    kept = cohort.leading_cut(df.filter("pick_number <> 3"), df, "draft_year", "pick_number", "round_number", 5, spread=["pick_number"])
    assert sorted(rows(kept.select("draft_year", "pick_number"))) == [(2015, 1), (2015, 2), (2017, 1)]


def test_extremes(spark):
    for n, want in ((25, 25), (26, 24)):
        df = spark.range(n).select(F.col("id").cast("string").alias("group"), F.col("id").alias("value"))
        got = [r["value"] for r in report.extremes(df, [("value", True), ("group", False)]).collect()]
        assert len(got) == want and got == sorted(got, reverse=True) and {0, n - 1} <= set(got)


def test_top_lists(fact):
    assert [r["career_war"] for r in report.top_producers(fact, 3).collect()] == [16.0, 9.0, 5.5]
    misses = report.biggest_misses(fact, 2).collect()
    assert all(not m["reached_mlb"] and m["signed"] for m in misses) and misses[0]["bonus_usd"] >= misses[1]["bonus_usd"]


def test_band_ends_need_two_large_bands(fact):
    mix = report.tier_mix(cohort.population(fact), "school", ["Harbor", "Ridge", "Lake"], TIERS[1:])
    r = report.band_extremes(mix, TOP_TIERS, min_n=6).first()
    assert (r["first_group"], r["last_group"]) == ("Harbor", "Ridge") and r["first_rate"] == pytest.approx(2 / 6)
    assert report.band_extremes(mix, TOP_TIERS, min_n=9).count() == 0
