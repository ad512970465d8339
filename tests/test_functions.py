"""Column expressions against hand-worked values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import bands, casts, dates, formats, intervals
from cohortlens.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    """Evaluates columns over a single row of named values."""

    def run(columns, schema="x int", row=(None,)):
        return tuple(spark.createDataFrame([row], schema).select(*columns).first())

    return run


@pytest.mark.parametrize(
    ("raw", "want"),
    [("$1,250,000", 1250000.0), ("350000", 350000.0), (" $ 5 ", 5.0), ("n/a", None), (None, None), ("", None)],
)
def test_parse_money(one, raw, want):
    assert one([casts.parse_money(F.col("s"))], "s string", (raw,)) == (want,)


def test_leading_token_needs_a_known_level(one):
    for raw, want in (("4YR JR", "4YR"), (" hs sr ", "HS"), ("JR", None), (None, None), ("", None)):
        assert one([casts.leading_token(F.col("s"), T.LEVELS)], "s string", (raw,)) == (want,)


def test_flags(one):
    cols = [casts.yes_no(F.col("s")), casts.text_flag(F.col("s"))]
    assert one(cols, "s string", ("Y",)) == (True, False)
    assert one(cols, "s string", ("True",)) == (None, True)
    assert one(cols, "s string", (None,)) == (None, False)


@pytest.mark.parametrize(
    ("birth", "at", "years", "age"),
    [
        ("2003-07-15", "2024-07-14", 20, 20.9),
        ("2004-07-13", "2025-07-13", 21, 21.0),
        ("2004-02-29", "2022-02-28", 18, 18.0),
        ("2000-01-31", "2018-06-04", 18, 18.3),
        ("2005-06-05", "2024-06-04", 18, 18.9),
    ],
)
def test_ages(one, birth, at, years, age):
    day = [dt.date.fromisoformat(d) for d in (birth, at)]
    b, a = F.col("b"), F.col("a")
    got = one([dates.completed_years(b, a), dates.age_one_decimal(b, a)], "b date, a date", tuple(day))
    assert got == (years, age)


def test_first_date_of_a_range(one):
    for raw, want in (
        ("June 10–11, 2020", dt.date(2020, 6, 10)),
        ("July 13–14, 2025", dt.date(2025, 7, 13)),
        ("June 4 –6, 2012", dt.date(2012, 6, 4)),
        ("sometime in summer", None),
        ("Juny 4, 2012", None),
        (None, None),
    ):
        assert one([dates.first_date_of_range(F.col("s"))], "s string", (raw,)) == (want,)


@pytest.mark.parametrize(("k", "n"), [(7, 26), (0, 5), (5, 5), (1, 1), (300, 4951)])
def test_wilson_bounds_solve_the_score_equation(one, k, n):
    lo, hi = one(list(intervals.wilson(F.col("k"), F.col("n"))), "k int, n int", (k, n))
    p = k / n
    for bound in (lo, hi):
        if 0 < bound < 1:
            assert abs(p - bound) == pytest.approx(1.645 * math.sqrt(bound * (1 - bound) / n))
    assert 0 <= lo <= p <= hi <= 1


def test_the_two_empty_wilson_policies(one):
    k, n, p = F.col("k"), F.col("n"), F.lit(0.5)
    assert one([*intervals.wilson(k, n), *intervals.wilson_rate(p, n)], "k int, n int", (0, 0)) == (
        None, None, 0.0, 1.0,
    )


def test_mean_interval_of_one_row_is_unknown(one):
    got = one([*intervals.mean_interval(F.lit(2.0), F.col("s"), F.lit(1))], "s double", (None,))
    assert got == (None, None)


@pytest.mark.parametrize(
    ("lo", "hi", "want"),
    [(0.1, 5.6, "above"), (-5.7, -2.1, "below"), (-1.0, 1.0, "same"), (0.0, 2.0, "same"), (-2.0, 0.0, "same"),
     (None, 1.0, "none"), (1.0, None, "none")],
)
def test_direction(one, lo, hi, want):
    assert one([intervals.direction(F.col("lo"), F.col("hi"))], "lo double, hi double", (lo, hi)) == (want,)


def test_band_edges_and_null_policies(one):
    edges = [(10, "low"), (20, "mid")]
    x = F.col("x")
    inclusive, strict = bands.band(x, edges, "high"), bands.band(x, edges, "high", inclusive=False, null_label="?")
    for value, want in ((10, ("low", "mid")), (20, ("mid", "high")), (21, ("high", "high")), (None, (None, "?"))):
        assert one([inclusive, strict], "x int", (value,)) == want


def test_ratio_band(one):
    labels = ("under", "at", "over")
    for value, want in ((0.9499, "under"), (0.95, "at"), (1.05, "at"), (1.0501, "over"), (None, None)):
        assert one([bands.ratio_band(F.col("r"), 0.95, 1.05, labels)], "r double", (value,)) == (want,)
    assert one([casts.safe_ratio(F.lit(1.0), F.col("d"))], "d double", (0.0,)) == (None,)


def test_ordinals_and_declared_order(one):
    labels = ["a", "b", "c"]
    cols = [bands.ordinal_label(F.col("i"), labels), bands.label_order(F.col("s"), labels)]
    assert one(cols, "i int, s string", (2, "b")) == ("c", 1)
    assert one(cols, "i int, s string", (None, "z")) == (None, None)


@pytest.mark.parametrize(
    ("x", "usd", "short"),
    [(1_200_000.0, "$1.2M", None), (999_600.0, "$1M", None), (350_000.0, "$350k", None), (800.0, "$800", None),
     (0.29, None, "29%"), (0.095, None, "10%"), (0.0244, None, "2.4%"), (None, "—", "—")],
)
def test_formats(one, x, usd, short):
    got = one([formats.usd(F.col("x")), formats.pct_short(F.col("x"))], "x double", (x,))
    assert usd in (None, got[0]) and short in (None, got[1])


def test_signed_formats_round_like_python(one):
    for x in (2.84, -3.91, 0.0, 0.25, 0.35, -0.04, 1234.5):
        got = one([formats.points(F.col("x")), formats.pct(F.col("x"))], "x double", (x,))
        assert got == (f"{x:+.1f} pts".replace("-", "−"), f"{100 * x:.1f}%")


@pytest.mark.parametrize(
    ("name", "key"),
    [("Cal St Long Beach", "cal state long beach"), ("St. John's", "saint johns"),
     ("Mount St. Mary's", "mount saint marys"), ("Texas A&M", "texas a and m"), ("SUNY Stony Brook", "stony brook"),
     ("UNC Charlotte", "north carolina charlotte"), ("University of Texas at Arlington", "university of texas arlington"),
     ("Boston Col", "boston college"), ("Abilene Christian U", "abilene christian university"),
     ("Peña[2] College", "pena college")],
)
def test_entity_key(one, name, key):
    assert one([T.entity_key(F.col("s"))], "s string", (name,)) == (key,)


def test_key_variants_and_pools(one):
    key = T.entity_key(F.col("s"))
    assert set(one([T.key_variants(key)], "s string", ("University of Virginia",))[0]) == {
        "university of virginia", "virginia",
    }
    pools = [one([T.pool_key(F.col("s"))], "s string", (n,))[0]
             for n in ("Arizona ", "Arizona", "Concordia (MN)", "Concordia (NE)")]
    assert pools[0] == pools[1] and pools[2] != pools[3]


@pytest.mark.parametrize(
    ("raw", "other", "want"),
    [("TCU", "Texas Christian University", True), ("LSU", "Louisiana State University", True),
     ("Virginia", "University of Virginia", True), ("Blythewood (SC) HS", "University of South Carolina", False),
     ("Christopher Newport", "East Carolina University", False), ("X", None, False),
     ("Cal St Long Beach", "California State University, Long Beach", True)],
)
def test_names_consistent(one, raw, other, want):
    key, other_key = T.entity_key(T.strip_state_tag(F.col("a"))), T.entity_key(F.col("b"))
    assert one([T.names_consistent(key, other_key)], "a string, b string", (raw, other)) == (want,)


@pytest.mark.parametrize(
    ("name", "label"),
    [("Alonso (FL) HS", "HS"), ("Cypress CC", "JC"), ("Abilene Christian U", "4YR"), ("Home School (Orlando, FL)", "HS"),
     ("IMG Academy", "HS"), ("Colorado School of Mines", None), ("Air Force Academy", None), ("Rice", None)],
)
def test_name_rules(one, name, label):
    assert one([T.first_match(F.col("s"), T.NAME_RULES)], "s string", (name,)) == (label,)


def test_locations(one):
    cols = [T.strip_location(F.col("s")), T.location_state(F.col("s"))]
    assert one(cols, "s string", ("Louisiana State University (Baton Rouge, LA)",)) == (
        "Louisiana State University", "LA",
    )
    assert one(cols, "s string", ("Rice",)) == ("Rice", None)


@pytest.mark.parametrize(
    ("a", "b", "score", "initial"),
    [("Alfredo Escalera", "Alfredo Escalera-Maldonado", 76.2, False), ("Patrick Ludwig", "Pat Ludwig", 83.3, True),
     ("Derek De Young", "Derek DeYoung", 81.5, False), ("Jacob Post", "Jake Post", 73.7, True),
     ("José Ramírez Jr.", "Ramirez, Jose", 100.0, False), ("A.J. Reed", "AJ Reed III", 100.0, True)],
)
def test_name_scores(one, a, b, score, initial):
    ka, kb = T.person_key(F.col("a")), T.person_key(F.col("b"))
    got = one([T.token_sort_score(ka, kb), T.same_last_initial(ka, kb)], "a string, b string", (a, b))
    assert (round(got[0], 1), got[1]) == (score, initial)


def test_score_needs_both_names(one):
    ka, kb = T.person_key(F.col("a")), T.person_key(F.col("b"))
    assert one([T.token_sort_score(ka, kb)], "a string, b string", ("", "Jo")) == (None,)


def test_score_against_a_quadratic_common_subsequence(spark):
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, start=1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc d", k=rng.randint(1, 90))), "".join(rng.choices("abc d", k=rng.randint(1, 90))))
             for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.subsequence_ratio("a", "b").alias("s"))
    for r in got.collect():
        assert r["s"] == pytest.approx(200 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])))


def test_person_key_drops_whole_suffix_words_only(spark, rows):
    cases = [
        ("José  O'Neil Jr.", "jose oneil"), ("IV ii Vik v", "vik"), ("Jr", ""), (None, ""), ("", ""),
        ("ﬁnn—Å.B. III", "finn ab"), ("Sr-Anna, Ivy", "anna ivy"),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = dict(rows(df.select("i", T.person_key(F.col("a")))))
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_folding_sends_no_ascii_text_to_python(spark, rows):
    df = spark.createDataFrame([("plain",), ("Ünï",), (None,)], "a string")
    assert {a for (a,) in rows(df.select(T.fold_accents(F.col("a"))))} == {"Uni", None, "plain"}
    plan = df.select(T.fold_accents(F.col("a")))._jdf.queryExecution().toString()
    assert "octet_length" in plan and "_folded(CASE WHEN" in plan
