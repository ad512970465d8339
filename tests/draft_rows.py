"""Hand-made inputs of the fact-table job: every rule has a row on each side of its edge."""

import datetime as dt

D = dt.date
PICKS = """draft_year int, pick_round string, pick_number int, team_name string, person_id long,
person_full_name string, school_name string, school_school_class string,
person_primary_position_abbreviation string, person_pitch_hand_code string,
signing_bonus_usd double, pick_value string"""

# year, round, pick, person, name, school, class, position, hand, money, slot value
_P = [
    (2013, "9", 270, 1, "Ana Twice", "Lincoln HS", None, "P", "R", None, None),
    (2016, "2", 45, 1, "Ana Twice", "State Tech", "4YR JR", "P", "R", None, "1300000"),
    (2018, "38", 1150, 2, "Bo Zero", "Harbor CC", "JC J2", "P", "L", 0.0, "0"),
    (2017, "20", 610, 3, "Cy Fallback", "State Tech", "JR", "SS", "R", None, None),
    (2017, "1", 5, 4, "Di Both", "State Tech", "4YR JR", "2B", "R", 4200000.0, "4000000"),
    (2014, "12", 360, 5, "Robert Nick", "Coast University", None, "C", "R", None, None),
    (2014, "13", 390, 6, "Eve Wrong", "Coast University", None, "1B", "R", None, None),
    (2019, "11", 331, 7, "Flo Edge", "Small College", "4YR SR", "DH", "R", 100000.0, None),
    (2024, "1", 10, 8, "Gus Early", "State Tech", "4YR JR", "LF", "L", 3000000.0, "4000000"),
    (2025, "1", 11, 9, "Hal Late", "State Tech", "4YR JR", "3B", "R", 2999999.0, "2900000"),
    (2021, "4", 110, 10, "Ivy Class", "St. Nobody", "HS SR", "CF", "R", 500000.0, "500000"),
    (2015, "3", 101, 11, "Jo Second", "Westfield", None, "P", "L", None, None),
    (2022, "7", 200, 12, "Kim Placeholder", "No School", "HS SR", "RF", "R", 50000.0, None),
    (2012, "CB-A", 31, 13, "Lou Supp", "Unlisted Place", None, "OF", "R", None, None),
    (2020, "5", 150, 14, "Mo Academy", "Naval Academy", None, "3B", "R", 99999.0, None),
    (2019, "30", 900, 15, "Ned Unsigned", "Coast University", "4YR SR", "P", "R", None, None),
]
PICK_ROWS = [(y, r, p, "Team", pid, n, s, c, pos, h, m, v) for y, r, p, pid, n, s, c, pos, h, m, v in _P]

PEOPLE = "id long, full_name string, birth_date string, mlb_debut_date string"
PEOPLE_ROWS = [
    (1, "Ana Twice", "1994-06-09", "2018-06-09"),
    (1, "Ana Twice", "1994-06-09", None),  # a second row: the one with a debut is kept
    (2, "Bo Zero", "1998-02-28", None),
    (3, "Cy Fallback", "1996-01-01", None),
    (4, "Di Both", "1996-06-12", "2019-04-01"),
    (5, "Robert Nick", "1992-12-31", "2016-09-01"),
    (6, "Eve Wrong", "1993-01-01", None),
    (7, "Flo Edge", "1997-06-04", None),
    (8, "Gus Early", "2003-07-15", None),
    (9, "Hal Late", "2004-07-13", "2026-04-01"),
    (10, "Ivy Class", "2003-02-02", None),
    (11, "Jo Second", "1996-09-09", None),
    (12, "Kim Placeholder", "2000-01-01", None),
    (13, "Lou Supp", "1989-05-05", "2015-05-05"),
    (14, "Mo Academy", "1998-05-05", None),
    (15, "Ned Unsigned", "1996-05-05", None),
]

VALUE = "name_common string, mlb_ID double, year_ID int, WAR double"
BAT_ROWS = [("Ana Twice", 1.0, 2018, 0.4), ("Di Both", 4.0, 2019, 5.0), ("Lou Supp", 13.0, 2015, 1.0),
            ("Lou Supp", 13.0, 2027, 30.0), ("Nobody", None, 1910, 7.0), ("Robert Nick", 5.0, 2016, 0.99)]
PITCH_ROWS = [("Ana Twice", 1.0, 2018, 2.0), ("Ana Twice", 1.0, 2019, 13.0)]

SECOND = """draft_year int, overall_pick int, name string, signed boolean, bonus_usd double,
from_type string"""
SECOND_ROWS = [
    (2013, 270, "Ana Twice", False, None, "HS"),
    (2016, 45, "Ana Twice", True, 1365000.0, "4Yr"),
    (2017, 610, "Cy Fallback", True, 130000.0, "4Yr"),
    (2017, 5, "Di Both", True, 4100000.0, "4Yr"),
    (2014, 360, "Rob Nick", True, 75000.0, "4Yr"),
    (2014, 390, "Zed Other", True, 88000.0, "HS"),
    (2015, 101, "Jo Second", True, 600000.0, "HS"),
    (2012, 31, "Lou Supp", True, 1000000.0, "4Yr"),
    (2012, 586, "No Partner", True, 1.0, "4Yr"),
]

SCHOOLS = """school_name_raw string, school_canonical string, school_type string, division string,
conference_pre2024 string, conference_2024 string"""
SCHOOL_ROWS = [
    ("State Tech", "State Technical University", "4YR", "D1", "Old League", "New League"),
    ("Harbor CC", "Harbor College", "JC", "JUCO", "", ""),
    ("Coast University", "Coast University", "4YR", "D1", "Coastal", "Coastal"),
    ("Small College", "Small College", "4YR", "UNKNOWN", "", ""),
    ("Naval Academy", "Naval Academy", "4YR", "D1", "Service", "Service"),
]

STARTS = [(y, D(y, 6, 4)) for y in (2012, 2013, 2014, 2015, 2018, 2019, 2020)] + [
    (2016, D(2016, 6, 9)), (2017, D(2017, 6, 12)), (2021, D(2021, 7, 11)), (2022, D(2022, 7, 17)),
    (2023, D(2023, 7, 9)), (2024, D(2024, 7, 14)), (2025, D(2025, 7, 13)),
]


def inputs(spark):
    from cohortlens.plans.backfill import build_backfill

    picks = spark.createDataFrame(PICK_ROWS, PICKS)
    second = spark.createDataFrame(SECOND_ROWS, SECOND)
    return {
        "draft_picks": picks,
        "people": spark.createDataFrame(PEOPLE_ROWS, PEOPLE),
        "war_bat": spark.createDataFrame(BAT_ROWS, VALUE),
        "war_pitch": spark.createDataFrame(PITCH_ROWS, VALUE),
        "bbref_draft": second,
        "bonus_backfill": build_backfill(picks, second),
        "schools": spark.createDataFrame(SCHOOL_ROWS, SCHOOLS),
        "draft_dates": spark.createDataFrame(STARTS, "draft_year int, draft_start_date date"),
    }
