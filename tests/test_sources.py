"""Readers, writers, nested JSON and pages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import backfill, pages
from cohortlens.sources import nested, tables
from cohortlens.sources.pages import element_rows, labelled_date


def test_read_table_prefers_parquet_then_csv_then_fails(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert tables.read_table(spark, folder, "t").first()["a"] == 1
    assert tables.read_table(spark, folder, "t", "a string, b string").first()["a"] == "1"
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    assert tables.read_table(spark, folder, "t").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, folder, "missing").count()


def test_reference_csv_with_comments_and_casts(spark, tmp_path, rows):
    path = tmp_path / "moves.csv"
    path.write_text('# a note\n# more\nschool,year,day\n"A, B",2012,2012-06-04\nC,x,bad\n')
    df = tables.read_reference(
        spark, str(path), ["school", "year", "day"], {"year": "int", "day": "date"}, comment="#"
    )
    assert rows(df) == [("A, B", 2012, dt.date(2012, 6, 4)), ("C", None, None)]


def test_csv_round_trip_keeps_blanks(spark, tmp_path, rows):
    df = spark.createDataFrame([("Virginia ", ""), (" x", "y")], "a string, b string")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(rows(tables.read_text_csv(spark, str(tmp_path / "out"), ["a", "b"]))) == [(" x", "y"), ("Virginia ", "")]


def test_contracts_and_gaps(spark):
    df = spark.range(1).withColumn("bat_side_code", F.lit("L"))
    with pytest.raises(ValueError, match="mlb_ID"):
        tables.require_columns(df, ["id", "mlb_ID"], "war")
    assert tables.require_columns(df, ["id"], "war") is df
    assert tables.absent_columns(df, ["id", "birth_date"], ["bat_side", "pitch_hand"]) == ["birth_date", "pitch_hand_*"]
    assert dict(tables.with_missing_columns(df, {"id": "int", "name": "string"}).dtypes)["name"] == "string"


def test_year_range(spark, rows):
    assert rows(tables.year_range(spark, "2012-2014")) == [(2012,), (2013,), (2014,)]
    assert rows(tables.year_range(spark, "2017")) == [(2017,)]


def test_parquet_sink_orders_files_within_partitions(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("y"), (1000 - F.col("id")).alias("n"))
    path = str(tmp_path / "fact")
    for _ in range(2):  # overwrites
        tables.write_parquet(df, path, ["y"], ["n"])
    back = spark.read.parquet(path)
    assert back.count() == 1000 and (tmp_path / "fact" / "y=0").is_dir()
    plan = back.filter("y = 1").select("n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan


def test_json_report(spark, tmp_path):
    df = spark.createDataFrame([("c", "pass", ["{}"], None)], "name string, status string, examples array<string>, value double")
    tables.write_json_report(df, str(tmp_path / "report"))
    lines = [l for f in (tmp_path / "report").glob("*.json") for l in f.read_text().splitlines()]
    assert json.loads(lines[0]) == {"name": "c", "status": "pass", "examples": ["{}"], "value": None}


DRAFT = {
    "drafts": {
        "rounds": [
            {"round": "1", "picks": [
                {"pickNumber": 1, "pickRound": "1", "signingBonus": "1,500,000", "school": {"name": "A", "schoolClass": "4YR JR"},
                 "person": {"id": 10, "fullName": "Ann", "primaryPosition": {"abbreviation": "P"}}},
                {"pickNumber": 2, "pickRound": "1", "person": {"id": 11, "fullName": "Bob"}},
            ]},
            {"round": "CB-A", "picks": [{"pickNumber": 3, "pickRound": "CB-A", "person": {"id": 12, "fullName": "Cy"}}]},
            {"round": "2", "picks": []},
        ]
    }
}


def test_nested_json_to_one_row_per_pick(spark, tmp_path):
    (tmp_path / "2023.json").write_text(json.dumps(DRAFT, indent=1))
    doc = nested.read_json_documents(spark, str(tmp_path / "2023.json"))
    flat = nested.flatten_nested(doc, ["drafts.rounds", "picks"], {"draft_year": 2023})
    got = {r["pick_number"]: r for r in flat.collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["draft_year"] == 2023 and got[1]["school_school_class"] == "4YR JR"
    assert got[1]["person_primary_position_abbreviation"] == "P" and got[2]["school_name"] is None


@pytest.mark.parametrize(("name", "want"), [("school.schoolClass", "school_school_class"), ("mlbDebutDate", "mlb_debut_date")])
def test_snake_case(name, want):
    assert nested.snake_case(name) == want


HEADER = "<tr><th>Rnd</th><th>DT</th><th>OvPck</th><th>RdPck</th><th>Tm</th><th>Signed</th><th>Bonus</th><th>Name</th><th>Pos</th><th>Type</th><th>Drafted Out of</th></tr>"


def _row(n, signed, bonus, name, dt_=""):
    return (
        f"<tr><th>1</th><td>{dt_}</td><td>{n}</td><td>{n}</td><td><a href='/t'>Team</a></td><td>{signed}</td><td>{bonus}</td>"
        f"<td><a href='/p/{n}'>{name}</a> (minors)</td><td>P</td><td>4Yr</td><td>North University (Town,&nbsp;NC)</td></tr>"
    )


TABLE = (
    "<table id='draft_stats'><thead>" + HEADER + "</thead><tbody>" + _row(1, "N", "", "Ann") + _row(3, "Y", "$6,582,000", "*Carlos Rodón")
    + HEADER + _row(35, "Y", "2,000,000", "Forrest", "6sc") + "</tbody></table>"
)


def test_round_pages(spark):
    pages_df = spark.createDataFrame(
        [(1, 2014, f"<html><body><table><tr><td>other</td></tr></table>{TABLE}</body></html>"),
         (2, 2015, f"<html><!--{TABLE}--></html>"), (3, 2016, "<html>nothing</html>"), (4, 2014, TABLE)],
        "page_id long, draft_year int, html string",
    )
    got = {(r["draft_year"], r["overall_pick"]): r for r in pages.round_rows(pages_df, "https://example.org").collect()}
    assert set(got) == {(y, p) for y in (2014, 2015) for p in (1, 3, 35)}  # repeats kept once
    first, third, later = (got[(2014, n)] for n in (1, 3, 35))
    assert (first["signed"], first["bonus_usd"]) == (False, None)
    assert (third["signed"], third["bonus_usd"], third["name"]) == (True, 6582000.0, "Carlos Rodón")
    assert third["bbref_player_url"] == "https://example.org/p/3" and third["drafted_out_of"] == "North University (Town, NC)"
    assert later["round_label"] == "1 6sc" and first["round_label"] == "1"


def test_nested_tables_and_unclosed_rows(spark):
    html = "<table id=a><tr><td>x<table id=b><tr><td>in</td></tr></table></td><td>y</td><tr><td>z"
    rows = element_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert {(r["table_id"], r["row_no"], tuple(r["cells"])) for r in rows} == {
        ("b", 0, ("in",)), ("a", 0, ("x", "y")), ("a", 1, ("z",)),
    }


def test_labelled_dates(spark):
    def box(label, cell):
        return f'<tr><th class="l">{label}</th><td class="d">{cell}</td></tr><tr><th>Location</th><td>Omaha</td></tr>'

    df = spark.createDataFrame(
        [(2020, box("Date", "June 10–11, 2020")), (2012, box("Date(s)", '<a href="/x">June 4</a>&#8211;6, 2012')),
         (2013, "<tr><th>Location</th><td>Omaha</td></tr>"), (2014, box("Dates", "early June"))],
        "draft_year int, html string",
    )
    got = {r["draft_year"]: r["date"] for r in labelled_date(df).collect()}
    assert got == {2020: dt.date(2020, 6, 10), 2012: dt.date(2012, 6, 4), 2013: None, 2014: None}
    checked = {r["draft_year"]: r["date_ok"] for r in pages.event_dates(df).collect()}
    assert checked == {2020: True, 2012: True, 2013: False, 2014: False}


def test_backfill_and_crosscheck(spark):
    picks = spark.createDataFrame(
        [(2017, 1, 1, "Michael Mason", "Mason", "Mike", "Michael", 100.0), (2017, 2, 2, "John Smith", "Smith", "John", "John", 200.0),
         (2017, 3, 3, "Al Bee", "Bee", "Al", "Alan", 300.0), (2018, 1, 4, "Not Covered", "Covered", "Not", "Not", 1.0),
         (2017, 4, 5, "Dee Zero", "Zero", "Dee", "Dee", 0.0)],
        "draft_year int, pick_number int, person_id long, person_full_name string, person_last_name string, "
        "person_use_name string, person_first_name string, signing_bonus_usd double",
    )
    second = spark.createDataFrame(
        [(2017, 1, "Mike Mason", True, 100.5, "4Yr", "X"), (2017, 2, "Pedro Alvarez", True, 9.0, "HS", "Y"),
         (2017, 4, "Dee Zero", True, 50.0, "HS", "Y"), (2017, 9, "Orphan", True, 1.0, "HS", "Z")],
        "draft_year int, overall_pick int, name string, signed boolean, bonus_usd double, from_type string, drafted_out_of string",
    )
    out = backfill.build_backfill(picks, second)
    got = {r["pick_number"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert not got[1]["name_mismatch"] and got[1]["bbref_bonus_usd"] == 100.5  # the use name matches
    assert got[2]["name_mismatch"] and got[2]["bbref_bonus_usd"] is None and got[2]["bbref_signed"] is None
    assert not got[3]["bbref_matched"] and not got[3]["name_mismatch"] and got[3]["name_match_score"] is None
    summary, top = backfill.crosscheck_year(out, picks)
    r = summary.first()
    assert (r["n"], r["exact_pct"], r["within_pct"]) == (2, 0.0, 50.0)  # a base of zero is never close
    assert [t["pick_number"] for t in top.collect()] == [4, 1]


def test_spans_repeat_a_cell_in_all_its_places(spark):
    html = (
        "<table><tr><th>School</th><th colspan=2>Home</th><th>League</th></tr>"
        "<tr><td>Alpha</td><td>Port</td><td>QQ</td><td rowspan='3'><a href='/n'>North</a></td></tr>"
        "<tr><td>Beta</td><td rowspan=2>Bay</td><td>RR</td></tr>"
        "<tr><td>Gamma</td><td>SS</td></tr><tr><td colspan=x>Delta</td></tr></table>"
    )
    df = spark.createDataFrame([("p", html), ("q", None)], "page_id string, html string")
    got = [(r["cells"], r["links"][-1]) for r in element_rows(df).orderBy("row_no").collect()]
    assert got == [
        (["School", "Home", "Home", "League"], None),
        (["Alpha", "Port", "QQ", "North"], "/n"),
        (["Beta", "Bay", "RR", "North"], "/n"),
        (["Gamma", "Bay", "SS", "North"], "/n"),
        (["Delta"], None),
    ]
