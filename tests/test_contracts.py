"""Checked reads, partial overwrites, documents without a schema, proposed pairs, evidence."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import quality as Q
from cohortlens.operators import resolve
from cohortlens.sources import nested, pages, tables

SCHEMA = "id int, price double, name string"


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_rows_that_break_the_contract_are_kept_apart(spark, tmp_path):
    lines = ["id,price,name", "1,2.5,a", "2,cheap,b", "3,1.0", "4,1.0,d,e", ",1.0,f", '6,,"g, h"', "x,1,i"]
    path = _csv(tmp_path, "\n".join(lines))
    accepted, rejected = tables.read_checked_csv(spark, path, SCHEMA, required=["id"])
    assert sorted(tuple(r) for r in accepted.collect()) == [(1, 2.5, "a"), (6, None, "g, h")]
    got = {(r["reason"], r[tables.CORRUPT]) for r in rejected.collect()}
    assert got == {
        ("unreadable", "2,cheap,b"), ("unreadable", "3,1.0"), ("unreadable", "4,1.0,d,e"), ("unreadable", "x,1,i"),
        ("required cell empty", None),
    }


def test_a_file_without_its_id_column_is_refused(spark, tmp_path):
    path = _csv(tmp_path, "price,name\n1,a\n")
    with pytest.raises(ValueError, match="id"):
        tables.read_checked_csv(spark, path, SCHEMA, required=["id"])


def test_only_the_partitions_of_the_new_rows_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select((F.col("id") % 4).alias("part"), "id")
    tables.write_parquet(rows, path, ["part"], ["id"])
    tables.replace_partitions(rows.filter("part = 2 AND id < 10"), path, ["part"], ["id"])
    counts = {r["part"]: r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()}
    assert counts == {0: 25, 1: 25, 2: 2, 3: 25}
    plan = spark.read.parquet(path).filter("part = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert [r["id"] for r in spark.read.parquet(path).filter("part = 2").collect()] == [2, 6]


def test_documents_whose_fields_differ_get_one_schema(spark):
    texts = [
        '{"a": {"list": [{"x": 1}, {"x": 2, "y": "t"}]}}',
        '{"a": {"list": []}}',
        '{"a": {"list": [{"y": "u"}]}, "b": 2.5}',
        '{"b": 3}',
        "not json",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    parsed = nested.with_parsed(df, "text", "doc")
    flat = nested.flatten_nested(parsed.select("doc.*"), ["a.list"])
    assert {(r["x"], r["y"]) for r in flat.collect()} == {(1, None), (2, "t"), (None, "u")}
    assert {r["i"] for r in parsed.filter("doc IS NULL").collect()} == {4, 5}
    assert {float(r[0]) for r in parsed.filter("doc.b IS NOT NULL").select("doc.b").collect()} == {2.5, 3.0}
    with pytest.raises(ValueError, match="neither objects nor arrays"):
        nested.with_parsed(df.filter("i > 3"), "text", "doc")


@pytest.mark.parametrize(
    ("cell", "text"),
    [
        ("June&nbsp;3&ndash;5, 2019", "June 3–5, 2019"),
        ("June&#32;3&#x2013;5,&#xA0;2019", "June 3–5, 2019"),
        ("A &amp; B &lt;c&gt; &eacute;", "A & B <c> é"),
        ("<b>bold</b> &unknown; &", "bold &unknown; &"),
    ],
)
def test_character_references_in_labelled_cells(spark, cell, text):
    page = f"<table><tr><th>When</th><td>{cell}</td></tr></table>"
    df = spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")
    assert {r["field"] for r in pages.labelled_field(df, "When").collect()} == {text, None}


def test_proposed_pairs_are_the_consistent_ones(spark):
    rng = random.Random(6)
    vocabulary = ["harbor", "granite", "salem", "state", "university", "of", "and", "north", "tech", "college", "s"]
    keys = sorted({" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(60)})
    short = ["gsu", "hs", "su", "us", "h", "", "sn", "gs", "s"]
    left = spark.createDataFrame([(k,) for k in keys + short + short], "key string")
    right = spark.createDataFrame([(k,) for k in [*keys, "", keys[0]]], "key string")
    pairs = resolve.consistent_pairs(left, right).collect()
    got = {(r["left"], r["right"]) for r in pairs}
    assert len(got) == len(pairs)
    every = left.distinct().withColumnRenamed("key", "l").join(right.distinct().withColumnRenamed("key", "r"))
    want = every.filter(T.names_consistent(F.col("l"), F.col("r"))).collect()
    assert got == {(r["l"], r["r"]) for r in want}


def test_details_name_what_was_found(spark):
    df = spark.createDataFrame(
        [(2001, 1, True), (2001, None, False), (2003, 3, True), (2003, 4, None)], "year int, v int, big boolean"
    )
    years = Q.period_result(df, "year", 2000, 2003).first()
    assert years["detail"] == "periods 2000-2003 present; missing: 2000, 2002"
    assert Q.period_result(df.filter("year = 2003"), "year", 2003, 2003).first()["detail"].endswith("missing: none")
    coverage = Q.coverage_by_period(df, "year", "v", F.lit(True))
    low = Q.coverage_result(coverage, "c", 90, "lowest").first()
    assert (low["value"], low["status"], low["detail"]) == (50.0, "warn", "lowest; below 90%: 2001")
    assert [r["year"] for r in Q.low_periods(coverage, 90).collect()] == [2001]
    check = Q.share("s", F.col("v").isNotNull(), "% known", within=[("big rows", F.col("big"))])
    assert Q.run_row_checks(df, [check]).first()["detail"] == "% known; 100.0% of big rows"
