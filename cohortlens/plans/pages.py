"""Typed rows from landed round pages and event-date pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import parse_money, whole_number, yes_no
from cohortlens.operators.spread import keep_first
from cohortlens.sources.pages import element_rows, labelled_date, table_records

ROUND_TABLE = "draft_stats"


def round_rows(pages: DataFrame, base_url: str = "") -> DataFrame:
    """One row per pick listed on round pages; a pick listed twice keeps its first row.

    ``pages``: page_id, html, draft_year. The table may be hidden in an HTML comment. Rows
    without a pick number are repeated headers.
    """
    rows = table_records(element_rows(pages, in_comments=True), table_id=ROUND_TABLE)
    rows = rows.join(pages.select("page_id", "draft_year"), "page_id")

    def cell(name: str):
        return F.col("cell")[name]

    def text(name: str):
        return F.coalesce(cell(name), F.lit(""))

    url = F.col("link")["Name"]
    typed = rows.select(
        "page_id",
        "table_no",
        "row_no",
        "draft_year",
        whole_number(text("OvPck")).alias("overall_pick"),
        F.when(text("DT") == "", text("Rnd")).otherwise(F.concat_ws(" ", text("Rnd"), text("DT"))).alias("round_label"),
        whole_number(text("RdPck")).alias("round_pick"),
        text("Tm").alias("team"),
        yes_no(cell("Signed")).alias("signed"),
        parse_money(cell("Bonus")).alias("bonus_usd"),
        F.regexp_replace(text("Name"), r"^\*|\s*\(minors\)$", "").alias("name"),
        text("Pos").alias("pos"),
        text("Type").alias("from_type"),
        text("Drafted Out of").alias("drafted_out_of"),
        F.when(url != "", F.concat(F.lit(base_url), url)).alias("bbref_player_url"),
    ).filter(F.col("overall_pick").isNotNull())
    order = [F.col("page_id"), F.col("table_no"), F.col("row_no")]
    first = keep_first(typed, ["draft_year", "overall_pick"], order)
    return first.drop("page_id", "table_no", "row_no")


def event_dates(pages: DataFrame) -> DataFrame:
    """First day named on each event page, and whether it lies in the page's own year.

    A page that cannot be read keeps a null date and fails the check; nothing is filled in.
    """
    dated = labelled_date(pages, out="draft_start_date")
    ok = F.coalesce(F.year("draft_start_date") == F.col("draft_year"), F.lit(False))
    return dated.select("draft_year", "draft_start_date", ok.alias("date_ok"))


