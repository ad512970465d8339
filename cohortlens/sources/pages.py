"""Table rows, repeated elements and labelled fields from landed web pages.

Input is one row per page: ``page_id`` and ``html``. Pages are parsed where they lie, one at a
time, so a job scales with the number of pages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dates import first_date_of_range
from cohortlens.functions.text import clean_cell, squeeze, unescaped

ROW_FIELDS = (
    "table_no int, table_id string, row_no int, is_header boolean, "
    "header array<string>, cells array<string>, links array<string>"
)


#: Cells that one cell may span at most, as browsers read it.
MAX_SPAN = 1000
PAGES_AT_ONCE = 100


def _span(value: str | None) -> int:
    number = (value or "").strip()
    return min(max(int(number), 1), MAX_SPAN) if number.isdecimal() else 1


class _RowReader(HTMLParser):
    """Collects cells of repeated row elements; nested tables start a table of their own.

    A cell that spans columns or rows is repeated in each of its places.
    """

    def __init__(self, table: str, row: str, cells: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.table, self.row, self.cell_tags = table, row, cells
        self.tables = 0
        self.open: list[dict] = []
        self.rows: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == self.table:
            self.open.append({"no": self.tables, "id": attrs.get("id"), "rows": 0, "first": None, "row": None, "cell": None, "below": {}})
            self.tables += 1
        elif not self.open:
            return
        here = self.open[-1] if self.open else None
        if here is None:
            return
        if tag == self.row:
            self._end_row(here)
            here["row"] = {"cells": [], "head": True}
        if tag in self.cell_tags and here["row"] is not None:
            self._end_cell(here)
            here["cell"] = {
                "text": [], "link": None, "wide": _span(attrs.get("colspan")), "high": _span(attrs.get("rowspan")),
            }
            here["row"]["head"] &= tag == "th"
        if tag == "a" and here["cell"] is not None and here["cell"]["link"] is None:
            here["cell"]["link"] = attrs.get("href")

    def handle_endtag(self, tag):
        if not self.open:
            return
        here = self.open[-1]
        if tag in self.cell_tags:
            self._end_cell(here)
        if tag == self.row:
            self._end_row(here)
        elif tag == self.table:
            self._end_row(here)
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"]["text"].append(data)

    def _end_cell(self, here):
        if here["cell"] is not None:
            here["row"]["cells"].append(here["cell"])
            here["cell"] = None

    def _placed(self, here, cells):
        """(text, link) by column: cells reaching down from earlier rows keep their columns."""
        above, below, out = here["below"], {}, []
        todo = iter(cells)
        cell = next(todo, None)
        while cell is not None or any(column >= len(out) for column in above):
            at = len(out)
            if at in above:
                left, content = above[at]
                out.append(content)
                if left > 1:
                    below[at] = (left - 1, content)
            elif cell is None:
                out.append(("", None))
            else:
                content = ("".join(cell["text"]), cell["link"])
                out.append(content)
                if cell["high"] > 1:
                    below[at] = (cell["high"] - 1, content)
                cell["wide"] -= 1
                if not cell["wide"]:
                    cell = next(todo, None)
        here["below"] = below
        return [text for text, _ in out], [link for _, link in out]

    def _end_row(self, here):
        self._end_cell(here)
        row = here["row"]
        if row is not None and row["cells"]:
            cells, links = self._placed(here, row["cells"])
            here["first"] = here["first"] or cells
            self.rows.append((here["no"], here["id"], here["rows"], row["head"], here["first"], cells, links))
            here["rows"] += 1
        here["row"] = None

    def close(self):
        super().close()
        while self.open:
            self._end_row(self.open.pop())


def element_rows(
    pages: DataFrame,
    *,
    table: str = "table",
    row: str = "tr",
    cells: Sequence[str] = ("td", "th"),
    in_comments: bool = False,
) -> DataFrame:
    """Rows of every table-like element, each with its cells, links and its table's first row.

    ``in_comments`` opens HTML comments first, for pages that hide tables there. Lists work
    too: ``table="ul", row="li", cells=("a",)``.
    """
    names = tuple(cells)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "table_no", "table_id", "row_no", "is_header", "header", "cells", "links"]
        for batch in batches:
            for start in range(0, len(batch), PAGES_AT_ONCE):
                part = batch.iloc[start : start + PAGES_AT_ONCE]
                found = []
                for page_id, html in zip(part["page_id"], part["html"], strict=True):
                    reader = _RowReader(table, row, names)
                    reader.feed(html or "")
                    reader.close()
                    found += [(page_id, *r) for r in reader.rows]
                yield pd.DataFrame(found, columns=columns)

    html = F.col("html")
    if in_comments:
        html = F.regexp_replace(html, "<!--|-->", "")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", html.alias("html")).mapInPandas(read, f"page_id {kind}, {ROW_FIELDS}")


def table_records(
    rows: DataFrame,
    *,
    table_id: str | None = None,
    required: Sequence[str] = (),
    required_prefix: Sequence[str] = (),
    forbidden: Sequence[str] = (),
) -> DataFrame:
    """Body rows as header -> cell and header -> link maps.

    The first row of a table is its header. Tables are picked by id, or by the headers (or
    beginnings of headers) they must and must not have. Rows that repeat the header are dropped.
    """
    if table_id is not None:
        rows = rows.filter(F.col("table_id") == table_id)
    rows = rows.filter(F.col("row_no") > 0).withColumns(
        {"header": F.transform("header", clean_cell), "cells": F.transform("cells", clean_cell)}
    )
    for name in required:
        rows = rows.filter(F.array_contains("header", name))
    for name in required_prefix:
        rows = rows.filter(F.exists("header", lambda h: h.startswith(name)))
    for name in forbidden:
        rows = rows.filter(~F.array_contains("header", name))
    rows = rows.filter(F.col("cells") != F.col("header"))
    return rows.select(
        "page_id",
        "table_no",
        "row_no",
        _by_name(F.col("header"), F.col("cells")).alias("cell"),
        _by_name(F.col("header"), F.col("links")).alias("link"),
    )


def _by_name(header: Column, values: Column) -> Column:
    """Header -> value; of repeated headers the first counts, and missing cells are left out."""
    named = F.filter(
        F.sequence(F.lit(0), F.size(header) - 1),
        lambda i: (i < F.size(values)) & (F.get(header, i) != "")
        & (F.array_position(header, F.get(header, i)) == i + 1),
    )
    return F.map_from_arrays(
        F.transform(named, lambda i: F.get(header, i)), F.transform(named, lambda i: F.get(values, i))
    )


def labelled_field(pages: DataFrame, label_pattern: str, out: str = "field") -> DataFrame:
    """Text of the cell after a row label, tags removed; null when the page has no such row."""
    pattern = rf"(?s)<th[^>]*>\s*{label_pattern}\s*</th>\s*<td[^>]*>(.*?)</td>"
    raw = F.regexp_extract("html", pattern, 1)
    text = F.regexp_replace(raw, r"<[^>]+>", " ")
    text = F.translate(unescaped(text), "\u00a0", " ")
    return pages.withColumn(out, F.when(raw != "", squeeze(text)))


def labelled_date(pages: DataFrame, label_pattern: str = r"Dates?(?:\(s\))?", out: str = "date"):
    """First day of the date range in a labelled cell; unreadable pages stay null for a check."""
    df = labelled_field(pages, label_pattern, "_field")
    return df.withColumn(out, first_date_of_range(F.col("_field"))).drop("_field")


def element_text(html: Column, tag: str) -> Column:
    """Text of the first ``tag`` element; null when there is none."""
    raw = F.regexp_extract(html, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.when(raw != "", squeeze(F.regexp_replace(raw, r"<[^>]+>", " ")))
