"""Rows and fields out of web pages and nested JSON."""

from pyspark.sql import functions as F

from cohortlens.plans.catalog.registry import query
from cohortlens.plans.orders import table
from cohortlens.sources import nested, pages


@query(
    """WITH lists AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>.*?</ul>')) AS list FROM pages),
         items AS (SELECT page_id, unnest(regexp_extract_all(list, '<li><a href="[^"]*">[^<]*</a>')) AS item FROM lists)
       SELECT page_id, count(*) AS n_links FROM items GROUP BY 1"""
)
def page_link_counts(spark, sf):
    rows = pages.element_rows(table(spark, sf, "pages"), table="ul", row="li", cells=("a",))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@query(
    """WITH lists AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul>.*?</ul>') AS found FROM pages),
         numbered AS (SELECT page_id, unnest(range(len(found))) AS t, found FROM lists),
         items AS (SELECT page_id, t, regexp_extract_all(found[t + 1], '(?s)<li><a href="[^"]*">[^<]*</a>') AS item FROM numbered),
         rows AS (SELECT page_id, t, unnest(range(len(item))) AS i, item FROM items)
       SELECT page_id, CAST(t AS INTEGER) AS table_no, CAST(i AS INTEGER) AS row_no,
         regexp_extract(item[i + 1], '>([^<]*)</a>', 1) AS label, regexp_extract(item[i + 1], 'href="([^"]*)"', 1) AS link
       FROM rows"""
)
def page_rows(spark, sf):
    rows = pages.element_rows(table(spark, sf, "pages"), table="ul", row="li", cells=("a",))
    return rows.select(
        "page_id", "table_no", "row_no", F.get("cells", 0).alias("label"), F.get("links", 0).alias("link")
    )


@query(
    """SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title,
         regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"""
)
def page_field(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        pages.element_text(F.col("html"), "title").alias("title"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


@query(
    """SELECT 2024 AS source_year, event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k_value, event_type AS event_type_name
       FROM events"""
)
def flatten_json(spark, sf):
    """Each event as a nested document of rounds and picks, then flattened back."""
    event = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("user_id").alias("userId"),
        F.struct(F.get_json_object("props", "$.k").cast("long").alias("kValue")).alias("props"),
        F.struct(F.struct(F.col("event_type").alias("name")).alias("type")).alias("event"),
    )
    rounds = F.array(F.struct(F.array(event).alias("picks")))
    documents = table(spark, sf, "events").select(F.struct(rounds.alias("rounds")).alias("drafts"))
    return nested.flatten_nested(documents, ["drafts.rounds", "picks"], {"source_year": 2024})


@query(
    """SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations"""
)
def flatten_conversations(spark, sf):
    """Turns written as JSON text, read back under a declared schema and flattened."""
    turn = F.to_json(F.struct("conv_id", F.struct("turn", F.struct("role", "text").alias("said")).alias("step")))
    schema = "conv_id long, step struct<turn: long, said: struct<role: string, text: string>>"
    parsed = table(spark, sf, "conversations").select(F.from_json(turn, schema).alias("item"))
    flat = nested.flatten_structs(parsed.select("item.*"))
    return flat.select(
        "conv_id", F.col("step_turn").alias("turn"), F.col("step_said_role").alias("role"),
        F.length("step_said_text").cast("long").alias("n_chars"),
    )
