"""What sinks write and readers accept: each query writes to the shared folder and reads back."""

import uuid

from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import resolve
from cohortlens.plans.catalog.registry import query
from cohortlens.plans.catalog.resolve_queries import ENTITY_KEY_SQL
from cohortlens.plans.orders import table
from cohortlens.session import shared_folder
from cohortlens.sources import nested, pages, tables


def _scratch(spark, name):
    return f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}/{name}"


def _write_lines(cells, path):
    """Comma-separated lines without any quoting, each file with the header."""
    header = ",".join(cells.columns)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells.columns])
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    cells.select(F.when(first, F.concat(F.lit(f"{header}\n"), line)).otherwise(line)).write.text(path)


def _yearly(spark, sf):
    return table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("class_year"), "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"
    )


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS class_year, o_orderkey, o_custkey, o_orderpriority, o_totalprice
       FROM orders WHERE year(o_orderdate) IN (1996, 1997)"""
)
def parquet_round_trip(spark, sf):
    """An ordered, partitioned write; only two of its partitions are read."""
    path = _scratch(spark, "orders.parquet")
    tables.write_parquet(_yearly(spark, sf), path, ["class_year"], ["o_orderkey"])
    found = tables.read_table(spark, path.removesuffix("/orders.parquet"), "orders")
    return found.filter("class_year IN (1996, 1997)")


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS class_year, o_orderkey, o_custkey, o_orderpriority,
         CASE WHEN year(o_orderdate) = 1997 THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice
       FROM orders WHERE year(o_orderdate) <> 1997 OR o_orderpriority <> '1-URGENT'"""
)
def partition_replaced(spark, sf):
    """The whole table is written, then one class again with other rows: the others stay."""
    path = _scratch(spark, "orders.parquet")
    rows = _yearly(spark, sf)
    tables.write_parquet(rows, path, ["class_year"], ["o_orderkey"])
    again = rows.filter("class_year = 1997 AND o_orderpriority <> '1-URGENT'")
    tables.replace_partitions(
        again.withColumn("o_totalprice", 2 * F.col("o_totalprice")), path, ["class_year"], ["o_orderkey"]
    )
    return spark.read.parquet(path)


@query(
    """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS INTEGER) END AS s_nationkey
       FROM supplier WHERE s_suppkey % 10 <> 0"""
)
def commented_reference(spark, sf):
    """A text table with comment lines and cells that are no numbers, read as declared."""
    key = F.col("s_suppkey")
    written = table(spark, sf, "supplier").select(
        F.when(key % 10 == 0, F.concat(F.lit("# retired: "), "s_name")).otherwise(F.col("s_name")).alias("s_name"),
        key.cast("string").alias("s_suppkey"),
        F.when(key % 7 == 0, "unknown").otherwise(F.col("s_nationkey").cast("string")).alias("s_nationkey"),
    )
    path = _scratch(spark, "supplier.csv")
    _write_lines(written, path)
    return tables.read_reference(
        spark, path, ["s_name", "s_suppkey", "s_nationkey"], {"s_suppkey": "long", "s_nationkey": "int"}, comment="#"
    ).select("s_suppkey", "s_name", "s_nationkey")


@query(
    """SELECT p_partkey, '  ' || p_name || ' ' AS padded, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS brand,
         'says "' || p_type || '", twice' AS quoted FROM part"""
)
def csv_edge_blanks(spark, sf):
    """Outer blanks, empty cells, nulls, quotes and commas come back as written; null as ''."""
    written = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("padded"),
        F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 2 != 0, F.col("p_brand")).alias("brand"),
        F.concat(F.lit('says "'), "p_type", F.lit('", twice')).alias("quoted"),
    )
    path = _scratch(spark, "part.csv")
    tables.write_csv(written, path, ["p_partkey"])
    back = tables.read_text_csv(spark, path, ["p_partkey", "padded", "brand", "quoted"])
    return back.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query(
    """SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'unreadable'
              WHEN o_orderkey % 13 = 0 THEN 'required cell empty' ELSE 'accepted' END AS outcome,
         count(*) AS n_rows, CAST(min(o_orderkey) AS BIGINT) AS first_key FROM orders GROUP BY 1"""
)
def csv_contract(spark, sf):
    """Rows with an unreadable number, a cell too many or no customer are told from the others."""
    key = F.col("o_orderkey")
    number = F.when(key % 7 == 0, "many").otherwise(F.col("o_totalprice").cast("string"))
    customer = F.when(key % 13 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    status = F.when(key % 11 == 0, F.concat("o_orderstatus", F.lit(",a cell too many"))).otherwise(F.col("o_orderstatus"))
    cells = table(spark, sf, "orders").select(
        key.alias("key"), number.alias("price"), customer.alias("customer"), status.alias("status")
    )
    path = _scratch(spark, "orders.csv")
    _write_lines(cells, path)
    schema = "key long, price double, customer long, status string"
    accepted, rejected = tables.read_checked_csv(spark, path, schema, required=["key", "customer"])
    line_key = F.split_part(F.col(tables.CORRUPT), F.lit(","), F.lit(1)).cast("long")
    both = accepted.select(F.lit("accepted").alias("outcome"), "key").unionByName(
        rejected.select(F.col("reason").alias("outcome"), F.coalesce(line_key, "key").alias("key"))
    )
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("first_key"))


@query(
    """SELECT r_name AS region, n_name AS nation, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS even_key,
         count(*) OVER (PARTITION BY r_name) AS n_nations, true AS null_is_written
       FROM region JOIN nation ON n_regionkey = r_regionkey"""
)
def json_report(spark, sf):
    """A nested report as JSON lines: arrays of structs, with nulls written out."""
    even = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("even_key")
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    report = rows.groupBy(F.col("r_name").alias("region")).agg(
        F.collect_list(F.struct(F.col("n_name").alias("nation"), even)).alias("nations")
    )
    path = _scratch(spark, "report.json")
    tables.write_json_report(report, path)
    back = spark.read.json(path, "region string, nations array<struct<nation: string, even_key: int>>")
    written = spark.read.text(path).select(
        F.get_json_object("value", "$.region").alias("region"),
        F.size(F.split("value", '"even_key":null')).alias("nulls"),
    )
    listed = back.join(written, "region").withColumn("n_nations", F.size("nations").cast("long"))
    odd = F.size(F.filter("nations", lambda n: n["even_key"].isNull()))
    listed = listed.withColumn("null_is_written", F.col("nulls") == odd + 1)
    return listed.select("region", "n_nations", "null_is_written", F.inline("nations"))


@query(
    """SELECT CAST(y AS INTEGER) AS year, count(o_orderkey) AS n_orders
       FROM range(1990, 2004) t(y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY 1"""
)
def orders_by_year_range(spark, sf):
    years = tables.year_range(spark, "1990-2003")
    counted = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    return years.join(counted, "year", "left").fillna(0, ["n_orders"])


@query(
    """SELECT conv_id, CAST(turn // 3 AS BIGINT) AS round_no, turn, role AS said_role, length(text) AS said_chars,
         CASE WHEN turn % 2 = 0 THEN upper(role) END AS note FROM conversations"""
)
def flatten_variants(spark, sf):
    """Conversations as documents of rounds of turns whose fields differ, parsed without a schema.

    A round is three turns; every fifth conversation has an empty round and a field of its own.
    """
    said = F.struct("role", F.length("text").cast("long").alias("chars"))
    turns = table(spark, sf, "conversations").select(
        "conv_id",
        F.floor(F.col("turn") / 3).alias("round_no"),
        F.struct("conv_id", F.floor(F.col("turn") / 3).alias("roundNo"), "turn", said.alias("said"),
                 F.when(F.col("turn") % 2 == 0, F.upper("role")).alias("note")).alias("pick"),
    )
    rounds = turns.groupBy("conv_id", "round_no").agg(F.collect_list("pick").alias("picks"))
    documents = rounds.groupBy("conv_id").agg(F.collect_list(F.struct("picks")).alias("rounds"))
    none = F.array().cast(documents.schema["rounds"].dataType)
    odd = F.col("conv_id") % 5 == 0
    empty = F.transform(F.when(odd, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
                        lambda _: F.struct(F.array().cast(documents.schema["rounds"].dataType.elementType["picks"].dataType).alias("picks")))
    document = F.struct(
        F.struct(F.concat(F.coalesce("rounds", none), empty).alias("rounds")).alias("drafts"),
        F.when(odd, F.struct(F.lit("x").alias("own"))).alias("extra"),
    )
    text = documents.select(F.to_json(document).alias("json"))  # null fields are left out
    parsed = nested.with_parsed(text, "json", "document").select("document.*")
    flat = nested.flatten_nested(parsed, ["drafts.rounds", "picks"])
    return flat.select("conv_id", "round_no", "turn", "said_role", "said_chars", "note")


SPELLED = ("University of {}", "{} College", "The {} Univ.", "College of {}", "{} St", "{}")
NAMES_SQL = f"""names AS (
  SELECT DISTINCT {ENTITY_KEY_SQL} AS key FROM (SELECT unnest([
    {", ".join("'" + x.replace("{}", "' || p_name || '") + "'" for x in SPELLED)}]) AS name FROM part)
)"""


def _spelled_keys(spark, sf):
    shapes = [F.concat(F.lit(a), F.col("p_name"), F.lit(b)) for a, b in (x.split("{}") for x in SPELLED)]
    names = table(spark, sf, "part").select("p_name").distinct().select(F.explode(F.array(*shapes)).alias("name"))
    return names.select(T.entity_key(F.col("name")).alias("key")).distinct()


@query(
    f"""WITH {NAMES_SQL}, forms AS (
          SELECT key, unnest([key, regexp_replace(key, '^university of ', ''), regexp_replace(key, '^college of ', ''),
            regexp_replace(key, ' university$', ''), regexp_replace(key, ' college$', '')]) AS form FROM names)
        SELECT DISTINCT key, trim(form) AS variant FROM forms WHERE trim(form) <> ''"""
)
def name_variants(spark, sf):
    return _spelled_keys(spark, sf).select("key", F.explode(T.key_variants(F.col("key"))).alias("variant"))


ACRONYM_SQL = """array_to_string(list_transform(list_filter(string_split(key, ' '), lambda w: w NOT IN ('of', 'and', '')),
  lambda w: w[1]), '')"""


@query(
    f"""WITH {NAMES_SQL}, initials AS (SELECT key, {ACRONYM_SQL} AS letters FROM names),
        short AS (SELECT letters AS key FROM initials UNION SELECT regexp_replace(letters, '^([^s]*)s', '\\1') FROM initials),
        lefts AS (SELECT key FROM names UNION SELECT key FROM short WHERE key <> '')
        SELECT l.key AS left, r.key AS right FROM lefts l JOIN initials r ON
          len(list_intersect(list_filter(string_split(l.key, ' '), lambda w: w <> '' AND w NOT IN
            ({", ".join(f"'{w}'" for w in T.GENERIC_WORDS)})), string_split(r.key, ' '))) > 0
          OR (length(l.key) >= 2 AND l.key NOT LIKE '% %'
              AND l.key IN (r.letters, regexp_replace(r.letters, '^([^s]*)s', '\\1')))"""
)
def names_consistent(spark, sf):
    """Pairs that an index of words and acronyms proposes, held against the test of two names."""
    names = _spelled_keys(spark, sf)
    short = names.select(F.explode(T.acronyms(F.col("key"))).alias("key")).filter("key <> ''")
    pairs = resolve.consistent_pairs(names.union(short), names)
    return pairs.filter(T.names_consistent(F.col("left"), F.col("right")))


PLACES = (
    "{} Academy", "{} Military Academy", "Coast Guard Academy {}", "{} School", "{} School of Art", "{} Prep", "{} CC",
    "{} Junior College", "{} Univ", "{} Institute of Technology", "{} HS", "Colegio {}", "{}",
)
SERVICE = "regexp_replace(name, '(Military|Naval|Air Force|Coast Guard) Academy', '', 'g')"


@query(
    f"""WITH named AS (SELECT DISTINCT unnest([
          {", ".join("'" + x.replace("{}", "' || p_name || '") + "'" for x in PLACES)}]) AS name FROM part)
        SELECT name, CASE WHEN regexp_matches(name, '\\bHS\\b|High School|\\bPrep\\b|Secondary|\\bSS\\b|Colegio')
            OR contains({SERVICE}, 'Academy') OR regexp_matches(replace(name, 'School of', ''), '\\bSchool\\b') THEN 'HS'
          WHEN regexp_matches(name, '\\bCC\\b|\\bJC\\b|Community College|Junior College|Comm Col') THEN 'JC'
          WHEN regexp_matches(name, 'University|\\bUniv\\b|\\bU\\b|Institute of Technology') THEN '4YR' END AS level
        FROM named"""
)
def school_name_rules(spark, sf):
    """The name rules with their look-arounds."""
    shapes = [F.concat(F.lit(a), F.col("p_name"), F.lit(b)) for a, b in (x.split("{}") for x in PLACES)]
    names = table(spark, sf, "part").select(F.explode(F.array(*shapes)).alias("name")).distinct()
    return names.select("name", T.first_match(F.col("name"), T.NAME_RULES).alias("level"))


@query(
    """SELECT p_partkey, p_name || ' ' || p_brand AS cell, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS other FROM part"""
)
def cleaned_cells(spark, sf):
    """Footnotes, non-breaking blanks and nulls in table cells."""
    cell = F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand", F.lit("[note "), "p_size", F.lit("] "))
    other = F.when(F.col("p_size") % 3 != 0, F.concat("p_type", F.lit("[a][2]")))
    return table(spark, sf, "part").select(
        "p_partkey", T.clean_cell(cell).alias("cell"), T.clean_cell(other).alias("other")
    )


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day FROM orders
       WHERE o_orderdate >= '1990-01-01' AND o_orderkey % 50 = 0"""
)
def labelled_dates(spark, sf):
    """A labelled cell per order, its blanks, dash and letters written as character references."""
    date = F.col("o_orderdate")
    month = F.concat(F.lit("&#"), F.ascii(F.date_format(date, "MMMM")), F.lit(";"), F.substring(F.date_format(date, "MMMM"), 2, 20))
    shown = F.concat(month, F.lit("&#xA0;"), F.dayofmonth(date), F.lit("&ndash;"), F.dayofmonth(date),
                     F.lit("&comma;&nbsp;"), F.year(date))
    html = F.concat(F.lit("<table><tr><th>Date(s)</th><td><b>"), shown, F.lit("</b> &amp; on</td></tr></table>"))
    shows = table(spark, sf, "orders").filter("o_orderdate >= '1990-01-01' AND o_orderkey % 50 = 0")
    dated = pages.labelled_date(shows.select("o_orderkey", html.alias("html")), out="first_day")
    return dated.select("o_orderkey", "first_day")
