"""Names, keys, votes, classification and verified joins."""

from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import resolve, spread
from cohortlens.plans.catalog.registry import query, round_columns
from cohortlens.plans.orders import table
from cohortlens.sources.pages import element_text


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
         m AS (SELECT user_id, max(n) AS top FROM c GROUP BY 1)
       SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS vote
       FROM c JOIN m USING (user_id) WHERE n = top GROUP BY 1"""
)
def majority_vote(spark, sf):
    return spread.majority(table(spark, sf, "events"), ["user_id"], F.col("event_type"))


@query(
    """WITH v AS (SELECT p_brand, p_type, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_vote,
                         split_part(p_name, ' ', 2) AS noun FROM part),
         t AS (SELECT p_brand, p_type AS v, count(*) AS n FROM v GROUP BY 1, 2),
         s AS (SELECT p_brand, size_vote AS v, count(*) AS n FROM v GROUP BY 1, 2),
         w AS (SELECT p_brand, noun AS v, count(*) AS n FROM v GROUP BY 1, 2),
         vt AS (SELECT p_brand, CASE WHEN count(*) = 1 THEN min(v) END AS v FROM t WHERE n = (SELECT max(n) FROM t x WHERE x.p_brand = t.p_brand) GROUP BY 1),
         vs AS (SELECT p_brand, CASE WHEN count(*) = 1 THEN min(v) END AS v FROM s WHERE n = (SELECT max(n) FROM s x WHERE x.p_brand = s.p_brand) GROUP BY 1),
         vw AS (SELECT p_brand, CASE WHEN count(*) = 1 THEN min(v) END AS v FROM w WHERE n = (SELECT max(n) FROM w x WHERE x.p_brand = w.p_brand) GROUP BY 1)
       SELECT p_brand,
         CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'JC' WHEN vt.v IS NOT NULL THEN vt.v WHEN vs.v IS NOT NULL THEN vs.v
              WHEN vw.v IS NOT NULL THEN vw.v WHEN p_brand LIKE '%#2%' THEN '4YR' ELSE 'UNKNOWN' END AS level,
         CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'name_regex' WHEN vt.v IS NOT NULL THEN 'type' WHEN vs.v IS NOT NULL THEN 'size'
              WHEN vw.v IS NOT NULL THEN 'noun' WHEN p_brand LIKE '%#2%' THEN 'name_regex' ELSE 'unknown' END AS rule
       FROM vt JOIN vs USING (p_brand) JOIN vw USING (p_brand)"""
)
def evidence_classify(spark, sf):
    parts = table(spark, sf, "part")
    votes = resolve.evidence_votes(
        parts,
        ["p_brand"],
        {
            "type_vote": F.col("p_type"),
            "size_vote": F.when(F.col("p_size") > 25, "big").otherwise("small"),
            "noun_vote": F.split_part("p_name", F.lit(" "), F.lit(2)),
        },
    )
    explicit = T.first_match(F.col("p_brand"), [("#[12]$", "JC"), ("#2", "4YR")])
    order = [("type_vote", "type"), ("size_vote", "size"), ("noun_vote", "noun")]
    return resolve.classify(votes, explicit, ("HS", "JC"), order).select("p_brand", "level", "rule")


@query(
    """WITH probe AS (SELECT c_custkey AS entity, CAST(c_nationkey AS VARCHAR) AS state,
           CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS k1, c_mktsegment AS k2 FROM customer),
       keys AS (SELECT entity, state, 'raw' AS via, 0 AS via_rank, unnest([k1, 'x' || k1]) AS key FROM probe
                UNION ALL SELECT entity, state, 'other', 1, k2 FROM probe),
       cand AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS state,
                  unnest([CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), CASE WHEN s_acctbal > 9500 THEN 'BUILDING' ELSE 'none' END]) AS key FROM supplier),
       hits AS (SELECT entity, via, via_rank, key, count(DISTINCT id) AS n, min(id) AS id FROM keys JOIN cand USING (key)
                WHERE keys.state IS NULL OR cand.state IS NULL OR keys.state = cand.state GROUP BY ALL),
       best AS (SELECT entity, min(row(via_rank, -length(key), key, id, via)) FILTER (WHERE n = 1) AS c, max(n) AS most
                FROM hits GROUP BY 1)
       SELECT keys.entity, c[4] AS match_id, c[5] AS via, c IS NULL AND coalesce(most, 0) > 1 AS ambiguous
       FROM (SELECT DISTINCT entity FROM keys) keys LEFT JOIN best USING (entity)"""
)
def key_match(spark, sf):
    amount = F.floor("c_acctbal").cast("string")
    tries = F.array(
        F.struct(F.lit("raw").alias("via"), F.lit(0).alias("via_rank"), amount.alias("key")),
        F.struct(F.lit("raw").alias("via"), F.lit(0).alias("via_rank"), F.concat(F.lit("x"), amount).alias("key")),
        F.struct(F.lit("other").alias("via"), F.lit(1).alias("via_rank"), F.col("c_mktsegment").alias("key")),
    )
    probes = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("string").alias("state"),
        F.explode(tries).alias("t"),
    ).select("entity", "state", "t.*")
    listed = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey").cast("string"))
    keys = F.array(
        F.floor("s_acctbal").cast("string"),
        F.when(F.col("s_acctbal") > 9500, "BUILDING").otherwise("none"),
    )
    candidates = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), listed.alias("state"), F.explode(keys).alias("key")
    )
    return resolve.match_by_keys(probes, candidates)


def title_pairs(spark, sf):
    pages = table(spark, sf, "pages")
    titles = pages.select("page_id", element_text(F.col("html"), "title").alias("title"))
    headings = pages.select(
        "page_id", element_text(F.col("html"), "h1").alias("heading"), F.col("url").alias("heading_url")
    )
    return titles, headings.filter(F.col("heading").isNotNull())


@query()
def verified_join(spark, sf):
    titles, headings = title_pairs(spark, sf)
    swapped = F.substring_index(F.col("title"), "|", 1)
    joined = resolve.verified_join(
        titles, headings, ["page_id"], [F.col("title"), swapped], "heading", withhold=["heading_url"]
    )
    return round_columns(joined, "name_match_score", 4)


NAME_KEY_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})),
  '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g'), '\\s+', ' ', 'g'))"""
TEXT_SQL = """nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<{0}(?:\\s[^>]*)?>(.*?)</{0}>', 1),
  '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')"""


@query(
    f"""WITH p AS (SELECT page_id, {TEXT_SQL.format("title")} AS title, {TEXT_SQL.format("h1")} AS heading FROM pages),
         k AS (SELECT page_id, heading IS NOT NULL AS matched, {NAME_KEY_SQL.format("coalesce(title, '')")} AS a,
                      {NAME_KEY_SQL.format("coalesce(heading, '')")} AS b FROM p)
       SELECT page_id, matched, a <> '' AND b <> '' AND string_split(a, ' ')[-1] = string_split(b, ' ')[-1]
              AND substr(a, 1, 1) = substr(b, 1, 1) AS same_last_name_initial,
              array_to_string(list_sort(string_split(a, ' ')), ' ') = array_to_string(list_sort(string_split(b, ' ')), ' ')
                AND a <> '' AS identical FROM k"""
)
def verified_join_flags(spark, sf):
    titles, headings = title_pairs(spark, sf)
    joined = resolve.verified_join(titles, headings, ["page_id"], [F.col("title")], "heading")
    same = F.coalesce(F.col("name_match_score") == 100, F.lit(False))
    return joined.select("page_id", "matched", "same_last_name_initial", same.alias("identical"))


@query(
    """SELECT doc_id,
         CASE WHEN regexp_matches(text, '[A-Za-z0-9._]@[A-Za-z0-9]') THEN 'contact'
              WHEN regexp_matches(text, '(?i)license|copyright') THEN 'notice'
              WHEN regexp_matches(text, '\\bthe\\b') THEN 'english' END AS label FROM documents"""
)
def rule_classify(spark, sf):
    rules = [
        ("[A-Za-z0-9._]@[A-Za-z0-9]", "contact"),
        ("(?i)license|copyright", "notice"),
        (r"\bthe\b", "english"),
    ]
    return table(spark, sf, "documents").select("doc_id", T.first_match(F.col("text"), rules).alias("label"))


def _replaced(sql, *pairs):
    """``sql`` under regular replacements, the first one innermost."""
    for pattern, text in pairs:
        sql = f"regexp_replace({sql}, '{pattern}', '{text}', 'g')"
    return sql


ENTITY_KEY_SQL = "trim(" + _replaced(
    "replace(" + _replaced("lower(strip_accents(name))", (r"\[[^\]]*\]", " ")) + ", '&', ' and ')",
    ("[.''’ʻ]", ""),
    ("[^a-z0-9]+", " "),
    (r"\bstate university of new york\b|\bsuny\b", " "),
    (r"\bunc\b", "north carolina"),
    (r"\b(at|the)\b", " "),
    (r"\s+", " "),
    (r"\b(mount|mt) st\b", r"\1 saint"),
    ("^ ?st\\b", "saint"),
    (r"\bst\b", "state"),
    (r"\b(u|univ)\b", "university"),
    (r"\bcol\b", "college"),
    (r"\bmt\b", "mount"),
    (r"\s+", " "),
) + ")"


@query(
    f"""WITH names AS (
          SELECT 'page' AS kind, page_id AS id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS name FROM pages
          UNION ALL
          SELECT 'part', p_partkey, unnest(['Univ. of ' || p_name, 'St. ' || p_name || ' Col.', p_name || ' St',
            'SUNY at ' || p_name, 'UNC ' || p_name || ' & the U', 'Mt. St. ' || p_name, 'Mt ' || p_name || ' [1]',
            'State University of New York, ' || p_name]) FROM part)
        SELECT kind, id, name, {ENTITY_KEY_SQL} AS key FROM names"""
)
def entity_keys(spark, sf):
    titles = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("name"),
    )
    shapes = (
        "Univ. of {}", "St. {} Col.", "{} St", "SUNY at {}", "UNC {} & the U", "Mt. St. {}", "Mt {} [1]",
        "State University of New York, {}",
    )
    spelled = [
        F.concat(F.lit(before), F.col("p_name"), F.lit(after)) for before, after in (x.split("{}") for x in shapes)
    ]
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.explode(F.array(*spelled)).alias("name")
    )
    return titles.unionByName(parts).withColumn("key", T.entity_key(F.col("name")))


@query(
    """WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[.''’]', '', 'g'),
                '[^a-z0-9]+', ' ', 'g'), '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g'), '\\s+', ' ', 'g')) AS key FROM documents)
       SELECT doc_id, key, array_to_string(list_sort(string_split(key, ' ')), ' ') AS sorted_key FROM k"""
)
def person_keys(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", T.person_key(F.col("text")).alias("key"))
    return keyed.withColumn("sorted_key", T.sorted_tokens(F.col("key")))


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_name || repeat('z', CAST(p_partkey % 12 AS INTEGER)) AS other FROM part),
         t AS (SELECT p_partkey, p_name, other, p_partkey % 7 <> 0 AS matched,
                 CAST(length(p_name) AS DOUBLE) AS a, CAST(length(other) AS DOUBLE) AS b FROM p),
         s AS (SELECT *, CASE WHEN matched THEN 200 * a / (a + b) END AS score FROM t)
       SELECT p_partkey, matched, CASE WHEN matched THEN floor(score * 1e4 + 0.5) / 1e4 END AS name_match_score,
         coalesce(matched AND score < 85, false) AS name_mismatch,
         CASE WHEN matched AND score >= 85 THEN p_partkey END AS ref_id,
         coalesce(matched AND p_name = other AND p_partkey % 5 <> 0, false) AS same_last_name_initial FROM s"""
)
def verified_join_names(spark, sf):
    """Names that agree, drift apart and are missing: letters are added at the end of one side, so
    the common part is the shorter name; every fifth row has its words swapped, which must not count."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    words = F.split("p_name", " ")
    added = F.expr("repeat('z', CAST(p_partkey % 12 AS INT))")
    front, last = F.slice(words, 1, F.size(words) - 1), F.concat(F.element_at(words, -1), added)
    other = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", last, front)).otherwise(
        F.concat_ws(" ", front, last)
    )
    refs = parts.where("p_partkey % 7 <> 0").select(
        "p_partkey", other.alias("ref_name"), F.col("p_partkey").alias("ref_id")
    )
    joined = resolve.verified_join(
        parts, refs, ["p_partkey"], [F.col("p_name")], "ref_name", withhold=["ref_id"]
    )
    return round_columns(
        joined.select(
            "p_partkey", "matched", "name_match_score", "name_mismatch", "ref_id", "same_last_name_initial"
        ),
        "name_match_score",
        4,
    )


@query(
    """SELECT c_custkey, c_name || ' (Town, ' || upper(substr(c_mktsegment, 1, 2)) || ')' AS placed, c_name AS stripped,
         upper(substr(c_mktsegment, 1, 2)) AS state, c_name || ' (' || upper(substr(c_mktsegment, 1, 2)) || ')' AS tagged,
         lower(replace(c_name, '#', ' ')) || '|' || upper(substr(c_mktsegment, 1, 2)) AS pool FROM customer"""
)
def location_tags(spark, sf):
    code = F.upper(F.substring("c_mktsegment", 1, 2))
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat("c_name", F.lit(" (Town, "), code, F.lit(")")).alias("placed"),
        F.concat("c_name", F.lit(" ("), code, F.lit(")")).alias("tagged"),
    )
    return rows.select(
        "c_custkey", "placed", T.strip_location(F.col("placed")).alias("stripped"),
        T.location_state(F.col("placed")).alias("state"), "tagged", T.pool_key(F.col("tagged")).alias("pool"),
    )
