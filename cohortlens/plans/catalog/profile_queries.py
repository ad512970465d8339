"""Profile tables over the raw driver tables."""

from pyspark.sql import functions as F

from cohortlens.operators import profile
from cohortlens.plans.catalog.registry import query, r, round_columns
from cohortlens.plans.orders import FACT_SQL, order_outcomes, table

OUTCOME_COLUMNS = ["n_lines", "reached", "value", "delay", "money", "high", "tier"]
FACT_COLUMNS = (
    "order_key cust_key priority status order_date class_year day_seq price is_final n_lines n_returned net_e4 "
    "gross_e2 first_ship segment nation region credited eligible reached value delay money slot_value block high "
    "tier_order money_band tier exp_reached_all exp_high_all exp_reached exp_high reached_minus_exp high_minus_exp"
).split()


def _complete(expr):
    return r(f"100 * avg(CASE WHEN {expr} IS NOT NULL THEN 1.0 ELSE 0.0 END)")


@query(
    FACT_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_complete(c)} AS pct_non_null FROM fact" for c in FACT_COLUMNS
    )
)
def completeness(spark, sf):
    out = profile.completeness(order_outcomes(spark, sf))
    return round_columns(out, "pct_non_null")


@query(
    FACT_SQL
    + " UNION ALL ".join(
        f"SELECT class_year, '{c}' AS column_name, {_complete(c)} AS pct_non_null FROM fact GROUP BY 1"
        for c in OUTCOME_COLUMNS
    )
)
def completeness_by_class(spark, sf):
    out = profile.completeness(order_outcomes(spark, sf), "class_year", OUTCOME_COLUMNS)
    return round_columns(out, "pct_non_null")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1")
def value_freq(spark, sf):
    return profile.value_freq(table(spark, sf, "part"), "p_name")


@query(
    """SELECT count(*) FILTER (WHERE n > 1) AS n_repeated,
         CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_covered, coalesce(max(n), 0) AS max_appearances
       FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)"""
)
def repeat_entities(spark, sf):
    return profile.repeat_entities(table(spark, sf, "orders"), "o_custkey")


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (
         SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, o_custkey LIMIT 5)"""
)
def repeat_examples(spark, sf):
    top = profile.repeat_examples(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"])
    return top.select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    """WITH p AS (SELECT DISTINCT p_brand, p_name FROM part)
       SELECT p_brand, p_name, n_raw FROM p JOIN (SELECT p_brand, count(*) AS n_raw FROM p GROUP BY 1 HAVING count(*) > 1)
       USING (p_brand)"""
)
def alias_groups(spark, sf):
    return profile.alias_groups(table(spark, sf, "part"), "p_brand", "p_name")


@query(
    """SELECT count(*) AS n_rows, count(DISTINCT p_brand) AS n_canonical,
         (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1)) AS n_alias_groups,
         count(*) FILTER (WHERE p_size > 40) AS n_flagged FROM part"""
)
def alias_counts(spark, sf):
    return profile.alias_counts(table(spark, sf, "part"), "p_brand", "p_name", F.col("p_size") > 40)


@query(
    """SELECT p_type, p_size // 10 AS decade, count(*) AS n_rows, count(*) FILTER (WHERE p_retailprice > 1000) AS n_dear,
         count(*) FILTER (WHERE p_name LIKE 'red%') AS n_red FROM part GROUP BY 1, 2"""
)
def reference_summary(spark, sf):
    parts = table(spark, sf, "part").withColumn("decade", F.floor(F.col("p_size") / 10).cast("int"))
    flags = {"n_dear": F.col("p_retailprice") > 1000, "n_red": F.col("p_name").startswith("red")}
    return profile.counts_by(parts, ["p_type", "decade"], flags)


@query(
    """SELECT user_id, count(*) AS n_rows, max(try_cast(k AS INTEGER)) AS max_label,
         count(*) FILTER (WHERE try_cast(k AS INTEGER) IS NULL) AS n_other
       FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN event_type ELSE json_extract_string(props, '$.k') END AS k FROM events)
       GROUP BY 1"""
)
def label_profile(spark, sf):
    number = F.get_json_object("props", "$.k")
    label = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(number)
    return profile.label_profile(table(spark, sf, "events").withColumn("k", label), "user_id", "k")


@query(
    f"""SELECT event_type, {r("100 * avg(CASE WHEN json_extract_string(props, '$.k') = '0' THEN 1.0 ELSE 0.0 END)")} AS pct_sentinel
        FROM events GROUP BY 1"""
)
def sentinel_share(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return round_columns(profile.sentinel_share(events, "event_type", "k", "0"), "pct_sentinel")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    )
)
def distinct_counts(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]
    return profile.distinct_counts(table(spark, sf, "lineitem"), columns)


@query(
    f"""WITH d AS (SELECT source, avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s
          FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
        SELECT source, {r("s")} AS share_known, s = 0 AS never_known FROM d WHERE s < 0.5"""
)
def empty_periods(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    labelled = documents.join(table(spark, sf, "labels"), "doc_id", "left")
    return round_columns(profile.empty_periods(labelled, "source", "quality"), "share_known")


@query(
    f"""SELECT {r("100 * avg(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' OR l_returnflag <> 'R' AND l_linestatus = 'F' THEN 0.0 ELSE 1.0 END)")} AS pct_mismatch
        FROM lineitem"""
)
def mismatch_share(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("a"), (F.col("l_linestatus") == "O").alias("b")
    )
    return round_columns(profile.mismatch_share(lines, "a", "b"), "pct_mismatch")


@query(
    """SELECT p_name FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)
       ORDER BY md5(p_name || '|0'), p_name LIMIT 25"""
)
def stable_sample(spark, sf):
    return profile.stable_sample(table(spark, sf, "part"), "p_name", 25)


@query(
    f"""SELECT {r("100 * avg(CASE WHEN money IS NOT NULL THEN 1.0 ELSE 0.0 END)")} AS pct_known FROM ("""
    + FACT_SQL
    + "SELECT * FROM fact WHERE credited)"
)
def known_share(spark, sf):
    credited = order_outcomes(spark, sf).filter("credited")
    known = 100 * F.avg(F.col("money").isNotNull().cast("double"))
    return round_columns(credited.agg(known.alias("pct_known")), "pct_known")
