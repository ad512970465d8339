"""Lookups, marks, anti joins, snapshot differences and cross-source checks."""

from pyspark.sql import functions as F

from cohortlens.operators import profile, quality, spread, staging
from cohortlens.plans.catalog.registry import query, r, round_columns
from cohortlens.plans.orders import line_totals, table
from cohortlens.sources.tables import apply_overrides, concat_extracts

LINE_SUMS = """line AS (SELECT l_orderkey, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS gross
                        FROM lineitem GROUP BY 1)"""


def order_and_line_amounts(spark, sf):
    lines = line_totals(table(spark, sf, "lineitem")).select(
        F.col("order_key").alias("o_orderkey"), (F.col("gross_e2") / 100.0).alias("gross")
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")


@query(
    """SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation, r_name AS region, p_brand AS brand
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey
       LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
       LEFT JOIN part ON p_partkey = o_custkey"""
)
def lookup_joins(spark, sf):
    customer = table(spark, sf, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_nationkey AS n_nationkey", "c_mktsegment AS segment"
    )
    nation = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    brand = table(spark, sf, "part").selectExpr("p_partkey AS o_custkey", "p_brand AS brand")
    places = customer.join(nation, "n_nationkey", "left").join(
        table(spark, sf, "region"), "r_regionkey", "left"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    hot = spread.hot_keys(orders, ["o_custkey"])
    rows = spread.lookup_join(orders, places, ["o_custkey"], spread=["o_orderkey"], hot=hot)
    rows = spread.lookup_join(rows, brand, ["o_custkey"], spread=["o_orderkey"], hot=hot)
    return rows.selectExpr("o_orderkey", "segment", "n_name AS nation", "r_name AS region", "brand")


@query(
    """WITH ov AS (SELECT n_name, min(s_name) AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey
                   WHERE s_acctbal > 8000 GROUP BY 1)
       SELECT c_custkey, coalesce(label, c_mktsegment) AS shown
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN ov USING (n_name)"""
)
def override_lookup(spark, sf):
    nation = table(spark, sf, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    rich = table(spark, sf, "supplier").filter("s_acctbal > 8000").selectExpr(
        "s_nationkey AS c_nationkey", "s_name"
    )
    overrides = rich.join(nation, "c_nationkey").groupBy("n_name").agg(F.min("s_name").alias("label"))
    customers = table(spark, sf, "customer").join(nation, "c_nationkey", "left")
    shown = staging.override_lookup(
        customers, overrides, "n_name", "c_mktsegment", "label", "shown", spread=["c_custkey"]
    )
    return shown.select("c_custkey", "shown")


@query(
    """SELECT c_custkey, c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL
              UNION SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AS seen FROM customer"""
)
def mark_join(spark, sf):
    ids = staging.id_union(
        [(table(spark, sf, "events"), "user_id"), (table(spark, sf, "orders"), "o_custkey")], "c_custkey"
    )
    customers = table(spark, sf, "customer").select("c_custkey")
    return staging.with_match_flag(customers, ids, ["c_custkey"], "seen", spread=["c_custkey"])


@query(
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def orphans(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return staging.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])


@query(
    """SELECT o_orderkey, o_orderstatus FROM orders
       WHERE CAST(o_orderdate AS DATE) IN (SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem)"""
)
def shared_periods(spark, sf):
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return orders.join(days, "day", "left_semi").select("o_orderkey", "o_orderstatus")


@query(
    """WITH early AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE year(o_orderdate) <= 1997 GROUP BY 1),
            late AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE year(o_orderdate) > 1997 GROUP BY 1)
       SELECT early.o_custkey, early.p AS priority_before, late.p AS priority_after
       FROM early JOIN late USING (o_custkey) WHERE early.p IS DISTINCT FROM late.p"""
)
def diff_snapshots(spark, sf):
    orders = table(spark, sf, "orders")
    early = F.year("o_orderdate") <= 1997

    def snapshot(part):
        return part.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"))

    return staging.changed_values(
        snapshot(orders.filter(early)), snapshot(orders.filter(~early)), "o_custkey", "priority",
        ("_before", "_after"),
    )


@query(
    """SELECT COUNT(*) AS n, floor((100 * avg(CASE WHEN year(o_orderdate) = year(first_ship) THEN 1.0 ELSE 0.0 END)) * 1e6 + 0.5) / 1e6 AS pct_equal
       FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def agreement_share(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("a"))
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.year(F.min("l_shipdate")).alias("b")
    )
    return round_columns(profile.agreement_share(orders, ships, ["o_orderkey"], "a", "b"), "pct_equal")


@query(
    f"""WITH {LINE_SUMS}, pairs AS (SELECT o_totalprice AS a, gross AS b FROM orders LEFT JOIN line ON l_orderkey = o_orderkey)
        SELECT COUNT(*) AS n, {r("100 * avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)")} AS exact_pct,
               {r("100 * avg(CASE WHEN a = b OR abs(a - b) / CASE WHEN b > 0 THEN b END <= 0.2 THEN 1.0 ELSE 0.0 END)")} AS within_pct
        FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def crosscheck_sources(spark, sf):
    pairs = order_and_line_amounts(spark, sf)
    checked = staging.crosscheck(pairs, "o_totalprice", "gross", rel_tol=0.2)
    return round_columns(checked, "exact_pct within_pct")


@query(
    f"""WITH {LINE_SUMS}
        SELECT o_orderkey, {r("o_totalprice - gross", 2)} AS diff FROM orders JOIN line ON l_orderkey = o_orderkey
        WHERE o_totalprice <> gross ORDER BY abs(o_totalprice - gross) DESC, o_orderkey LIMIT 10"""
)
def largest_disagreements(spark, sf):
    pairs = order_and_line_amounts(spark, sf)
    top = staging.largest_disagreements(pairs, "o_totalprice", "gross", ["o_orderkey"])
    return round_columns(top, "diff", 2).select("o_orderkey", "diff")


@query(
    """SELECT CAST(y AS INTEGER) AS class_year FROM range(1993, 2004) t(y)
       WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)"""
)
def missing_periods(spark, sf):
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("class_year"))
    return quality.missing_periods(orders, "class_year", 1993, 2003)


@query(
    """WITH gen AS (SELECT c_nationkey, max(c_acctbal) AS best, 'generated' AS origin FROM customer GROUP BY 1),
            man AS (SELECT s_nationkey AS c_nationkey, max(s_acctbal) AS best, 'manual' AS origin FROM supplier WHERE s_acctbal > 7000 GROUP BY 1)
       SELECT * FROM gen WHERE c_nationkey NOT IN (SELECT c_nationkey FROM man) UNION ALL SELECT * FROM man"""
)
def manual_rows_win(spark, sf):
    generated = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"))
    manual = table(spark, sf, "supplier").filter("s_acctbal > 7000")
    manual = manual.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("best"))
    return apply_overrides(
        generated.withColumn("origin", F.lit("generated")), manual.withColumn("origin", F.lit("manual")),
        "c_nationkey",
    )


@query(
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS origin FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier"""
)
def concat_extracts_with_gaps(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "'supplier' AS origin")
    return concat_extracts([customers, suppliers])
