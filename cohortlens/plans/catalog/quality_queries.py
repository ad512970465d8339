"""Data-quality checks over the order outcomes and the raw tables."""

from pyspark.sql import functions as F

from cohortlens.functions.dates import step_by_period
from cohortlens.operators import quality as Q
from cohortlens.operators import spread
from cohortlens.operators.expect import curve_rises
from cohortlens.operators.profile import value_freq
from cohortlens.plans.catalog.registry import query, r, round_columns
from cohortlens.plans.orders import FACT_SQL, TIERS, order_outcomes, table


def _row_checks():
    c = F.col
    in_window = c("class_year").between(1995, 1999)
    tier_wrong = (in_window & ~c("tier").isin(*TIERS)) | (~in_window & c("tier").isNotNull())
    outside = c("exp_reached").isNull() | (c("exp_reached") < 0) | (c("exp_reached") > 1)
    return [
        Q.join_coverage("line_join", "n_lines", "% of orders with lines", ("order_key",)),
        Q.join_coverage("value_join", "value", "% of reached rows with a value", ("order_key",),
                        among=c("is_final") & F.coalesce(c("reached"), F.lit(False)), warn_below=None),
        Q.outside_range("value_range", "value", 0.0, 4.0, "values out of range", ("order_key",)),
        Q.outside_range("price_range", "price", 0, 499_000, "prices out of range", ("order_key",)),
        Q.rule("ship_after_order", "validity", F.to_date("first_ship") <= c("order_date"), "warn",
               "shipped on or before the order date", ("order_key",)),
        Q.share("credited_with_money", c("money").isNotNull(), "% of credited rows with money",
                among=c("credited")),
        Q.share("unknown_money_share", c("money_band") == "Unknown", "% without money", warn_above=5.0),
        Q.implication("no_credited_non_final", c("credited"), c("is_final"), "credited but not final",
                      ("order_key",)),
        Q.implication("reached_credited", c("reached"), c("credited"), "reached but not credited",
                      ("order_key",)),
        Q.rule("expectation_complete", "model", outside, "fail", "expected value missing or outside [0, 1]",
               ("order_key",)),
        Q.rule("tiers_complete", "business_logic", tier_wrong, "fail", "tier missing or out of window",
               ("order_key", "tier")),
    ]


def _sql(name, category, status, value, threshold):
    return (
        f"SELECT '{name}' AS name, '{category}' AS category, {status} AS status, "
        f"CAST({value} AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold"
    )


def _any(name, category, bad, level):
    n = f"(SELECT count(*) FROM fact WHERE {bad})"
    return _sql(name, category, f"CASE WHEN {n} > 0 THEN '{level}' ELSE 'pass' END", n, "0")


def _pct(name, category, flag, among, status, threshold):
    v = f"(SELECT coalesce(round(100 * avg(CASE WHEN {flag} THEN 1.0 ELSE 0.0 END), 2), 100.0) FROM fact WHERE {among})"
    return _sql(name, category, status.format(v=v), v, threshold)


ROW_CHECKS_SQL = " UNION ALL ".join(
    [
        _pct("line_join", "joins", "n_lines IS NOT NULL", "true",
             "CASE WHEN {v} < 99 THEN 'fail' WHEN {v} < 100 THEN 'warn' ELSE 'pass' END", "99"),
        _pct("value_join", "joins", "value IS NOT NULL", "is_final AND coalesce(reached, false)",
             "CASE WHEN {v} < 99 THEN 'fail' ELSE 'pass' END", "99"),
        _any("value_range", "validity", "value IS NOT NULL AND value NOT BETWEEN 0 AND 4", "warn"),
        _any("price_range", "validity", "price IS NOT NULL AND price NOT BETWEEN 0 AND 499000", "warn"),
        _any("ship_after_order", "validity", "CAST(first_ship AS DATE) <= order_date", "warn"),
        _pct("credited_with_money", "coverage", "money IS NOT NULL", "credited", "'pass'", "NULL"),
        _pct("unknown_money_share", "coverage", "money_band = 'Unknown'", "true",
             "CASE WHEN {v} > 5 THEN 'warn' ELSE 'pass' END", "5"),
        _any("no_credited_non_final", "business_logic", "credited AND NOT is_final", "fail"),
        _any("reached_credited", "business_logic", "coalesce(reached, false) AND NOT credited", "fail"),
        _any("expectation_complete", "model", "exp_reached IS NULL OR exp_reached < 0 OR exp_reached > 1", "fail"),
        _any("tiers_complete", "business_logic",
             "(class_year BETWEEN 1995 AND 1999 AND tier IS NULL) OR (class_year NOT BETWEEN 1995 AND 1999 AND tier IS NOT NULL)",
             "fail"),
    ]
)
PLAIN = ["name", "category", "status", "value", "threshold"]


@query(FACT_SQL + ROW_CHECKS_SQL)
def dq_row_checks(spark, sf):
    return Q.run_row_checks(order_outcomes(spark, sf), _row_checks()).select(*PLAIN)


@query(
    FACT_SQL
    + f""", checks AS ({ROW_CHECKS_SQL})
      SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn,
             count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'fail') = 0 AS gate_open
      FROM checks"""
)
def dq_gate(spark, sf):
    return Q.tally(Q.run_row_checks(order_outcomes(spark, sf), _row_checks()))


def _group_sql(name, category, bad, level, threshold="0", value=None):
    n = f"(SELECT count(*) FROM ({bad}))"
    return _sql(name, category, f"CASE WHEN {n} > 0 THEN '{level}' ELSE 'pass' END", value or n, threshold)


YEAR_COVERAGE = """SELECT round(100 * avg(CASE WHEN money IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS p
  FROM fact WHERE day_seq BETWEEN 1 AND 100 GROUP BY class_year"""
GROUP_CHECKS_SQL = " UNION ALL ".join(
    [
        _sql("row_count", "completeness",
             "CASE WHEN (SELECT count(*) FROM fact) = (SELECT count(*) FROM orders) THEN 'pass' ELSE 'fail' END",
             "(SELECT count(*) FROM fact)", "(SELECT count(*) FROM orders)"),
        _group_sql("unique_order", "uniqueness",
                   "SELECT 1 FROM fact QUALIFY count(*) OVER (PARTITION BY order_key) > 1", "fail"),
        _group_sql("unique_line", "uniqueness",
                   "SELECT 1 FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1", "fail"),
        _group_sql("one_final_per_customer", "uniqueness",
                   "SELECT cust_key FROM fact GROUP BY 1 HAVING count(*) FILTER (WHERE is_final) <> 1", "fail"),
        _group_sql("years_present", "completeness",
                   "SELECT y FROM range(1995, 2003) t(y) WHERE y NOT IN (SELECT class_year FROM fact)", "fail", "8",
                   "(SELECT 8 - count(*) FROM range(1995, 2003) t(y) WHERE y NOT IN (SELECT class_year FROM fact))"),
        _group_sql("max_priority_by_year", "completeness",
                   """SELECT class_year FROM fact GROUP BY 1 HAVING max(try_cast(split_part(priority, '-', 1) AS INTEGER))
                      IS DISTINCT FROM CASE WHEN class_year <= 1997 THEN 5 WHEN class_year <= 1998 THEN 4 ELSE 5 END""", "fail"),
        _sql("money_coverage", "coverage",
             f"CASE WHEN (SELECT min(p) FROM ({YEAR_COVERAGE})) < 90 THEN 'warn' ELSE 'pass' END",
             f"(SELECT min(p) FROM ({YEAR_COVERAGE}))", "90"),
    ]
)


@query(FACT_SQL + GROUP_CHECKS_SQL)
def dq_group_checks(spark, sf):
    fact = order_outcomes(spark, sf)
    rank = F.split_part("priority", F.lit("-"), F.lit(1))
    ranked = fact.withColumn("rank_text", rank)
    expected = step_by_period(F.col("class_year"), [(1997, 5), (1998, 4)], 5)
    per_year = Q.coverage_by_period(fact, "class_year", "money", F.col("day_seq").between(1, 100))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    results = [
        Q.row_count(fact, table(spark, sf, "orders")),
        Q.unique_result(fact, ["order_key"], "unique_order", ""),
        Q.unique_result(lines, ["l_orderkey", "l_linenumber"], "unique_line", ""),
        Q.offenders_result(Q.final_offenders(fact, "cust_key", "is_final"), "one_final_per_customer",
                           "uniqueness", "fail", ""),
        Q.period_result(fact, "class_year", 1995, 2002),
        Q.offenders_result(Q.max_label_offenders(ranked, "class_year", "rank_text", expected),
                           "max_priority_by_year", "completeness", "fail", ""),
        Q.coverage_result(per_year, "money_coverage", 90, ""),
    ]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select(*PLAIN)


LOW_MONEY = """SELECT class_year FROM fact WHERE day_seq BETWEEN 1 AND 100 GROUP BY class_year
  HAVING round(100 * avg(CASE WHEN money IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) < 50.5"""


@query(
    FACT_SQL
    + f"""SELECT 'years_present' AS name, 'periods 1995-2003 present; missing: ' || (
            SELECT coalesce(string_agg(y, ', ' ORDER BY y), 'none') FROM range(1995, 2004) t(y)
            WHERE y NOT IN (SELECT class_year FROM fact)) AS detail
          UNION ALL SELECT 'money_coverage', 'lowest yearly % with money; below 50.5%: ' || (
            SELECT coalesce(string_agg(class_year, ', ' ORDER BY class_year), 'none') FROM ({LOW_MONEY}))
          UNION ALL SELECT 'money_share', '% with money; ' || (SELECT concat_ws('; ',
            round(100 * avg(CASE WHEN money IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE credited AND reached), 2) || '% of reached',
            round(100 * avg(CASE WHEN money IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE credited AND high), 2) || '% of high')
            FROM fact)"""
)
def dq_evidence(spark, sf):
    fact = order_outcomes(spark, sf)
    per_year = Q.coverage_by_period(fact, "class_year", "money", F.col("day_seq").between(1, 100))
    shares = Q.share("money_share", F.col("money").isNotNull(), "% with money", among=F.col("credited"),
                     within=[("reached", F.col("reached")), ("high", F.col("high"))])
    results = Q.period_result(fact, "class_year", 1995, 2003)
    results = results.unionByName(Q.coverage_result(per_year, "money_coverage", 50.5, "lowest yearly % with money"))
    return results.unionByName(Q.run_row_checks(fact, [shares])).select("name", "detail")


BAD_ROWS = {
    "line_join": "n_lines IS NULL",
    "value_join": "is_final AND coalesce(reached, false) AND value IS NULL",
    "value_range": "value NOT BETWEEN 0 AND 4",
    "price_range": "price NOT BETWEEN 0 AND 499000",
    "ship_after_order": "CAST(first_ship AS DATE) <= order_date",
    "no_credited_non_final": "credited AND NOT is_final",
    "reached_credited": "coalesce(reached, false) AND NOT credited",
    "expectation_complete": "exp_reached IS NULL OR exp_reached < 0 OR exp_reached > 1",
    "tiers_complete": "(class_year BETWEEN 1995 AND 1999) <> (tier IS NOT NULL)",
}


@query(
    FACT_SQL
    + " UNION ALL ".join(
        f"(SELECT '{name}' AS name, CAST(order_key AS VARCHAR) AS example FROM fact WHERE {bad} ORDER BY order_key LIMIT 20)"
        for name, bad in BAD_ROWS.items()
    )
)
def dq_examples(spark, sf):
    fact = order_outcomes(spark, sf)
    found = [
        Q.examples(fact.filter(c.bad), c.name, ["order_key"], ["order_key"]) for c in _row_checks() if c.bad is not None
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("name", F.get_json_object("example", "$.order_key").alias("example"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
       QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"""
)
def grain_duplicates(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spread.duplicated(lines, ["l_orderkey", "l_linenumber"])


CURVE_SQL = FACT_SQL + """, curve AS (SELECT day_seq, avg(CASE WHEN reached THEN 1.0 ELSE 0.0 END) AS p FROM fact
    WHERE eligible GROUP BY 1),
  rises AS (SELECT day_seq, p, p - min(p) OVER (ORDER BY day_seq ROWS UNBOUNDED PRECEDING) AS rise FROM curve)
"""


def _observed_curve(spark, sf):
    hit = F.coalesce(F.col("reached"), F.lit(False)).cast("double")
    return order_outcomes(spark, sf).filter("eligible").groupBy("day_seq").agg(F.avg(hit).alias("p"))


@query(CURVE_SQL + f"SELECT day_seq, {r('p')} AS p, {r('rise')} AS rise_p FROM rises")
def curve_monotone(spark, sf):
    risen = spread.rise_over_running_min(_observed_curve(spark, sf), "day_seq", ["p"], block=50)
    return round_columns(risen, "p rise_p")


@query(CURVE_SQL + f"SELECT 'p' AS curve, day_seq, {r('100 * rise', 2)} AS rise_pts FROM rises WHERE rise > 0.005")
def curve_rise_offenders(spark, sf):
    found = curve_rises(_observed_curve(spark, sf), "day_seq", ["p"])
    return round_columns(found, "rise_pts", 2)


@query(
    FACT_SQL
    + f""", d AS (SELECT class_year * 100 + block AS bin, count(*) AS n, avg(exp_reached) AS expected,
               avg(CASE WHEN reached THEN 1.0 ELSE 0.0 END) AS observed
             FROM fact WHERE eligible AND credited GROUP BY 1),  -- a bin for each class and block
        w AS (SELECT *, (expected + 2.706025 / (2 * n)) / (1 + 2.706025 / n) AS centre,
               1.645 * sqrt(expected * (1 - expected) / n + 2.706025 / (4 * n * n)) / (1 + 2.706025 / n) AS half FROM d)
      SELECT bin, n, {r("expected")} AS expected, {r("observed")} AS observed, {r("centre - half")} AS interval_low,
             {r("centre + half")} AS interval_high
      FROM w WHERE observed NOT BETWEEN centre - half AND centre + half"""
)
def calibration_offenders(spark, sf):
    rows = order_outcomes(spark, sf).filter("eligible AND credited")
    bins = rows.groupBy((F.col("class_year") * 100 + F.col("block")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("exp_reached").alias("expected"),
        F.avg(F.col("reached").cast("double")).alias("observed"),
    )
    return round_columns(Q.calibration_offenders(bins), "expected observed interval_low interval_high")


@query(
    """SELECT o_orderstatus, count(*) AS picks FROM orders WHERE o_totalprice > 400000 GROUP BY 1 ORDER BY picks DESC, 1"""
)
def most_common_offenders(spark, sf):
    return value_freq(table(spark, sf, "orders").filter("o_totalprice > 400000"), "o_orderstatus", "picks")
