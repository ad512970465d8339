"""Report tables and the facts read off them."""

from pyspark.sql import functions as F

from cohortlens.functions.bands import label_order
from cohortlens.operators import cohort, profile, report, stats
from cohortlens.operators.cohort import Rules
from cohortlens.plans.catalog.cohort_queries import COHORT, COHORT_SQL, HI, LO, MEAN_HI, MEAN_LO, METRICS
from cohortlens.plans.catalog.registry import direction_sql, query, r, round_columns, wilson_sql
from cohortlens.plans.orders import (
    COLUMNS,
    FACT_SQL,
    MONEY_BANDS,
    RANGES,
    TIERS,
    TOP_TIERS,
    order_outcomes,
    table,
)

TIER_LIST_SQL = "['Not credited', 'Never reached', 'Low', 'Middle', 'High', 'Top']"
ALL = Rules(count_uncredited=True)


def _distribution_sql(first, pop):
    return FACT_SQL + f""", t AS (SELECT i AS "order", {TIER_LIST_SQL}[i + 1] AS tier FROM range({first}, 6) x(i)),
        c AS (SELECT tier, count(*) AS n FROM fact WHERE {pop} GROUP BY 1),
        d AS (SELECT CAST("order" AS INTEGER) AS "order", t.tier, coalesce(n, 0) AS n FROM t LEFT JOIN c ON c.tier = t.tier)
      SELECT "order", tier, n, {r("100 * n / nullif((SELECT sum(n) FROM d), 0)")} AS pct FROM d"""


@query(_distribution_sql(1, "eligible AND credited"))
def tier_distribution(spark, sf):
    return round_columns(report.tier_distribution(order_outcomes(spark, sf), TIERS, c=COLUMNS), "pct")


@query(_distribution_sql(0, "eligible"))
def tier_distribution_all(spark, sf):
    return round_columns(report.tier_distribution(order_outcomes(spark, sf), TIERS, ALL, COLUMNS), "pct")


@query(
    FACT_SQL
    + f"""SELECT {r("count(*) FILTER (WHERE tier IN ('High', 'Top')) / count(tier)")} AS share
          FROM fact WHERE eligible"""
)
def share_at_least(spark, sf):
    dist = report.tier_distribution(order_outcomes(spark, sf), TIERS, ALL, COLUMNS)
    return round_columns(report.share_at_least(dist, TOP_TIERS), "share")


MIX_SQL = FACT_SQL + f""", g AS (SELECT * FROM (VALUES (0, '400k+'), (1, '200k–400k'), (2, '100k–200k'), (3, '<100k'), (4, 'Nothing')) v(group_order, "group")),
    t AS (SELECT CAST(i - 1 AS INTEGER) AS "order", {TIER_LIST_SQL}[i + 1] AS tier FROM range(1, 6) x(i)),
    rws AS (SELECT money_band, tier FROM fact WHERE eligible AND credited AND money IS NOT NULL AND tier IS NOT NULL),
    c AS (SELECT money_band, tier, count(*) AS n FROM rws GROUP BY 1, 2),
    mix AS (SELECT "group", group_order, "order", t.tier, coalesce(n, 0) AS n,
              CAST(sum(coalesce(n, 0)) OVER (PARTITION BY "group") AS BIGINT) AS group_n
            FROM g CROSS JOIN t LEFT JOIN c ON c.money_band = "group" AND c.tier = t.tier)
"""


def _mix(spark, sf):
    rows = cohort.money_population(order_outcomes(spark, sf), COLUMNS)
    return report.tier_mix(rows, "money_band", [*MONEY_BANDS, "Nothing"], TIERS[1:], "tier")


@query(MIX_SQL + f"""SELECT *, {r("100 * n / nullif(group_n, 0)")} AS pct FROM mix""")
def tier_mix_dense(spark, sf):
    return round_columns(_mix(spark, sf), "pct")


@query(
    MIX_SQL
    + f""", rate AS (SELECT "group", group_order, sum(n) FILTER (WHERE tier IN ('High', 'Top')) / max(group_n) AS rate
            FROM mix WHERE group_n >= 5 GROUP BY 1, 2)
       SELECT min_by("group", group_order) AS first_group, {r("min_by(rate, group_order)")} AS first_rate,
              max_by("group", group_order) AS last_group, {r("max_by(rate, group_order)")} AS last_rate
       FROM rate HAVING count(*) >= 2"""
)
def band_extremes(spark, sf):
    ends = report.band_extremes(_mix(spark, sf), TOP_TIERS, min_n=5)
    return round_columns(ends, "first_rate last_rate")


RANGE_CASE = "CASE " + " ".join(
    f"WHEN day_seq >= {a} THEN '{a}+'" if b is None else f"WHEN day_seq BETWEEN {a} AND {b} THEN '{a}–{b}'"
    for a, b, _ in RANGES
) + " END"
RANGE_ORDER = "CASE " + " ".join(
    f"WHEN day_seq >= {a} THEN {i}" if b is None else f"WHEN day_seq BETWEEN {a} AND {b} THEN {i}"
    for i, (a, b, _) in enumerate(RANGES)
) + " END"
K_LO, K_HI = wilson_sql("sum(hit)", "count(*)")
RANGE_SQL = FACT_SQL + f""", rg AS (
    SELECT "range", CAST(range_order AS INTEGER) AS range_order, median(day_seq) AS median_position, count(*) AS n,
           sum(hit) / count(*) AS rate, {K_LO} AS lo, {K_HI} AS hi, avg(x) AS vs, {MEAN_LO} AS vs_lo, {MEAN_HI} AS vs_hi
    FROM (SELECT {RANGE_CASE} AS "range", {RANGE_ORDER} AS range_order, day_seq,
                 CAST(coalesce(reached, false) AS INTEGER) AS hit, 100 * reached_minus_exp AS x
          FROM fact WHERE eligible AND credited) GROUP BY 1, 2)
"""


@query(
    RANGE_SQL
    + f"""SELECT "range", range_order, median_position, n, {r("rate")} AS rate, {r("lo")} AS lo, {r("hi")} AS hi,
            {r("vs")} AS vs, {r("vs_lo")} AS vs_lo, {r("vs_hi")} AS vs_hi FROM rg"""
)
def range_table(spark, sf):
    ranges = report.range_table(order_outcomes(spark, sf), RANGES, c=COLUMNS)
    return round_columns(ranges, "rate lo hi vs vs_lo vs_hi")


@query(
    RANGE_SQL
    + f""", s AS (SELECT *, {direction_sql("vs_lo", "vs_hi")} AS sig FROM rg WHERE n >= 10)
      SELECT count(*) AS n_ranges, {r("max(abs(vs))")} AS worst_gap,
             count(*) FILTER (WHERE sig IN ('above', 'below')) AS n_off,
             max_by("range", abs(vs) - range_order * 1e-12) FILTER (WHERE sig IN ('above', 'below')) AS biggest_range,
             {r("max_by(vs, abs(vs) - range_order * 1e-12) FILTER (WHERE sig IN ('above', 'below'))")} AS biggest_vs
      FROM s"""
)
def range_deviation(spark, sf):
    ranges = report.range_table(order_outcomes(spark, sf), RANGES, c=COLUMNS)
    return round_columns(report.range_deviation(ranges), "worst_gap biggest_vs")


def _lines():
    return {"Asia": F.col("region") == "ASIA", "Builders": F.col("segment") == "BUILDING"}


LINES_SQL = [("Asia", "region = 'ASIA'"), ("Builders", "segment = 'BUILDING'")]
IN_COHORT = f"({COHORT_SQL})"


@query(
    FACT_SQL
    + f""", size AS (SELECT class_year, count(*) AS size FROM fact GROUP BY 1),
        ln AS (SELECT 'Asia' AS line, class_year, 'line' AS role FROM fact WHERE {IN_COHORT} AND region = 'ASIA'
               UNION ALL SELECT 'Builders', class_year, 'line' FROM fact WHERE {IN_COHORT} AND segment = 'BUILDING'
               UNION ALL SELECT 'This group', class_year, 'reference' FROM fact WHERE {IN_COHORT}),
        tot AS (SELECT count(*) FILTER (WHERE role = 'line') AS covered, count(*) FILTER (WHERE role = 'reference') AS whole FROM ln),
        names AS (SELECT DISTINCT line, role FROM (VALUES ('Asia', 'line'), ('Builders', 'line'), ('This group', 'reference')) v(line, role)),
        c AS (SELECT line, role, class_year, count(*) AS n FROM ln GROUP BY ALL)
      SELECT names.line, size.class_year, {r("coalesce(n, 0) / size")} AS value, coalesce(n, 0) AS n, names.role
      FROM names CROSS JOIN size LEFT JOIN c ON c.line = names.line AND c.class_year = size.class_year
      WHERE names.role = 'line' OR (SELECT covered < whole AND whole < (SELECT count(*) FROM fact) FROM tot)"""
)
def trend_share(spark, sf):
    trend = report.trend_share(order_outcomes(spark, sf), COHORT.condition(), _lines(), "class_year")
    return round_columns(trend, "value")


def _trend_sql(value, where, x, pairs=tuple(LINES_SQL)):
    tagged = " UNION ALL ".join(
        f"SELECT '{n}' AS line, 'line' AS role, class_year, {x} AS x FROM fact WHERE {where} AND {IN_COHORT} AND {p}"
        for n, p in pairs
    )
    base = f"SELECT 'All draftees', 'reference', class_year, {x} FROM fact WHERE {where}"
    return FACT_SQL + f""", v AS ({tagged} UNION ALL {base}),
      tr AS (SELECT line, class_year, {r(value, 4)} AS value, count(x) AS n, role FROM v
             GROUP BY line, role, class_year) """


TREND_RATE_SQL = _trend_sql(
    "sum(x) / count(x)", "eligible AND credited", "CAST(coalesce(reached, false) AS DOUBLE)"
)


@query(TREND_RATE_SQL + "SELECT * FROM tr")
def trend_rate(spark, sf):
    trend = report.trend_metric(
        order_outcomes(spark, sf), COHORT.condition(), _lines(), METRICS["mlb_pct"], c=COLUMNS
    )
    return round_columns(trend, "value", 4)


@query(
    _trend_sql("median(x)", "money IS NOT NULL", "money", pairs=(("This group", "true"),))
    + "SELECT * FROM tr"
)
def trend_median(spark, sf):
    trend = report.trend_metric(
        order_outcomes(spark, sf), COHORT.condition(), {}, METRICS["median_bonus"], c=COLUMNS
    )
    return round_columns(trend, "value", 4)


@query(
    TREND_RATE_SQL
    + """SELECT line, min(class_year) AS first_at, min_by(value, class_year) AS first_value,
             max(class_year) AS last_at, max_by(value, class_year) AS last_value
      FROM tr WHERE value IS NOT NULL GROUP BY line HAVING count(*) >= 2"""
)
def series_endpoints(spark, sf):
    return report.series_endpoints(trend_rate(spark, sf), "line", "class_year", "value")


@query(
    f"""WITH g AS (SELECT p_brand AS "group", {r("avg(p_retailprice)")} AS value, count(*) AS n FROM part GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY value DESC, n DESC, "group") AS a, count(*) OVER () AS total FROM g)
       SELECT "group", value, n FROM o WHERE total <= 20 OR a <= 6 OR a > total - 6"""
)
def extremes(spark, sf):
    groups = table(spark, sf, "part").groupBy(F.col("p_brand").alias("group")).agg(
        F.avg("p_retailprice").alias("value"), F.count(F.lit(1)).alias("n")
    )
    order = [("value", True), ("n", True), ("group", False)]
    return report.extremes(round_columns(groups, "value"), order, max_rows=20, keep=6)


@query(
    """SELECT s_nationkey AS "group", max(s_acctbal) AS value, count(*) AS n FROM supplier GROUP BY 1"""
)
def extremes_of_a_small_table(spark, sf):
    groups = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("group")).agg(
        F.max("s_acctbal").alias("value"), F.count(F.lit(1)).alias("n")
    )
    return report.extremes(groups, [("value", True), ("n", True), ("group", False)])


@query(
    FACT_SQL
    + """SELECT order_key, value, class_year, day_seq FROM (
           SELECT * FROM fact WHERE value IS NOT NULL ORDER BY value DESC, class_year, day_seq LIMIT 5)"""
)
def top_producers(spark, sf):
    top = report.top_producers(order_outcomes(spark, sf), 5, COLUMNS)
    return top.select("order_key", "value", "class_year", "day_seq")


@query(
    FACT_SQL
    + """SELECT order_key, money, class_year, day_seq FROM (
           SELECT * FROM fact WHERE eligible AND credited AND NOT coalesce(reached, false) AND money IS NOT NULL
           ORDER BY money DESC, class_year, day_seq LIMIT 5)"""
)
def biggest_misses(spark, sf):
    misses = report.biggest_misses(order_outcomes(spark, sf), 5, COLUMNS)
    return misses.select("order_key", "money", "class_year", "day_seq")


@query(
    f"""WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT *, {r("100 * n / sum(n) OVER (PARTITION BY l_returnflag)", 1)} AS pct FROM c"""
)
def share_of_parent(spark, sf):
    shares = report.share_of_parent(
        table(spark, sf, "lineitem"), ["l_returnflag"], ["l_linestatus", "l_linenumber"], digits=9
    )
    return round_columns(shares, "pct", 1)


COVERAGE_SQL = FACT_SQL + """, cov AS (SELECT class_year, money_band, count(*) AS n_rows, count(money) AS n_known FROM fact GROUP BY 1, 2)
"""


@query(COVERAGE_SQL + f"""SELECT *, {r("100 * n_known / n_rows", 1)} AS pct_known FROM cov""")
def coverage_by_class(spark, sf):
    rows = report.coverage(order_outcomes(spark, sf), ["class_year", "money_band"], "money", digits=9)
    return round_columns(rows, "pct_known", 1)


@query(
    COVERAGE_SQL
    + f"""SELECT {r("sum(n_known) FILTER (WHERE money_band IN ('<100k', 'Unknown')) / sum(n_rows) FILTER (WHERE money_band IN ('<100k', 'Unknown'))")} AS early_share,
            {r("sum(n_known) FILTER (WHERE money_band NOT IN ('<100k', 'Unknown')) / sum(n_rows) FILTER (WHERE money_band NOT IN ('<100k', 'Unknown'))")} AS rest_share
          FROM cov"""
)
def weighted_coverage(spark, sf):
    rows = report.coverage(order_outcomes(spark, sf), ["class_year", "money_band"], "money")
    shares = report.weighted_coverage(rows, "money_band", ["<100k", "Unknown"])
    return round_columns(shares, "early_share rest_share")


EVENT_TYPES = ["view", "click", "purchase", "refund"]


@query(
    "SELECT user_id, "
    + ", ".join(
        f"""{r(f"100 * avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type = '{t}')")} AS "{t}" """
        for t in EVENT_TYPES
    )
    + " FROM events GROUP BY user_id"
)
def coverage_pivot(spark, sf):
    wide = report.coverage_pivot(
        table(spark, sf, "events"), "user_id", "event_type", EVENT_TYPES, F.col("value") > 50
    )
    return round_columns(wide, " ".join(EVENT_TYPES))


@query(
    FACT_SQL
    + f"""SELECT count(*) FILTER (WHERE money >= 250000) AS n_high, {r("avg(value) FILTER (WHERE money >= 250000)")} AS mean_high,
            count(*) FILTER (WHERE money < 250000) AS n_low, {r("avg(value) FILTER (WHERE money < 250000)")} AS mean_low
          FROM fact WHERE eligible AND credited AND money > 0"""
)
def split_means(spark, sf):
    points = cohort.money_points(order_outcomes(spark, sf), COLUMNS)
    return round_columns(report.split_means(points, "money", 250_000, "value"), "mean_high mean_low")


@query(
    FACT_SQL
    + f"""SELECT {r("avg(CASE WHEN tier IN ('High', 'Top') THEN 1.0 ELSE 0.0 END) FILTER (WHERE class_year <= 1997)")} AS early_share,
            {r("avg(CASE WHEN tier IN ('High', 'Top') THEN 1.0 ELSE 0.0 END) FILTER (WHERE class_year > 1997)")} AS late_share,
            {r("avg(CASE WHEN tier IN ('High', 'Top') THEN 1.0 ELSE 0.0 END)")} AS all_share
          FROM fact WHERE tier IS NOT NULL"""
)
def early_late_share(spark, sf):
    tiered = order_outcomes(spark, sf).filter("tier IS NOT NULL")
    shares = report.early_late_share(tiered, "class_year", 1997, F.col("tier").isin(*TOP_TIERS))
    return round_columns(shares, "early_share late_share all_share")


@query(
    f"""WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS class_year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
        s AS (SELECT class_year, o_orderstatus, {r("100 * n / sum(n) OVER (PARTITION BY class_year)", 1)} AS pct FROM c)
       SELECT min(class_year) AS first_at, min_by(pct, class_year) AS first_pct, max(class_year) AS last_at, max_by(pct, class_year) AS last_pct
       FROM s WHERE o_orderstatus = 'O'"""
)
def first_last_share(spark, sf):
    orders = table(spark, sf, "orders").withColumn("class_year", F.year("o_orderdate"))
    mix = report.share_of_parent(orders, ["class_year"], ["o_orderstatus"], digits=9)
    mix = round_columns(mix, "pct", 1).filter(F.col("o_orderstatus") == "O")
    return report.first_last_share(mix, "class_year")


@query(
    FACT_SQL
    + f""", g AS (SELECT nation AS "group", avg(x) AS value, {MEAN_LO} AS lo, {MEAN_HI} AS hi, count(x) AS n
          FROM (SELECT nation, 100 * reached_minus_exp AS x FROM fact WHERE eligible AND credited)
          WHERE nation IS NOT NULL GROUP BY 1 HAVING count(x) >= 10),
        s AS (SELECT *, {direction_sql("lo", "hi")} AS sig FROM g)
      SELECT count(*) AS n_groups, count(*) FILTER (WHERE sig = 'above') AS n_above,
             count(*) FILTER (WHERE sig = 'below') AS n_below, max_by("group", value) AS leader,
             max_by("group", value) FILTER (WHERE sig = 'above') AS best_clear FROM s"""
)
def significance_tally(spark, sf):
    ranked = stats.ranking(order_outcomes(spark, sf), "nation", METRICS["mlb_vs_slot"], 10, c=COLUMNS)
    return report.significance_tally(stats.with_direction(ranked, 0.0))


def _cohorts():
    return {
        "Everyone": F.lit(True),
        "First month": F.col("day_seq") <= 31,
        "Asia": F.col("region") == "ASIA",
        "Builders": F.col("segment") == "BUILDING",
    }


COHORTS_SQL = [("Everyone", "true"), ("First month", "day_seq <= 31"), ("Asia", "region = 'ASIA'"), ("Builders", "segment = 'BUILDING'")]
M_LO, M_HI = wilson_sql("sum(hit)", "count(hit)")


@query(
    FACT_SQL
    + """, tagged AS ("""
    + " UNION ALL ".join(f"""SELECT '{n}' AS "group", * FROM fact WHERE {p}""" for n, p in COHORTS_SQL)
    + f"""), v AS (SELECT "group", CASE WHEN eligible AND credited THEN CAST(coalesce(reached, false) AS DOUBLE) END AS hit,
          CASE WHEN eligible AND credited THEN value END AS val,
          CASE WHEN eligible AND credited AND coalesce(reached, false) THEN delay END AS dl,
          100 * reached_minus_exp AS x, CASE WHEN class_year <= 1999 THEN tier END AS tr FROM tagged),
        a AS (SELECT "group", count(hit) AS players, sum(hit) / count(hit) AS rate, {M_LO} AS rate_lo, {M_HI} AS rate_hi,
          avg(val) AS value_per_player, median(dl) AS median_delay, avg(x) AS vs_points, {MEAN_LO} AS vs_lo, {MEAN_HI} AS vs_hi,
          count(tr) AS tier_rows, """
    + ", ".join(f"count(*) FILTER (WHERE tr = '{t}') / count(tr) AS share_{i}" for i, t in enumerate(TIERS))
    + f""" FROM v GROUP BY 1)
      SELECT "group", players, {r("rate")} AS rate, {r("rate_lo")} AS rate_lo, {r("rate_hi")} AS rate_hi,
        {r("value_per_player")} AS value_per_player, median_delay, {r("vs_points")} AS vs_points,
        {r("vs_lo")} AS vs_lo, {r("vs_hi")} AS vs_hi, {direction_sql("vs_lo", "vs_hi")} AS sig, tier_rows, """
    + ", ".join(f"{r(f'share_{i}')} AS share_{i}" for i in range(len(TIERS)))
    + " FROM a"
)
def multi_cohort_report(spark, sf):
    out = report.multi_cohort(
        order_outcomes(spark, sf), _cohorts(), c=COLUMNS, tiers=TIERS, last_period=1999
    )
    shares = " ".join(f"share_{i}" for i in range(len(TIERS)))
    return round_columns(out, "rate rate_lo rate_hi value_per_player vs_points vs_lo vs_hi " + shares)


@query(
    """SELECT o_orderpriority, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1
         WHEN '1-URGENT' THEN 2 END AS INTEGER) AS place FROM orders GROUP BY 1"""
)
def ordered_categories(spark, sf):
    counts = profile.value_freq(table(spark, sf, "orders"), "o_orderpriority")
    place = label_order(F.col("o_orderpriority"), ["5-LOW", "3-MEDIUM", "1-URGENT"])
    return counts.withColumn("place", place).orderBy(F.col("place").asc_nulls_last(), "o_orderpriority")


@query(
    "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 4"
)
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "part"), "p_brand")
