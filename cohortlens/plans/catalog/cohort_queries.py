"""Filters, populations, metric values, statistics and rankings over the order outcomes."""

from pyspark.sql import functions as F

from cohortlens.operators import cohort, stats
from cohortlens.operators.cohort import FilterSpec, Rules
from cohortlens.plans.catalog.registry import (
    direction_sql,
    query,
    r,
    round_columns,
    wilson_sql,
)
from cohortlens.plans.orders import COLUMNS, FACT_SQL, order_outcomes, table

METRICS = cohort.standard_metrics(COLUMNS)
ALL = Rules(count_uncredited=True)
COHORT = FilterSpec(
    ranges={"class_year": (1995, 1999), "day_seq": (1, 270)},
    members={"region": ("ASIA", "EUROPE"), "segment": ("BUILDING", "MACHINERY", "FURNITURE"), "priority": ()},
)
COHORT_SQL = """class_year BETWEEN 1995 AND 1999 AND day_seq BETWEEN 1 AND 270
  AND region IN ('ASIA', 'EUROPE') AND segment IN ('BUILDING', 'MACHINERY', 'FURNITURE')"""
PRESETS = {
    "Asian builders": FilterSpec(members={"region": ("ASIA",), "segment": ("BUILDING",)}),
    "Urgent early": FilterSpec(ranges={"day_seq": (1, 90)}, members={"priority": ("1-URGENT",)}),
    "Large credited": FilterSpec(members={"money_band": ("200k–400k", "400k+")}),
}
LO, HI = wilson_sql("sum(x)", "count(x)")
MEAN_LO, MEAN_HI = ("avg(x) - 1.645 * (stddev_samp(x) / sqrt(count(x)))",
                    "avg(x) + 1.645 * (stddev_samp(x) / sqrt(count(x)))")
BASE_RATE = "(SELECT avg(CAST(reached AS DOUBLE)) FROM fact WHERE eligible AND credited)"


@query(
    FACT_SQL
    + f""", g AS (
        SELECT nation AS "group", sum(x) / count(x) AS value, {LO} AS lo, {HI} AS hi, count(x) AS n
        FROM (SELECT nation, CAST(coalesce(reached, false) AS DOUBLE) AS x FROM fact WHERE eligible AND credited)
        WHERE nation IS NOT NULL GROUP BY 1)
      SELECT "group", {r("value")} AS value, {r("lo")} AS lo, {r("hi")} AS hi, n,
             {direction_sql(f"(lo - {BASE_RATE})", f"(hi - {BASE_RATE})")} AS sig
      FROM g WHERE n >= 10"""
)
def group_ranking_wilson(spark, sf):
    fact = order_outcomes(spark, sf)
    metric = METRICS["mlb_pct"]
    table_ = stats.ranking(fact, "nation", metric, 10, c=COLUMNS)
    reference = stats.stat(fact, metric, c=COLUMNS).select("value").scalar()
    return round_columns(stats.rank_order(stats.with_direction(table_, reference)), "value lo hi")


@query(
    FACT_SQL
    + f""", g AS (
        SELECT segment AS "group", avg(x) AS value, {MEAN_LO} AS lo, {MEAN_HI} AS hi, count(x) AS n
        FROM (SELECT segment, 100 * reached_minus_exp AS x FROM fact WHERE eligible AND credited)
        WHERE x IS NOT NULL AND segment IS NOT NULL GROUP BY 1)
      SELECT "group", {r("value")} AS value, {r("lo")} AS lo, {r("hi")} AS hi, n,
             {direction_sql("lo", "hi")} AS sig FROM g WHERE n >= 5"""
)
def group_ranking_mean(spark, sf):
    ranked = stats.ranking(order_outcomes(spark, sf), "segment", METRICS["mlb_vs_slot"], 5, c=COLUMNS)
    return round_columns(stats.with_direction(ranked, 0.0), "value lo hi")


@query(
    FACT_SQL
    + f"""SELECT nation AS "group", {r("median(money)")} AS value, CAST(NULL AS DOUBLE) AS lo,
            CAST(NULL AS DOUBLE) AS hi, count(*) AS n, 'none' AS sig
          FROM fact WHERE money IS NOT NULL AND nation IS NOT NULL GROUP BY 1 HAVING count(*) >= 20"""
)
def group_ranking_median(spark, sf):
    ranked = stats.ranking(order_outcomes(spark, sf), "nation", METRICS["median_bonus"], 20, c=COLUMNS)
    return round_columns(stats.with_direction(ranked, 0.0), "value")


@query(
    f"""WITH v AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS x FROM events)
        SELECT user_id, {r("sum(x) / count(x)")} AS value, {r(LO)} AS lo, {r(HI)} AS hi, count(x) AS n
        FROM v WHERE user_id IS NOT NULL GROUP BY 1"""
)
def event_rate_by_user(spark, sf):
    hit = (F.col("event_type") == "purchase").cast("double")
    values = table(spark, sf, "events").select("user_id", hit.alias("x"))
    return round_columns(stats.stat_of_values(values, ["user_id"], "rate"), "value lo hi")


@query(
    f"""WITH v AS (SELECT source, CAST(quality AS DOUBLE) AS x FROM documents JOIN labels USING (doc_id))
        SELECT source, {r("sum(x) / count(x)")} AS value, {r(LO)} AS lo, {r(HI)} AS hi, count(x) AS n
        FROM v GROUP BY 1"""
)
def label_rate_by_source(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    values = documents.join(table(spark, sf, "labels"), "doc_id").select(
        "source", F.col("quality").cast("double").alias("x")
    )
    return round_columns(stats.stat_of_values(values, ["source"], "rate"), "value lo hi")


def _metric_sql(key, kind, where, x):
    if kind == "rate":
        value, lo, hi = "sum(x) / nullif(count(x), 0)", LO, HI
    elif kind == "mean":
        value, lo, hi = "avg(x)", MEAN_LO, MEAN_HI
    else:
        value, lo, hi = "median(x)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{key}' AS metric, {r(value, 4)} AS value, {r(lo, 4)} AS lo, {r(hi, 4)} AS hi, count(x) AS n "
        f"FROM (SELECT {x} AS x FROM cohort WHERE {where})"
    )


def _all_metrics_sql(credited: bool) -> str:
    pop = "eligible AND credited" if credited else "eligible"
    reach = "100 * reached_minus_exp" if credited else "100 * (CAST(coalesce(reached, false) AS INTEGER) - exp_reached_all)"
    high = "100 * high_minus_exp" if credited else "100 * (CAST(coalesce(high, false) AS INTEGER) - exp_high_all)"
    parts = [
        ("mlb_vs_slot", "mean", pop, reach),
        ("regular_vs_slot", "mean", pop, high),
        ("mlb_pct", "rate", pop, "CAST(coalesce(reached, false) AS DOUBLE)"),
        ("regular_pct", "rate", pop, "CAST(coalesce(high, false) AS DOUBLE)"),
        ("median_bonus", "median", "money IS NOT NULL", "money"),
        ("signed_pct", "rate", "true", "CAST(credited AS DOUBLE)"),
        ("war_per_player", "mean", f"{pop} AND value IS NOT NULL", "value"),
        ("years_to_debut", "median", f"{pop} AND coalesce(reached, false) AND delay IS NOT NULL", "delay"),
    ]
    body = " UNION ALL ".join(_metric_sql(*p) for p in parts)
    return FACT_SQL + f", cohort AS (SELECT * FROM fact WHERE {COHORT_SQL}) " + body


def _all_metrics(spark, sf, rules):
    chosen = cohort.apply_filter(order_outcomes(spark, sf), COHORT)
    table_ = stats.stat_table(chosen, list(METRICS.values()), rules, COLUMNS)
    return round_columns(table_, "value lo hi", 4)


@query(_all_metrics_sql(True))
def cohort_metrics(spark, sf):
    return _all_metrics(spark, sf, Rules())


@query(_all_metrics_sql(False))
def cohort_metrics_all_eligible(spark, sf):
    return _all_metrics(spark, sf, ALL)


@query(
    FACT_SQL
    + f""", c AS (SELECT sum(x) / count(x) AS value, {LO} AS lo, {HI} AS hi, count(x) AS n FROM (
          SELECT CAST(coalesce(reached, false) AS DOUBLE) AS x FROM fact WHERE eligible AND credited AND {COHORT_SQL})),
        b AS (SELECT avg(CAST(coalesce(reached, false) AS DOUBLE)) AS ref FROM fact
              WHERE eligible AND credited AND class_year BETWEEN 1995 AND 1999)
      SELECT {r("value - ref")} AS value, {r("lo - ref")} AS lo, {r("hi - ref")} AS hi, n,
             {direction_sql("(lo - ref)", "(hi - ref)")} AS sig FROM c, b"""
)
def cohort_vs_baseline(spark, sf):
    fact = order_outcomes(spark, sf)
    metric = METRICS["mlb_pct"]
    base = cohort.apply_filter(fact, COHORT.baseline(["class_year"]))
    reference = stats.stat(base, metric, c=COLUMNS).select("value").scalar()
    own = stats.stat(cohort.apply_filter(fact, COHORT), metric, c=COLUMNS)
    return round_columns(stats.delta_vs(own, reference), "value lo hi")


@query(
    FACT_SQL
    + """, g AS (SELECT nation, count(*) AS n FROM fact WHERE eligible AND credited AND nation IS NOT NULL GROUP BY 1)
      SELECT (SELECT count(DISTINCT nation) FROM fact) AS present,
             (SELECT count(*) FROM g WHERE n >= 60) AS visible,
             (SELECT count(DISTINCT nation) FROM fact) - (SELECT count(*) FROM g WHERE n >= 60) AS hidden"""
)
def hidden_groups(spark, sf):
    fact = order_outcomes(spark, sf)
    return stats.hidden_groups(fact, "nation", stats.ranking(fact, "nation", METRICS["mlb_pct"], 60, c=COLUMNS))


@query(
    FACT_SQL
    + """SELECT preset, count(*) AS n FROM (
           SELECT unnest(list_filter([
             CASE WHEN region = 'ASIA' AND segment = 'BUILDING' THEN 'Asian builders' END,
             CASE WHEN day_seq BETWEEN 1 AND 90 AND priority = '1-URGENT' THEN 'Urgent early' END,
             CASE WHEN money_band IN ('200k–400k', '400k+') THEN 'Large credited' END], lambda x: x IS NOT NULL)) AS preset
           FROM fact) GROUP BY 1"""
)
def filter_presets(spark, sf):
    tags = [F.when(spec.condition(), F.lit(name)) for name, spec in PRESETS.items()]
    rows = order_outcomes(spark, sf).select(F.explode(F.array_compact(F.array(*tags))).alias("preset"))
    return rows.groupBy("preset").agg(F.count(F.lit(1)).alias("n"))


@query(
    FACT_SQL
    + f"""SELECT order_key, {r("100 * (CAST(coalesce(high, false) AS INTEGER) - exp_high_all)")} AS x
          FROM fact WHERE eligible"""
)
def metric_values(spark, sf):
    values = cohort.metric_values(order_outcomes(spark, sf), METRICS["regular_vs_slot"], ALL, COLUMNS)
    return round_columns(values.select("order_key", "x"), "x")


@query(
    FACT_SQL
    + f"""SELECT order_key, money, {r("money / slot_value")} AS ratio FROM fact
          WHERE eligible AND credited AND money IS NOT NULL AND tier IS NOT NULL
            AND class_year BETWEEN 1996 AND 1998 AND day_seq <= 200 AND slot_value IS NOT NULL"""
)
def money_population(spark, sf):
    rows = cohort.money_population(
        order_outcomes(spark, sf), COLUMNS, periods=(1996, 1998), known=["slot_value"],
        within=F.col("day_seq") <= 200,
    )
    ratio = (F.col("money") / F.col("slot_value")).alias("ratio")
    return round_columns(rows.select("order_key", "money", ratio), "ratio")


@query(
    FACT_SQL
    + """SELECT order_key, money, greatest(money, 5000.0) AS axis_value FROM fact
         WHERE eligible AND credited AND money > 0"""
)
def money_points(spark, sf):
    points = cohort.money_points(order_outcomes(spark, sf), COLUMNS, axis_floor=5000.0)
    return points.select("order_key", "money", "axis_value")


@query(
    """WITH cuts AS (SELECT l_orderkey, max(l_linenumber) AS cut FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN cuts USING (l_orderkey)
       WHERE l_quantity > 10 AND l_linenumber <= cut"""
)
def leading_group_cut(spark, sf):
    lines = table(spark, sf, "lineitem")
    kept = cohort.leading_cut(
        lines.filter("l_quantity > 10"), lines, "l_orderkey", "l_linenumber", "l_returnflag", "R",
        spread=["l_partkey", "l_suppkey"],
    )
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(
    """SELECT DISTINCT p_brand FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_size IN (1, 2, 3, 4, 5, 6, 7)
         AND p_brand IS NOT NULL"""
)
def option_list(spark, sf):
    narrow = {"p_type": ("PROMO", "LARGE"), "p_size": tuple(range(1, 8)), "p_name": ()}
    return cohort.options(table(spark, sf, "part"), "p_brand", narrow, tail=("Brand#1", "Brand#2"))


@query(
    FACT_SQL
    + f"""SELECT 'https://example.org/order/' || order_key || '#' || nation AS "Order", class_year AS "Class",
            {r("100 * money / slot_value")} AS "vs. lines", CAST(year(first_ship) AS INTEGER) AS "Shipped"
          FROM fact WHERE credited"""
)
def export_table(spark, sf):
    url = F.concat(F.lit("https://example.org/order/"), F.col("order_key"), F.lit("#"), F.col("nation"))
    out = cohort.export_table(
        order_outcomes(spark, sf).filter("credited"),
        {
            "Order": url,
            "Class": "class_year",
            "vs. lines": 100 * F.col("money") / F.col("slot_value"),
            "Shipped": F.year("first_ship"),
        },
        [F.col("value").desc_nulls_last(), "class_year", "order_key"],
    )
    return out.withColumn("vs. lines", F.floor(F.col("`vs. lines`") * 1e6 + 0.5) / 1e6)


@query(
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {r("sum(l_extendedprice)", 2)} AS total,
               {r("avg(l_extendedprice)", 4)} AS mean, {r("stddev_samp(l_extendedprice)", 4)} AS std,
               {r("median(l_extendedprice)", 4)} AS median
        FROM lineitem GROUP BY 1, 2"""
)
def five_numbers(spark, sf):
    lines = table(spark, sf, "lineitem")
    out = stats.summary(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return round_columns(round_columns(out, "total", 2), "mean std median", 4)
