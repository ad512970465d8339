"""An outcome fact table over the order tables: the same operators under other column names.

An entity is a customer at one priority, an event is an order, its class the order year and its
sequence number the day of the year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import bands, dates
from cohortlens.operators.cohort import OutcomeColumns
from cohortlens.operators.expect import (
    ALWAYS_STEPS,
    CurveSpec,
    curve_cells,
    curve_points,
    solve,
    training_counts,
    with_residuals,
)
from cohortlens.operators.spread import hot_keys, lookup_join
from cohortlens.session import written_once

COLUMNS = OutcomeColumns(
    period="class_year",
    sequence="day_seq",
    eligible="eligible",
    credited="credited",
    reached="reached",
    high="high",
    money="money",
    value="value",
    delay="delay",
    tier="tier",
    exp_reached="exp_reached_all",
    exp_high="exp_high_all",
    reached_diff="reached_minus_exp",
    high_diff="high_minus_exp",
)
WINDOW = (1995, 1999)
TIERS = ["Not credited", "Never reached", "Low", "Middle", "High", "Top"]
TOP_TIERS = ["High", "Top"]
THRESHOLDS = (0.5, 1.0, 2.0)
HIGH_VALUE = 1.0
MONEY_EDGES = [(100_000, "<100k"), (200_000, "100k–200k"), (400_000, "200k–400k")]
MONEY_BANDS = ["400k+", "200k–400k", "100k–200k", "<100k"]
RANGES = [
    (1, 30, "1–30"), (31, 90, "31–90"), (91, 180, "91–180"), (181, 270, "181–270"), (271, 360, "271–360"),
    (361, None, "361+"),
]
BLOCK = 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_totals(lines: DataFrame) -> DataFrame:
    """Per order: lines, returned lines, exact net and gross amounts, first shipment."""
    net = F.rint(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")
    return lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.sum(net).alias("net_e4"),
        F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long")).alias("gross_e2"),
        F.min("l_shipdate").alias("first_ship"),
    )


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer, place and line totals; the latest order per entity flagged."""
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust_key"), F.col("c_mktsegment").alias("segment"), "c_nationkey"
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cust_key"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("price"),
    )
    # Narrow rows travel: first to the customers, then to the lines; dates and places are added in place.
    hot = hot_keys(orders, ["cust_key"])
    rows = lookup_join(orders, customer, ["cust_key"], spread=["order_key"], hot=hot)
    rows = _with_flag_and_lines(rows, _latest(orders), line_totals(table(spark, folder, "lineitem")))
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    ).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    rows = rows.join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        "cust_key", "order_key", "priority", "status", "order_date",
        F.year("order_date").alias("class_year"), F.dayofyear("order_date").alias("day_seq"), "price", "is_final",
        "n_lines", "n_returned", "net_e4", "gross_e2", "first_ship", "segment", "nation", "region",
    )


ENTITY, ORDER = ["cust_key", "priority"], ["order_date", "order_key"]


def _latest(orders: DataFrame) -> DataFrame:
    """The latest order of each customer and priority."""
    latest = orders.groupBy(*ENTITY).agg(F.max(F.struct(*ORDER)).alias("_last"))
    return latest.select(
        *[F.col(c).alias(f"_{c}") for c in ENTITY], *[F.col(f"_last.{c}").alias(f"_{c}") for c in ORDER],
        F.lit(True).alias("_hit"),
    )


def _with_flag_and_lines(orders: DataFrame, latest: DataFrame, lines: DataFrame) -> DataFrame:
    """``is_final`` (among the ``latest``, as by ``flag_last``) and line totals.

    Both are matched by the order's key alone, so the orders are shuffled once for the two joins; what
    else must agree is compared in the condition. A missing key stands at 0 and is compared as missing.
    """
    key = F.coalesce("order_key", F.lit(0))
    at = F.coalesce("_order_key", F.lit(0))
    # A sum of matches, because Spark would shuffle by every column that is compared alone.
    same = sum((F.col(c).eqNullSafe(F.col(f"_{c}")).cast("int") for c in (*ENTITY, *ORDER)), F.lit(0))
    flagged = orders.join(latest, (key == at) & (same == len(ENTITY) + len(ORDER)), "left")
    lines = lines.withColumnRenamed("order_key", "_line_key")
    totals = [c for c in lines.columns if c != "_line_key"]
    joined = flagged.join(lines, (key == F.col("_line_key")) & F.col("order_key").isNotNull(), "left")
    return joined.select(*orders.columns, F.coalesce("_hit", F.lit(False)).alias("is_final"), *totals)


#: The four curves of the fact table. Days of a year are few, so each is a step fit.
CURVES = [
    CurveSpec("exp_reached_all", "reached", False),
    CurveSpec("exp_high_all", "high", False),
    CurveSpec("exp_reached", "reached", True),
    CurveSpec("exp_high", "high", True),
]
LAST_DAY = 366


def published_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Every curve's value per day of the year, fitted on the labelled orders: an input relation."""

    def build() -> DataFrame:
        counts = training_counts(labelled_orders(spark, folder), CURVES, [COLUMNS.sequence], COLUMNS)
        fits = solve(curve_cells(counts, CURVES, COLUMNS.sequence), LAST_DAY, max_rise=ALWAYS_STEPS)
        points = curve_points(fits, LAST_DAY).withColumnRenamed("x", COLUMNS.sequence)
        return points.groupBy(COLUMNS.sequence).pivot("fit", [s.name for s in CURVES]).agg(F.first("p"))

    return written_once(spark, ("published_curves", folder), build)


def order_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table over the labelled orders, which are written once per application.

    The curves are a row a day and are joined where the orders are read, so the fact is not written again.
    """
    return build_outcomes(spark, folder)


def labelled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with its outcomes, tiers and bands, as the curves are trained on."""
    return written_once(spark, ("labelled_orders", folder), lambda: _labelled(order_rows(spark, folder)))


def build_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table: labelled orders, the published curves by day, and what lies between them."""
    curves = F.broadcast(published_curves(spark, folder))  # LAST_DAY rows
    rows = labelled_orders(spark, folder).join(curves, COLUMNS.sequence, "left")
    gaps = [("reached", "exp_reached", "reached_minus_exp"), ("high", "exp_high", "high_minus_exp")]
    return with_residuals(rows, gaps, COLUMNS)


def _labelled(rows: DataFrame) -> DataFrame:
    final = F.col("is_final")
    reached = F.coalesce(F.col("n_returned"), F.lit(0)) >= 2
    value = F.when(~reached, F.lit(0.0)).otherwise(F.col("net_e4") / 1e9)
    in_window = F.col("class_year").between(*WINDOW)
    rows = rows.withColumns(
        {
            "credited": final & (F.col("status") != "P"),
            "eligible": in_window & final,
            "reached": F.when(final, reached),
            "value": F.when(final, value),
            "delay": F.when(
                final & reached, dates.elapsed_years(F.col("order_date"), F.to_date("first_ship"))
            ),
            "money": F.when(F.col("status") != "F", F.col("price")),
            "slot_value": F.col("gross_e2") / 100.0,
        }
    )
    rows = rows.withColumns(
        {
            "high": F.when(F.col("eligible"), F.col("value") >= HIGH_VALUE),
            "tier_order": bands.tier_order(
                F.col("value"), THRESHOLDS, in_window=in_window, credited=F.col("credited"),
                reached=F.col("reached"),
            ),
            "money_band": bands.band(
                F.col("money"), MONEY_EDGES, "400k+", inclusive=False, null_label="Unknown",
                overrides=[(~F.col("credited"), "Not credited")],
            ),
            "block": F.floor((F.col("day_seq") - 1) / BLOCK).cast("int"),
        }
    )
    return rows.withColumn("tier", bands.ordinal_label(F.col("tier_order"), TIERS))


def step_sql(cells: str, out: str) -> str:
    """SQL of ``out`` (fit, x, p): decreasing step fits of ``cells`` (fit, x, n, k) by the min-max
    formula, the least over starts a <= x of the largest mean of a..b over ends b >= x."""
    return f"""{out}_sums AS (
  SELECT fit, x, n, k, sum(n) OVER w AS nn, sum(k) OVER w AS kk FROM {cells} WINDOW w AS (PARTITION BY fit ORDER BY x)
), {out}_tops AS (
  SELECT a.fit, b.x, max(CAST(b.kk - a.kk + a.k AS DOUBLE) / CAST(b.nn - a.nn + a.n AS DOUBLE))
    OVER (PARTITION BY a.fit, a.x ORDER BY b.x DESC) AS top
  FROM {out}_sums a JOIN {out}_sums b ON a.fit = b.fit AND b.x >= a.x
), {out} AS (
  SELECT fit, x, min(top) AS p FROM {out}_tops GROUP BY 1, 2
)"""


def between_sql(points: str, steps: str, out: str) -> str:
    """SQL of ``out`` (columns of ``points`` and p): step fits read off at ``points`` (fit, x, ...)."""
    return f"""{out}_ends AS (
  SELECT g.*, l.x AS lx, l.p AS lp, h.x AS hx, h.p AS hp FROM {points} g
  ASOF LEFT JOIN {steps} l ON l.fit = g.fit AND l.x <= g.x ASOF LEFT JOIN {steps} h ON h.fit = g.fit AND h.x >= g.x
), {out} AS (
  SELECT * EXCLUDE (lx, lp, hx, hp), CASE WHEN lp IS NULL THEN hp WHEN hp IS NULL OR lx >= x THEN lp
    ELSE lp + (hp - lp) * ((x - lx) / CAST(hx - lx AS DOUBLE)) END AS p FROM {out}_ends
)"""


# The same fact table in SQL, for the side-by-side checks.
LABELLED_SQL = """
WITH line AS (
  SELECT l_orderkey AS order_key, COUNT(*) AS n_lines,
         COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
         CAST(SUM(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS net_e4,
         CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross_e2,
         MIN(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_orderkey
), ranked AS (
  SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderpriority AS priority,
         o_orderstatus AS status, CAST(o_orderdate AS DATE) AS order_date,
         CAST(year(o_orderdate) AS INTEGER) AS class_year,
         CAST(dayofyear(o_orderdate) AS INTEGER) AS day_seq, o_totalprice AS price,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                            ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_final
  FROM orders
), joined AS (
  SELECT r.*, n_lines, n_returned, net_e4, gross_e2, first_ship,
         c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM ranked r LEFT JOIN line USING (order_key)
  LEFT JOIN customer ON c_custkey = cust_key
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
), outcome AS (
  SELECT *, is_final AND status <> 'P' AS credited,
         class_year BETWEEN 1995 AND 1999 AND is_final AS eligible,
         CASE WHEN is_final THEN coalesce(n_returned, 0) >= 2 END AS reached,
         CASE WHEN is_final THEN
           CASE WHEN coalesce(n_returned, 0) < 2 THEN 0.0 ELSE net_e4 / 1e9 END END AS value,
         CASE WHEN is_final AND coalesce(n_returned, 0) >= 2 THEN
           round(date_diff('day', order_date, CAST(first_ship AS DATE)) / 365.25, 1) END AS delay,
         CASE WHEN status <> 'F' THEN price END AS money, gross_e2 / 100.0 AS slot_value,
         CAST(floor((day_seq - 1) / 30) AS INTEGER) AS block
  FROM joined
), tiered AS (
  SELECT *, CASE WHEN eligible THEN value >= 1.0 END AS high,
         CASE WHEN class_year NOT BETWEEN 1995 AND 1999 THEN NULL
              WHEN NOT credited THEN 0 WHEN NOT reached THEN 1 WHEN value IS NULL THEN NULL
              WHEN value < 0.5 THEN 2 WHEN value < 1.0 THEN 3 WHEN value < 2.0 THEN 4
              ELSE 5 END AS tier_order,
         CASE WHEN NOT credited THEN 'Not credited' WHEN money IS NULL THEN 'Unknown'
              WHEN money < 100000 THEN '<100k' WHEN money < 200000 THEN '100k–200k'
              WHEN money < 400000 THEN '200k–400k' ELSE '400k+' END AS money_band
  FROM outcome
), labelled AS (
  SELECT *, ['Not credited', 'Never reached', 'Low', 'Middle', 'High', 'Top'][tier_order + 1] AS tier
  FROM tiered
)
"""
_CELLS = " UNION ALL ".join(
    f"""SELECT '{c.name}' AS fit, class_year, day_seq AS x, count(*) AS n, count(*) FILTER (WHERE {c.target}) AS k
  FROM labelled WHERE eligible{" AND credited" if c.credited_only else ""} GROUP BY 2, 3"""
    for c in CURVES
)
FACT_SQL = f"""{LABELLED_SQL}, class_cells AS ({_CELLS}
), cells AS (
  SELECT fit, x, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM class_cells GROUP BY 1, 2
), {step_sql("cells", "steps")}, grid AS (
  SELECT fit, x FROM (SELECT DISTINCT fit FROM cells), range(1, {LAST_DAY + 1}) t(x)
), {between_sql("grid", "steps", "curve_points")}, published AS (
  SELECT x AS day_seq, {", ".join(f"max(p) FILTER (WHERE fit = '{c.name}') AS {c.name}" for c in CURVES)}
  FROM curve_points GROUP BY 1
), fact AS (
  SELECT labelled.*, {", ".join(c.name for c in CURVES)},
    CASE WHEN eligible AND credited THEN CAST(coalesce(reached, false) AS INTEGER) - exp_reached END AS reached_minus_exp,
    CASE WHEN eligible AND credited THEN CAST(coalesce(high, false) AS INTEGER) - exp_high END AS high_minus_exp
  FROM labelled LEFT JOIN published USING (day_seq)
)
"""
