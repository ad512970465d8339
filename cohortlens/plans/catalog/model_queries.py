"""Expected-outcome curves, residuals, scores and calibration."""

from pyspark.sql import functions as F

from cohortlens.operators import expect, quality, report, spread, stats
from cohortlens.plans.catalog.cohort_queries import MEAN_HI, MEAN_LO, METRICS
from cohortlens.plans.catalog.registry import query, r, round_columns, rounded
from cohortlens.plans.orders import (
    COLUMNS,
    FACT_SQL,
    LAST_DAY,
    between_sql,
    labelled_orders,
    order_outcomes,
    published_curves,
    step_sql,
    table,
)
from cohortlens.plans.orders import CURVES as STEP_CURVES
from cohortlens.session import cut_lineage

CURVES = expect.standard_curves(COLUMNS)


@query(
    FACT_SQL
    + """SELECT class_year, day_seq,
           count(*) FILTER (WHERE eligible AND credited) AS n_exp_mlb_signed,
           count(*) FILTER (WHERE eligible AND credited AND reached) AS k_exp_mlb_signed,
           count(*) FILTER (WHERE eligible) AS n_exp_mlb_all,
           count(*) FILTER (WHERE eligible AND reached) AS k_exp_mlb_all,
           count(*) FILTER (WHERE eligible AND credited) AS n_exp_regular_signed,
           count(*) FILTER (WHERE eligible AND credited AND high) AS k_exp_regular_signed,
           count(*) FILTER (WHERE eligible) AS n_exp_regular_all,
           count(*) FILTER (WHERE eligible AND high) AS k_exp_regular_all
         FROM fact GROUP BY 1, 2"""
)
def training_counts(spark, sf):
    return expect.training_counts(order_outcomes(spark, sf), CURVES, ["class_year", "day_seq"], COLUMNS)


@query()
def expected_curve(spark, sf):
    fact = order_outcomes(spark, sf)
    fits, last = expect.fit_curves(fact, CURVES, COLUMNS)
    return round_columns(expect.curve_table(fact, fits, last, "day_seq"), " ".join(fits), 5)


CURVE_NAMES = "exp_reached_all exp_high_all exp_reached exp_high"


@query(FACT_SQL + f"""SELECT CAST(day_seq AS INTEGER) AS day_seq, {", ".join(f"{r(c)} AS {c}" for c in CURVE_NAMES.split())} FROM published""")
def step_curves(spark, sf):
    return round_columns(published_curves(spark, sf), CURVE_NAMES)


@query(
    FACT_SQL
    + f"""SELECT order_key, class_year, day_seq, {", ".join(f"{r(c)} AS {c}" for c in CURVE_NAMES.split())},
          {r("reached_minus_exp")} AS reached_gap, {r("high_minus_exp")} AS high_gap FROM fact"""
)
def observed_minus_expected(spark, sf):
    rows = labelled_orders(spark, sf).select(
        "order_key", "class_year", "day_seq", "reached", "high", "eligible", "credited"
    )
    curves = F.broadcast(published_curves(spark, sf))  # a row a day of the year
    scored = expect.with_residuals(
        rows.join(curves, "day_seq", "left"),
        [("reached", "exp_reached", "reached_gap"), ("high", "exp_high", "high_gap")],
        COLUMNS,
    )
    out = scored.select("order_key", "class_year", "day_seq", *CURVE_NAMES.split(), "reached_gap", "high_gap")
    return round_columns(out, f"{CURVE_NAMES} reached_gap high_gap")


# At a penalised fit the gradient is nothing, and each curve has the cells it was trained on.
@query(
    FACT_SQL
    + """SELECT replace(replace(replace(replace(fit, 'exp_reached_all', 'exp_mlb_all'), 'exp_high_all', 'exp_regular_all'),
           'exp_reached', 'exp_mlb_signed'), 'exp_high', 'exp_regular_signed') AS curve, 'logistic_spline' AS method,
           count(*) AS n_cells, 7 AS n_coefficients, 0.0::DOUBLE AS largest_gradient FROM cells GROUP BY fit"""
)
def curve_stationarity(spark, sf):
    counts = expect.training_counts(labelled_orders(spark, sf), CURVES, ["day_seq"], COLUMNS)
    cells = cut_lineage(expect.curve_cells(counts, CURVES, "day_seq").filter("n > 0"))
    fits = cut_lineage(expect.solve(cells, LAST_DAY, max_rise=expect.NEVER_STEPS))
    steepest = expect.gradients(cells, fits).groupBy("fit").agg(
        rounded(F.max(F.abs("gradient")), 5).alias("largest_gradient")
    )
    sizes = cells.groupBy("fit").agg(F.count(F.lit(1)).alias("n_cells"))
    numbers = expect.coefficients(fits).groupBy("fit").agg(F.count(F.lit(1)).cast("int").alias("n_coefficients"))
    joined = fits.select("fit", "method").join(steepest, "fit").join(sizes, "fit").join(numbers, "fit")
    return joined.withColumnRenamed("fit", "curve")


@query(
    FACT_SQL
    + f"""SELECT {r("avg(x)")} AS value, {r(MEAN_LO)} AS lo, {r(MEAN_HI)} AS hi, count(x) AS n
          FROM (SELECT 100 * reached_minus_exp AS x FROM fact WHERE eligible AND credited AND region = 'ASIA')"""
)
def residual_stat(spark, sf):
    asia = order_outcomes(spark, sf).filter("region = 'ASIA'")
    return round_columns(stats.stat(asia, METRICS["mlb_vs_slot"], c=COLUMNS), "value lo hi")


@query(
    FACT_SQL
    + f""", s AS (SELECT least(greatest(exp_reached, 1e-6), 1 - 1e-6) AS p, CASE WHEN reached THEN 1.0 ELSE 0.0 END AS y
                FROM fact WHERE eligible AND credited)
      SELECT {r("avg((p - y) * (p - y))")} AS brier, {r("avg(-(y * ln(p) + (1 - y) * ln(1 - p)))")} AS log_loss FROM s"""
)
def fit_scores(spark, sf):
    rows = order_outcomes(spark, sf).filter("eligible AND credited")
    cells = rows.groupBy("exp_reached").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reached")).alias("k")
    )
    return round_columns(expect.scores(cells, "exp_reached"), "brier log_loss")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(ntile(10) OVER (
         ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS bin FROM lineitem"""
)
def equal_count_bins(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    order = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return spread.equal_count_bins(lines, order, 10)


@query(
    FACT_SQL
    + f""", b AS (SELECT ntile(10) OVER (ORDER BY floor(exp_reached * 1e9 + 0.5), order_key) AS decile, exp_reached,
                 CASE WHEN reached THEN 1.0 ELSE 0.0 END AS y FROM fact WHERE eligible AND credited)
      SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, {r("avg(exp_reached)")} AS expected, {r("avg(y)")} AS observed
      FROM b GROUP BY 1"""
)
def calibration_deciles(spark, sf):
    rows = order_outcomes(spark, sf).filter("eligible AND credited").select(
        "order_key", "reached", F.col("exp_reached").alias("pred")
    )
    return round_columns(expect.calibration(rows, "pred", "reached", ["order_key"]), "expected observed")


@query(
    FACT_SQL
    + f""", b AS (SELECT ntile(10) OVER (ORDER BY exp_reached, order_key) AS decile, exp_reached,
                 CASE WHEN reached THEN 1.0 ELSE 0.0 END AS y FROM fact WHERE eligible AND credited),
        d AS (SELECT decile, avg(exp_reached) AS expected, avg(y) AS observed FROM b GROUP BY 1)
      SELECT {r("max(abs(observed - expected))")} AS worst_gap FROM d"""
)
def worst_calibration_gap(spark, sf):
    rows = order_outcomes(spark, sf).filter("eligible AND credited").select(
        "order_key", "reached", F.col("exp_reached").alias("pred")
    )
    deciles = expect.calibration(rows, "pred", "reached", ["order_key"])
    return round_columns(report.worst_gap(deciles), "worst_gap")


#: Step fits of every curve on all classes but one, read off at the cells of that one.
HELD_OUT_SQL = FACT_SQL + f""", folds AS (SELECT DISTINCT fit, class_year FROM class_cells
), rest AS (
  SELECT f.fit || '|' || f.class_year AS fit, c.x, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k
  FROM folds f JOIN class_cells c ON c.fit = f.fit AND c.class_year <> f.class_year GROUP BY 1, 2
), {step_sql("rest", "held_steps")}, held_cells AS (
  SELECT fit || '|' || class_year AS fit, x, fit AS curve, class_year, n, k FROM class_cells
), {between_sql("held_cells", "held_steps", "held_points")}, held AS (
  SELECT curve, class_year, x AS day_seq, n, k, coalesce(p, 0.0) AS pred FROM held_points
)
"""


def _step_evaluation(spark, sf):
    return expect.evaluate(order_outcomes(spark, sf), STEP_CURVES, COLUMNS, max_rise=expect.ALWAYS_STEPS)


@query(HELD_OUT_SQL + f"SELECT curve, class_year, day_seq, n, k, {r('pred')} AS pred FROM held")
def leave_one_class_out(spark, sf):
    counts = cut_lineage(
        expect.training_counts(order_outcomes(spark, sf), STEP_CURVES, ["class_year", "day_seq"], COLUMNS)
    )
    held_out = expect.leave_one_out(
        counts, STEP_CURVES, LAST_DAY, fold="class_year", x="day_seq", max_rise=expect.ALWAYS_STEPS
    )
    return round_columns(held_out, "pred")


DECILE_SQL = HELD_OUT_SQL + f""", inside AS ({" UNION ALL ".join(
    f"SELECT '{c.name}' AS curve, class_year, day_seq, order_key, coalesce({c.target}, false) AS y FROM labelled "
    f"WHERE eligible{' AND credited' if c.credited_only else ''}" for c in STEP_CURVES)}
), binned AS (
  SELECT curve, pred, y, ntile(10) OVER (PARTITION BY curve ORDER BY round(pred, 12), order_key) AS decile
  FROM inside JOIN held USING (curve, class_year, day_seq)
), deciles AS (
  SELECT curve, CAST(decile AS INTEGER) AS decile, count(*) AS n, avg(pred) AS expected,
    avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS observed FROM binned GROUP BY 1, 2
)
"""


def _deciles(spark, sf):
    held_out = cut_lineage(_step_evaluation(spark, sf).held_out)
    return expect.held_out_deciles(order_outcomes(spark, sf), held_out, STEP_CURVES, ["order_key"], COLUMNS)


@query(DECILE_SQL + f"SELECT curve, decile, n, {r('expected')} AS expected, {r('observed')} AS observed FROM deciles")
def held_out_deciles(spark, sf):
    return round_columns(_deciles(spark, sf), "expected observed")


@query(
    DECILE_SQL
    + """, w AS (SELECT *, (expected + 2.706025 / (2 * n)) / (1 + 2.706025 / n) AS centre,
           1.645 * sqrt(expected * (1 - expected) / n + 2.706025 / (4 * n * n)) / (1 + 2.706025 / n) AS half FROM deciles),
         found AS (SELECT count(*) FILTER (WHERE observed NOT BETWEEN centre - half AND centre + half) AS bad FROM w)
       SELECT 'slot_model_calibrated' AS name, 'model' AS category, CASE WHEN bad > 0 THEN 'warn' ELSE 'pass' END AS status,
         CAST(bad AS DOUBLE) AS value, 0.0::DOUBLE AS threshold FROM found"""
)
def held_out_calibration(spark, sf):
    return quality.calibration_result(_deciles(spark, sf)).drop("detail")


@query(DECILE_SQL + f"SELECT curve, {r('max(abs(observed - expected))')} AS worst_gap FROM deciles GROUP BY 1")
def worst_held_out_gap(spark, sf):
    return round_columns(report.worst_gap(_deciles(spark, sf), by=["curve"]), "worst_gap")


@query(
    FACT_SQL
    + """, long AS (SELECT fit, x, p - min(p) OVER (PARTITION BY fit ORDER BY x ROWS UNBOUNDED PRECEDING) AS rise FROM curve_points)
       SELECT 'slot_curve_monotone' AS name, 'model' AS category,
         CASE WHEN count(*) FILTER (WHERE rise > 0.005) > 0 THEN 'fail' ELSE 'pass' END AS status,
         CAST(count(*) FILTER (WHERE rise > 0.005) AS DOUBLE) AS value, 0.0::DOUBLE AS threshold FROM long"""
)
def fitted_curve_monotone(spark, sf):
    return quality.monotone_result(published_curves(spark, sf), "day_seq", CURVE_NAMES.split()).drop("detail")


@query(
    FACT_SQL
    + f"""SELECT fit AS curve, CAST(x AS INTEGER) AS position, {r("p")} AS expected FROM curve_points
          WHERE x IN ({", ".join(map(str, expect.REPORT_POSITIONS))})"""
)
def expected_at_positions(spark, sf):
    return round_columns(_step_evaluation(spark, sf).at_positions(), "expected")


@query(
    HELD_OUT_SQL
    + f""", sizes AS (SELECT fit, sum(n) AS size, sum(k) / sum(n) AS base FROM cells GROUP BY 1
), scored AS (
  SELECT fit AS curve, 'baseline' AS scored, n, k, base AS p FROM cells JOIN sizes USING (fit)
  UNION ALL SELECT fit, 'in_sample', n, k, p FROM cells JOIN steps USING (fit, x)
  UNION ALL SELECT curve, 'leave_one_class_out', n, k, pred FROM held
), kept AS (SELECT * REPLACE (least(greatest(p, 1e-6), 1 - 1e-6) AS p) FROM scored)
SELECT curve, 'isotonic' AS method, CAST(any_value(size) AS BIGINT) AS n, round(any_value(base), 4) AS base_rate, scored,
  round(sum(k * (1 - p) * (1 - p) + (n - k) * p * p) / sum(n), 5) AS brier,
  round(-sum(k * ln(p) + (n - k) * ln(1 - p)) / sum(n), 5) AS log_loss
FROM kept JOIN sizes ON sizes.fit = curve GROUP BY curve, scored"""
)
def step_fit_report(spark, sf):
    return _step_evaluation(spark, sf).report


@query()
def fit_report(spark, sf):
    return expect.evaluate(order_outcomes(spark, sf), CURVES, COLUMNS).report
