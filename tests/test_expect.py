"""Curve fits against a dense solver, and the scores, guards and bins around them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import expect
from cohortlens.operators.cohort import OutcomeColumns

C = OutcomeColumns()


def _draws(n_classes=6, last=400, seed=3, bump=0.0):
    rng = random.Random(seed)
    out = []
    for year in range(2012, 2012 + n_classes):
        for pick in range(1, last + 1):
            p = 1 / (1 + math.exp(-(2.5 - 0.9 * math.log(pick))))
            p += bump if pick > last * 0.75 else 0.0
            out.append((year, pick, rng.random() < p))
    return out


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(5)
    rows = [
        (y, x, y <= 2017 and rng.random() > 0.05, rng.random() > 0.1, hit, hit and rng.random() < 0.4)
        for y, x, hit in _draws(7)
    ]
    return spark.createDataFrame(
        rows,
        "draft_year int, pick_number int, outcome_eligible boolean, signed boolean, "
        "reached_mlb boolean, became_regular boolean",
    )


def _counts(spark, draws):
    cells = {}
    for _, x, hit in draws:
        n, k = cells.get(x, (0, 0))
        cells[x] = (n + 1, k + hit)
    return spark.createDataFrame([(x, n, k) for x, (n, k) in cells.items()], "x int, n int, k int")


def _basis(x, low, high):
    """Cox-de Boor on uniform knots, the definition the column form must agree with."""
    step = (high - low) / 3
    knots = [low + (i - 3) * step for i in range(10)]
    z = np.clip(np.log(x), low, high - 1e-12)  # the last piece includes its end
    out = [np.where((z >= knots[i]) & (z < knots[i + 1]), 1.0, 0.0) for i in range(9)]
    for d in range(1, 4):
        out = [
            (z - knots[i]) / (knots[i + d] - knots[i]) * out[i]
            + (knots[i + d + 1] - z) / (knots[i + d + 1] - knots[i + 1]) * out[i + 1]
            for i in range(9 - d)
        ]
    return np.stack(out, axis=1)


def _dense_fit(x, y, grid):
    low, high = np.log(x).min(), np.log(x).max()
    design = np.hstack([np.ones((len(x), 1)), _basis(x, low, high)])
    ridge = np.diag([0.0] + [1 / 10.0] * 6)
    beta = np.zeros(7)
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(
            design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta
        )
    return 1 / (1 + np.exp(-np.hstack([np.ones((len(grid), 1)), _basis(grid, low, high)]) @ beta))


def test_basis_agrees_with_its_definition_and_sums_to_one(spark):
    df = spark.range(1, 300).select(F.col("id").alias("x"))
    low, high = math.log(3), math.log(200)
    columns = expect.spline_basis(F.log("x"), F.lit(low), F.lit(high))
    got = np.array(df.orderBy("x").select(*columns).collect())
    assert np.allclose(got, _basis(np.arange(1.0, 300.0), low, high), atol=1e-9)
    assert np.allclose(got.sum(axis=1), 1.0)


def test_weighted_fit_equals_a_dense_solver(spark):
    draws = _draws()
    fit = expect.fit_curve(_counts(spark, draws), 400)
    assert fit.method == "logistic_spline"
    curve = [r["p"] for r in fit.predict(expect.position_grid(_counts(spark, draws), 400), "x", "p").orderBy("x").collect()]
    x = np.array([d[1] for d in draws], dtype=float)
    y = np.array([d[2] for d in draws], dtype=float)
    assert np.allclose(curve, _dense_fit(x, y, np.arange(1.0, 401.0)), atol=1e-7)


def test_many_draws_recover_the_true_curve(spark):
    counts = _counts(spark, _draws(n_classes=60))
    fit = expect.fit_curve(counts, 400)
    curve = [r["p"] for r in fit.predict(expect.position_grid(counts, 400), "x", "p").orderBy("x").collect()]
    truth = 1 / (1 + np.exp(-(2.5 - 0.9 * np.log(np.arange(1, 401)))))
    assert np.abs(np.array(curve)[20:] - truth[20:]).max() < 0.03


def test_a_climbing_curve_becomes_a_decreasing_step_fit(spark):
    draws = _draws(bump=0.4)
    counts = _counts(spark, draws)
    fit = expect.fit_curve(counts, 400)
    assert fit.method == "isotonic"
    grid = fit.predict(expect.position_grid(counts, 400), "x", "p").orderBy("x")
    got = np.array([r["p"] for r in grid.collect()])
    assert (np.diff(got) <= 1e-12).all()
    cells = sorted((r["x"], r["k"] / r["n"], r["n"]) for r in counts.collect())
    blocks = []
    for _, rate, weight in cells:  # pool adjacent violators
        blocks.append([rate * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] < blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    want = np.concatenate([[s / w] * m for s, w, m in blocks])
    assert np.allclose(got, want)


@pytest.mark.parametrize(("hits", "mean"), [(0, 0.0), (3, 1.0)])
def test_one_outcome_only_is_a_constant(spark, hits, mean):
    counts = spark.createDataFrame([(1, 3, hits), (2, 3, hits)], "x int, n int, k int")
    fit = expect.fit_curve(counts, 5)
    assert (fit.method, fit.mean) == ("constant", mean)


def test_no_training_rows(spark):
    assert expect.fit_curve(spark.createDataFrame([], "x int, n int, k int"), 5).mean == 0.0


def test_curves_and_residuals(fact):
    fits, last = expect.fit_curves(fact)
    assert set(fits) == {s.name for s in expect.standard_curves()} and last == 400
    curve = expect.curve_table(fact, fits, last, "pick_number")
    assert curve.count() == 400
    assert expect.curve_rises(curve, "pick_number", list(fits)).count() == 0
    scored = expect.with_residuals(
        expect.with_expected(fact, fits), [("reached_mlb", "exp_mlb_signed", "mlb_minus_exp")]
    )
    inside = scored.filter("outcome_eligible AND signed")
    assert scored.filter("NOT (outcome_eligible AND signed) AND mlb_minus_exp IS NOT NULL").count() == 0
    assert abs(inside.agg(F.avg("mlb_minus_exp")).first()[0]) < 0.01


def test_scores_match_their_definition(spark):
    cells = spark.createDataFrame([(4, 1, 0.25), (2, 2, 1.0), (3, 0, 0.0)], "n int, k int, p double")
    got = expect.scores(cells, "p").first()
    y = [1, 0, 0, 0, 1, 1, 0, 0, 0]
    p = np.clip([0.25] * 4 + [1.0] * 2 + [0.0] * 3, 1e-6, 1 - 1e-6)
    assert got["brier"] == pytest.approx(np.mean((p - y) ** 2))
    assert got["log_loss"] == pytest.approx(-np.mean(np.log(np.where(np.array(y) == 1, p, 1 - p))))


def test_left_out_classes_are_predicted_by_the_others(fact, spark):
    specs = expect.standard_curves()[:1]
    counts = expect.training_counts(fact, specs, ["draft_year", "pick_number"])
    held = expect.leave_one_out(counts, specs, 400, fold="draft_year", x="pick_number")
    rows = fact.filter("outcome_eligible AND signed").collect()
    x = np.array([r["pick_number"] for r in rows if r["draft_year"] != 2014], dtype=float)
    y = np.array([r["reached_mlb"] for r in rows if r["draft_year"] != 2014], dtype=float)
    got = held.filter("draft_year = 2014").orderBy("pick_number").collect()
    grid = np.array([r["pick_number"] for r in got], dtype=float)
    assert np.allclose([r["pred"] for r in got], _dense_fit(x, y, grid), atol=1e-7)


def test_evaluation_report(fact):
    specs = expect.standard_curves()[:1]
    result = expect.evaluate(fact, specs)
    report = {r["scored"]: r for r in result.report.collect()}
    n = fact.filter("outcome_eligible AND signed").count()
    assert set(report) == {"baseline", "in_sample", "leave_one_class_out"}
    assert report["in_sample"]["n"] == n
    assert report["in_sample"]["brier"] < report["baseline"]["brier"]
    assert report["in_sample"]["log_loss"] <= report["leave_one_class_out"]["log_loss"]
    grain = ["draft_year", "pick_number"]
    deciles = expect.held_out_deciles(fact, result.held_out, specs, grain).orderBy("decile").collect()
    assert [d["decile"] for d in deciles] == list(range(1, 11)) and sum(d["n"] for d in deciles) == n
    expected = [d["expected"] for d in deciles]
    assert expected == sorted(expected)
    assert {r["position"] for r in result.at_positions().collect()} == {1, 10, 30, 100, 300}


def test_gradients_vanish_at_the_fits_and_nowhere_else(spark):
    counts = _counts(spark, _draws())
    cells = counts.withColumn("fit", F.lit("one"))
    fits = expect.solve(cells, 400)
    assert fits.first()["method"] == "logistic_spline"
    at_fit = [abs(r["gradient"]) for r in expect.gradients(cells, fits).collect()]
    assert len(at_fit) == 7 and max(at_fit) < 1e-6
    moved = fits.withColumn("beta", F.transform("beta", lambda b: b + 0.01))
    assert max(abs(r["gradient"]) for r in expect.gradients(cells, moved).collect()) > 0.1
    assert expect.coefficients(fits).count() == 7


def test_pooling_parts_first_gives_the_same_blocks():
    rng = random.Random(8)
    for _ in range(200):
        cells = [(rng.randint(0, w), w, x, x) for x, w in enumerate(rng.randint(1, 6) for _ in range(rng.randint(1, 30)))]
        cut = sorted(rng.sample(range(len(cells) + 1), 2)) if len(cells) > 1 else [0, 1]
        parts = [cells[: cut[0]], cells[cut[0] : cut[1]], cells[cut[1] :]]
        merged = expect.pooled([b for p in parts for b in expect.pooled(p)])
        assert merged == expect.pooled(cells)
        rates = [h / w for h, w, _, _ in merged]
        assert rates == sorted(rates, reverse=True)


def test_steps_between_positions_are_interpolated(spark):
    cells = spark.createDataFrame([("a", 2, 4, 3), ("a", 4, 4, 1)], "fit string, x int, n int, k int")
    fits = expect.solve(cells, 5, max_rise=expect.ALWAYS_STEPS)
    curve = {r["x"]: r["p"] for r in expect.curve_points(fits, 5).collect()}
    assert curve == {1: 0.75, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0.25}
    fit = expect.fit_many(cells, 5, max_rise=expect.ALWAYS_STEPS)["a"]
    rows = fit.predict(expect.position_grid(cells, 5), "x", "p").collect()
    assert {r["x"]: r["p"] for r in rows} == curve


def test_a_fit_that_overshoots_still_converges(spark):
    # nearly separable: full Newton steps from zero run away
    cells = [(x, 1000, 1000 if x < 20 else 0) for x in range(1, 40)] + [(40, 1000, 1)]
    counts = spark.createDataFrame([("one", *c) for c in cells], "fit string, x int, n int, k int")
    fits = expect.solve(counts, 40, max_rise=expect.NEVER_STEPS)
    assert max(abs(r["gradient"]) for r in expect.gradients(counts, fits).collect()) < 1e-4


def test_bins_within_groups_of_any_size(spark):
    from cohortlens.operators import spread

    rng = random.Random(4)
    rows = [(g, rng.random(), i) for i, g in enumerate(rng.choices(["a", "b", None, "c"], [60, 30, 9, 1], k=1000))]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(5)
    got = spread.bins_within(df, ["g"], ["v", "i"], 10).collect()
    for g in ("a", "b", None, "c"):
        ranked = sorted((r["v"], r["i"], r["bin"]) for r in got if r["g"] == g)
        want = [b + 1 for b, part in enumerate(np.array_split(np.arange(len(ranked)), 10)) for _ in part]
        assert [b for _, _, b in ranked] == want
