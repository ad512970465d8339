"""Expected outcome by position: weighted spline fits, a monotone fallback, and their scores.

Every fit reads (position, rows, hits) counts, so the training data is one reduction of the fact
table however many rows it has. All curves and all left-out classes are fitted in one grouped job: a
group holds one cell per position of one fit. Fits are a relation, so predictions, scores and the
penalised gradient are joins and aggregations over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.casts import is_true, null_if
from cohortlens.operators.cohort import OutcomeColumns, Rules, in_population
from cohortlens.operators.spread import FEW_KEYS, bins_within, equal_count_bins, lookup_join, rise_over_running_min
from cohortlens.session import cut_lineage

# Fixed values of the model.
KNOTS = 4
INVERSE_PENALTY = 10.0
MAX_RISE = 0.005
CLIP = 1e-6
N_BINS = 10
REPORT_POSITIONS = (1, 10, 30, 100, 300, 1000)

BASIS = KNOTS + 2  # cubic pieces over KNOTS uniform knots
MAX_STEPS = 200
STEP_TOLERANCE = 1e-10
#: A guard that every curve breaks, so that all fits are step fits, and one that none does.
ALWAYS_STEPS, NEVER_STEPS = -1.0, float("inf")


@dataclass(frozen=True)
class CurveSpec:
    """One expected-outcome curve: which outcome, over credited rows only or all eligible."""

    name: str
    target: str
    credited_only: bool


def standard_curves(c: OutcomeColumns | None = None) -> list[CurveSpec]:
    c = c or OutcomeColumns()
    return [
        CurveSpec("exp_mlb_signed", c.reached, True),
        CurveSpec("exp_mlb_all", c.reached, False),
        CurveSpec("exp_regular_signed", c.high, True),
        CurveSpec("exp_regular_all", c.high, False),
    ]


def training_counts(
    df: DataFrame, specs: Sequence[CurveSpec], by: Sequence[str], c: OutcomeColumns | None = None
) -> DataFrame:
    """Rows and hits per key and curve (``n_<curve>``, ``k_<curve>``) in one pass."""
    aggs = []
    for s in specs:
        inside = in_population(Rules(count_uncredited=not s.credited_only), c)
        aggs += [
            F.count_if(inside).alias(f"n_{s.name}"),
            F.count_if(inside & is_true(F.col(s.target))).alias(f"k_{s.name}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def spline_basis(z: Column, low: Column, high: Column) -> list[Column]:
    """Uniform cubic B-spline values of ``z``, constant beyond [low, high].

    Each basis function is the cardinal cubic bump moved to its own knot.
    """
    cells = KNOTS - 1
    u = (F.least(F.greatest(z, low), high) - low) / ((high - low) / cells)

    def bump(v: Column) -> Column:
        far = F.abs(v - 2)
        near = (4 - 6 * far * far + 3 * far * far * far) / 6
        edge = (2 - far) * (2 - far) * (2 - far) / 6
        return F.when(far < 1, near).when(far < 2, edge).otherwise(F.lit(0.0))

    return [bump(u - j + 3) for j in range(BASIS)]


@dataclass(frozen=True)
class Fit:
    """A fitted curve: a constant, a spline on log(position), or a decreasing step fit."""

    method: str
    mean: float = 0.0
    low: float = 0.0
    high: float = 1.0
    beta: tuple[float, ...] = (0.0,) * (BASIS + 1)
    steps: tuple[tuple[float, float, float], ...] = ()

    def predict(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Adds the curve's probability in place."""
        first, last, value = zip(*self.steps, strict=True) if self.steps else ((), (), ())
        steps = F.arrays_zip(
            *[F.lit(list(map(float, v))).cast("array<double>").alias(c)
              for c, v in (("first", first), ("last", last), ("value", value))]
        )
        p = _at(
            F.lit(self.method), F.lit(self.mean), F.lit(self.low), F.lit(self.high),
            [F.lit(b) for b in self.beta], steps, F.col(x).cast("double"),
        )
        return df.withColumn(out, p)


#: The relation of fits, one row each. A step stands for the positions first to last.
FITS = (
    "fit string, method string, mean double, low double, high double, beta array<double>, "
    "steps array<struct<first:double,last:double,value:double>>"
)


def _at(
    method: Column, mean: Column, low: Column, high: Column, beta: Sequence[Column], steps: Column, x: Column
) -> Column:
    """A fit's probability at position ``x``."""
    spline = 1 / (1 + F.exp(-_score(beta, spline_basis(F.log(x), low, high))))
    left = F.try_element_at(F.filter(steps, lambda s: s["first"] <= x), F.lit(-1))
    right = F.try_element_at(F.filter(steps, lambda s: s["last"] >= x), F.lit(1))
    between = left["value"] + (right["value"] - left["value"]) * (
        (x - left["last"]) / (right["first"] - left["last"])
    )
    step = (
        F.when(left.isNull(), right["value"])
        .when(right.isNull() | (left["last"] >= x), left["value"])
        .otherwise(between)
    )
    return F.when(method == "constant", mean).when(method == "isotonic", step).otherwise(spline)


def _score(beta: Sequence[Column], basis: Sequence[Column]) -> Column:
    out = beta[0]
    for w, b in zip(beta[1:], basis, strict=True):
        out = out + w * b
    return out


def solve(cells: DataFrame, last: int, *, max_rise: float = MAX_RISE) -> DataFrame:
    """The relation of fits (see ``FITS``), one per value of ``fit`` in (fit, x, n, k) cells.

    A penalised logistic curve over a spline of log(x); when it climbs more than ``max_rise`` above an
    earlier value anywhere on 1..last, a decreasing step fit instead; the plain mean when there is only
    one outcome or one position. Fits without rows are left out.
    """
    once = cells.filter("n > 0").groupBy("fit", F.col("x").cast("double").alias("x")).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")
    )
    schema = pa.schema(
        [
            ("fit", pa.string()), ("method", pa.string()), *[(c, pa.float64()) for c in ("mean", "low", "high")],
            ("beta", pa.list_(pa.float64())),
            ("steps", pa.list_(pa.struct([(c, pa.float64()) for c in ("first", "last", "value")]))),
        ]
    )

    def fit(group: pa.Table) -> pa.Table:
        x, n, k = (group.column(c).to_numpy().astype(float) for c in "xnk")
        order = np.argsort(x)
        made = fit_cells(x[order], n[order], k[order], last, max_rise)
        steps = [dict(zip(("first", "last", "value"), s, strict=True)) for s in made.steps]
        row = {
            "fit": group.column("fit")[0].as_py(), "method": made.method, "mean": made.mean,
            "low": made.low, "high": made.high, "beta": list(made.beta), "steps": steps,
        }
        return pa.Table.from_pylist([row], schema=schema)

    return once.groupBy("fit").applyInArrow(fit, FITS)


def fit_cells(x: np.ndarray, n: np.ndarray, k: np.ndarray, last: int, max_rise: float) -> Fit:
    """The fit of one curve's cells, one per position in ascending order."""
    mean = float(k.sum() / n.sum())
    if k.sum() in (0, n.sum()) or len(x) == 1:
        return Fit("constant", mean=mean)
    low, high = float(np.log(x[0])), float(np.log(x[-1]))
    beta = _penalised(_design(x, low, high), n, k)
    grid = _design(np.arange(1.0, last + 1), low, high) @ beta
    curve = 1 / (1 + np.exp(-grid))
    if last and np.max(curve - np.minimum.accumulate(curve)) > max_rise:
        blocks = pooled([(b, w, at, at) for b, w, at in zip(k, n, x, strict=True)])
        return Fit("isotonic", mean, low, high, steps=tuple((f, t, b / w) for b, w, f, t in blocks))
    return Fit("logistic_spline", mean, low, high, tuple(beta.tolist()))


def _design(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """A column of ones and the spline basis, as in ``spline_basis``."""
    u = (np.clip(np.log(x), low, high) - low) / ((high - low) / (KNOTS - 1))
    far = np.abs(u[:, None] - np.arange(BASIS) + 1)
    bump = np.where(far < 1, (4 - 6 * far**2 + 3 * far**3) / 6, np.clip(2 - far, 0, None) ** 3 / 6)
    return np.hstack([np.ones((len(x), 1)), bump])


def _penalised(design: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Coefficients of least penalised loss by damped Newton steps; the intercept is not penalised."""
    ridge = np.full(design.shape[1], 1 / INVERSE_PENALTY)
    ridge[0] = 0.0

    def loss(beta: np.ndarray) -> float:
        s = design @ beta
        return float((n * np.logaddexp(0, s) - k * s).sum() + 0.5 * ridge @ (beta * beta))

    beta = np.zeros(design.shape[1])
    for _ in range(MAX_STEPS):
        p = 1 / (1 + np.exp(-(design @ beta)))
        gradient = design.T @ (k - n * p) - ridge * beta
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), gradient)
        here, size = loss(beta), 1.0
        while loss(beta + size * step) > here + 1e-12 * abs(here) and size > 1e-9:
            size /= 2
        beta = beta + size * step
        if np.max(np.abs(size * step)) < STEP_TOLERANCE:
            break
    return beta


def pooled(blocks: Iterable[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Blocks (hits, rows, first, last) in order, pooled until their rates do not rise.

    Pooling parts of a series first and their blocks after that gives the same blocks.
    """
    stack: list[tuple[float, float, float, float]] = []
    for hits, rows, first, last in blocks:
        while stack and stack[-1][0] * rows < hits * stack[-1][1]:
            before = stack.pop()
            hits, rows, first = hits + before[0], rows + before[1], before[2]
        stack.append((hits, rows, first, last))
    return stack


def predict_with(rows: DataFrame, fits: DataFrame, x: str, out: str) -> DataFrame:
    """Adds the probability of the fit that each row names in ``fit``; 0 where no row trained it."""
    renamed = fits.select("fit", *[F.col(c).alias(f"_{c}") for c in fits.columns[1:]])
    beta = [F.col("_beta")[j] for j in range(BASIS + 1)]
    p = _at(
        F.col("_method"), F.col("_mean"), F.col("_low"), F.col("_high"), beta, F.col("_steps"),
        F.col(x).cast("double"),
    )
    joined = rows.join(renamed, "fit", "left")
    return joined.select(*rows.columns, F.coalesce(p, F.lit(0.0)).alias(out))


def coefficients(fits: DataFrame) -> DataFrame:
    """(fit, j, beta, low, high) of the spline fits, the intercept first."""
    splines = fits.filter("method = 'logistic_spline'")
    return splines.select("fit", F.posexplode("beta").alias("j", "beta"), "low", "high")


def gradients(cells: DataFrame, fits: DataFrame) -> DataFrame:
    """(fit, j, gradient) of the penalised log likelihood at each spline fit's coefficients.

    An aggregation over the cells that shares nothing with the solver: at a fit it is 0 everywhere.
    """
    splines = fits.filter("method = 'logistic_spline'").select("fit", "low", "high", "beta")
    at = cells.join(splines, "fit")
    basis = [F.lit(1.0), *spline_basis(F.log(F.col("x").cast("double")), F.col("low"), F.col("high"))]
    p = 1 / (1 + F.exp(-_score([F.col("beta")[j] for j in range(BASIS + 1)], basis[1:])))
    left = at.select("fit", "beta", (F.col("k") - F.col("n") * p).alias("_left"), F.array(*basis).alias("_basis"))
    sums = [F.sum(F.col("_left") * F.col("_basis")[j]).alias(f"g{j}") for j in range(BASIS + 1)]
    summed = left.groupBy("fit", "beta").agg(*sums)
    parts = [
        F.struct(
            F.lit(j).alias("j"),
            (F.col(f"g{j}") - (F.col("beta")[j] / INVERSE_PENALTY if j else F.lit(0.0))).alias("gradient"),
        )
        for j in range(BASIS + 1)
    ]
    return summed.select("fit", F.explode(F.array(*parts)).alias("g")).select("fit", "g.j", "g.gradient")


def fit_many(cells: DataFrame, last: int, *, max_rise: float = MAX_RISE) -> dict[str, Fit]:
    """The fits by name; for a few curves, each a row of the relation."""
    return {
        r["fit"]: Fit(
            r["method"], r["mean"], r["low"], r["high"], tuple(r["beta"]), tuple(map(tuple, r["steps"]))
        )
        for r in solve(cells, last, max_rise=max_rise).collect()
    }


def curve_points(fits: DataFrame, last: int) -> DataFrame:
    """(fit, x, p) of every fit at every position 1..last."""
    grid = fits.select("fit", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("x"))
    return predict_with(grid, fits, "x", "p")


def fit_curve(counts: DataFrame, last: int, *, x: str = "x", n: str = "n", k: str = "k") -> Fit:
    """One fit from (x, n, k) counts."""
    cells = counts.select(
        F.lit("one").alias("fit"), F.col(x).alias("x"), F.col(n).alias("n"), F.col(k).alias("k")
    )
    return fit_many(cells, last).get("one", Fit("constant"))


def curve_cells(counts: DataFrame, specs: Sequence[CurveSpec], x: str) -> DataFrame:
    """Wide counts per position as long (fit, x, n, k) cells, one fit per curve."""
    long = counts.select(F.col(x).alias("x"), F.explode(_curve_entries(specs)).alias("e"))
    return long.select(F.col("e.curve").alias("fit"), "x", "e.n", "e.k")


def position_grid(df: DataFrame, last: int, x: str = "x") -> DataFrame:
    return df.sparkSession.range(1, last + 1).select(F.col("id").alias(x))


def fit_curves(
    df: DataFrame, specs: Sequence[CurveSpec] | None = None, c: OutcomeColumns | None = None
) -> tuple[dict[str, Fit], int]:
    """A fit per curve, and the last position of the grid (highest in any row)."""
    c = c or OutcomeColumns()
    specs = specs or standard_curves(c)
    counts = cut_lineage(training_counts(df, specs, [c.sequence], c))
    last = counts.agg(F.max(c.sequence)).first()[0]
    fits = fit_many(curve_cells(counts, specs, c.sequence), last)
    return {s.name: fits.get(s.name, Fit("constant")) for s in specs}, last


def curve_table(df: DataFrame, fits: dict[str, Fit], last: int, x: str) -> DataFrame:
    """One row per position 1..last with every curve's value."""
    out = position_grid(df, last, x)
    for name, fit in fits.items():
        out = fit.predict(out, x, name)
    return out


def with_expected(df: DataFrame, fits: dict[str, Fit], c: OutcomeColumns | None = None) -> DataFrame:
    """Every curve's value per row, computed in place: no join, no shuffle."""
    c = c or OutcomeColumns()
    for name, fit in fits.items():
        df = fit.predict(df, c.sequence, name)
    return df


def with_residuals(
    df: DataFrame, pairs: Sequence[tuple[str, str, str]], c: OutcomeColumns | None = None
) -> DataFrame:
    """(target, expected, out): observed minus expected on credited outcome rows, else null."""
    scored = in_population(Rules(), c)
    return df.withColumns(
        {
            out: F.when(scored, is_true(F.col(target)).cast("double") - F.col(expected))
            for target, expected, out in pairs
        }
    )


def scores(
    cells: DataFrame, p: str | Column, n: str = "n", k: str = "k", by: Sequence[str] = ()
) -> DataFrame:
    """Brier score and log loss of predictions over (n, k) cells, probabilities kept off 0 and 1."""
    raw = F.col(p) if isinstance(p, str) else p
    prob = F.least(F.greatest(raw, F.lit(CLIP)), F.lit(1 - CLIP))
    hit, miss = F.col(k), F.col(n) - F.col(k)
    size = null_if(F.sum(n), 0)
    brier = F.sum(hit * (1 - prob) * (1 - prob) + miss * prob * prob) / size
    loss = -F.sum(hit * F.log(prob) + miss * F.log(1 - prob)) / size
    return cells.groupBy(*by).agg(brier.alias("brier"), loss.alias("log_loss"))


def leave_one_out(
    counts: DataFrame, specs: Sequence[CurveSpec], last: int, *, fold: str, x: str, out: str = "pred",
    max_rise: float = MAX_RISE,
) -> DataFrame:
    """Each class's cells predicted by curves fitted on all other classes: (curve, fold, x, n, k).

    ``counts`` holds one row per (fold, x) with the counts of every curve. All fits are solved
    in one job. Where no other class had rows the prediction is 0.
    """
    long, cells = _held_out_cells(counts, specs, fold, x)
    return _predict_held_out(long, solve(cells, last, max_rise=max_rise), fold, x, out)


def _held_out_cells(
    counts: DataFrame, specs: Sequence[CurveSpec], fold: str, x: str
) -> tuple[DataFrame, DataFrame]:
    """Cells per (fold, curve), and the training cells of each fit: all cells less the fold's own."""
    long = (
        counts.select(fold, F.col(x).alias("x"), F.explode(_curve_entries(specs)).alias("e"))
        .select(fold, "x", "e.curve", "e.n", "e.k")
        .filter("n > 0")
    )
    total = long.groupBy("curve", "x").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    folds = long.select("curve", fold).distinct()
    own = long.groupBy("curve", fold, "x").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rest = total.join(folds, "curve").join(own, ["curve", fold, "x"], "left").select(
        _fit_name(F.col(fold)).alias("fit"),
        "x",
        (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"),
        (F.col("all_k") - F.coalesce("k", F.lit(0))).alias("k"),
    )
    return long, rest.filter("n > 0")


def _fit_name(held: Column) -> Column:
    return F.concat_ws("|", "curve", held.cast("string"))


def _predict_held_out(long: DataFrame, fits: DataFrame, fold: str, x: str, out: str) -> DataFrame:
    named = long.withColumn("fit", _fit_name(F.col(fold)))
    return predict_with(named, fits, "x", out).select("curve", fold, F.col("x").alias(x), "n", "k", out)


def _curve_entries(specs: Sequence[CurveSpec]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("curve"), F.col(f"n_{s.name}").alias("n"), F.col(f"k_{s.name}").alias("k")
            )
            for s in specs
        ]
    )


def calibration(
    rows: DataFrame, pred: str, y: str, tie_break: Sequence[str], n_bins: int = N_BINS
) -> DataFrame:
    """Expected and observed rate in equal-count bins of the prediction, lowest first."""
    binned = equal_count_bins(rows.select(pred, y, *tie_break), [pred, *tie_break], n_bins, "decile")
    return binned.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(pred).alias("expected"),
        F.avg(F.col(y).cast("double")).alias("observed"),
    )


@dataclass(frozen=True)
class Evaluation:
    """Fit quality per curve, the held-out predictions of every cell, and the fits."""

    report: DataFrame
    held_out: DataFrame
    fits: DataFrame
    last: int

    def at_positions(self, positions: Sequence[int] = REPORT_POSITIONS) -> DataFrame:
        """(curve, position, expected) at those of the positions that the grid has."""
        listed = F.array(*[F.lit(p) for p in positions if p <= self.last]).cast("array<int>")
        grid = self.fits.select("fit", F.explode(listed).alias("position"))
        values = predict_with(grid, self.fits, "position", "expected")
        return values.select(F.col("fit").alias("curve"), "position", "expected")


def evaluate(
    df: DataFrame,
    specs: Sequence[CurveSpec] | None = None,
    c: OutcomeColumns | None = None,
    *,
    max_rise: float = MAX_RISE,
) -> Evaluation:
    """Scores each curve against a constant, in sample and with every class left out in turn.

    Full and held-out fits are solved in one job, and all scores are one aggregation.
    """
    c = c or OutcomeColumns()
    specs = list(specs or standard_curves(c))
    by_class = cut_lineage(training_counts(df, specs, [c.period, c.sequence], c))
    last = by_class.agg(F.max(c.sequence)).first()[0] or 0
    cells = curve_cells(by_class, specs, c.sequence).groupBy("fit", "x").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")
    )
    long, held_cells = _held_out_cells(by_class, specs, c.period, c.sequence)
    solved = cut_lineage(solve(cells.unionByName(held_cells), last, max_rise=max_rise))
    fits = solved.filter(F.col("fit").isin([s.name for s in specs]))
    held_out = _predict_held_out(long, solved, c.period, c.sequence, "pred")

    totals = cells.groupBy("fit").agg(F.sum("n").alias("size"), F.sum("k").alias("hits"))  # a row a curve
    own = predict_with(cells, fits, "x", "p").join(totals, "fit").withColumn(
        "base", F.coalesce(F.col("hits") / null_if(F.col("size"), 0), F.lit(0.0))
    )
    columns = ["curve", "scored", "n", "k", "p"]

    def scored(rows: DataFrame, curve: str, kind: str, p: str) -> DataFrame:
        return rows.select(F.col(curve).alias("curve"), F.lit(kind).alias("scored"), "n", "k", F.col(p).alias("p"))

    rows = scored(own, "fit", "baseline", "base").unionByName(scored(own, "fit", "in_sample", "p"))
    rows = rows.unionByName(scored(held_out, "curve", "leave_one_class_out", "pred")).select(*columns)
    table = scores(rows, "p", by=["curve", "scored"])
    known = fits.select(F.col("fit").alias("curve"), "method")
    sizes = totals.select(F.col("fit").alias("curve"), "size", "hits")
    table = table.join(sizes, "curve").join(known, "curve", "left")
    report = table.select(
        "curve",
        F.coalesce("method", F.lit("constant")).alias("method"),
        F.col("size").cast("long").alias("n"),
        F.round(F.coalesce(F.col("hits") / null_if(F.col("size"), 0), F.lit(0.0)), 4).alias("base_rate"),
        "scored",
        F.round("brier", 5).alias("brier"),
        F.round("log_loss", 5).alias("log_loss"),
    )
    return Evaluation(report, held_out, fits, last)


def held_out_deciles(
    df: DataFrame,
    held_out: DataFrame,
    specs: Sequence[CurveSpec],
    grain: Sequence[str],
    c: OutcomeColumns | None = None,
    n_bins: int = N_BINS,
) -> DataFrame:
    """Expected and observed rate per curve in equal-count bins of the held-out prediction.

    Rows of equal predictions are ordered by ``grain``. All curves are binned in one pass.
    """
    c = c or OutcomeColumns()
    keys = [c.period, c.sequence]
    inside = [
        F.when(
            in_population(Rules(count_uncredited=not s.credited_only), c),
            F.struct(F.lit(s.name).alias("curve"), is_true(F.col(s.target)).alias("hit")),
        )
        for s in specs
    ]
    rows = df.select(*keys, *[g for g in grain if g not in keys], F.explode(F.array_compact(F.array(*inside))).alias("_c"))
    rows = rows.select(*[x for x in rows.columns if x != "_c"], "_c.curve", F.col("_c.hit").alias("_y"))
    on = ["curve", *keys]
    known = cut_lineage(held_out.select(*on, "pred"))
    if known.count() <= FEW_KEYS:  # a row a curve, class and position
        predicted = rows.join(F.broadcast(known), on, "left")
    else:
        predicted = lookup_join(rows, known, on, spread=grain)
    rounded = predicted.withColumn("_order", F.round("pred", 12))  # sums in another order tie alike
    binned = bins_within(rounded.select("curve", "pred", "_order", "_y", *grain), ["curve"], ["_order", *grain], n_bins, "decile")
    return binned.groupBy("curve", "decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("pred").alias("expected"),
        F.avg(F.col("_y").cast("double")).alias("observed"),
    )


def curve_rises(
    curve: DataFrame, x: str, names: Sequence[str], max_rise: float = MAX_RISE
) -> DataFrame:
    """Positions where a curve lies more than ``max_rise`` above an earlier value, in points."""
    risen = rise_over_running_min(curve, x, names)
    long = risen.select(
        F.col(x),
        F.explode(
            F.array(
                *[F.struct(F.lit(v).alias("curve"), F.col(f"rise_{v}").alias("rise")) for v in names]
            )
        ).alias("r"),
    )
    over = long.filter(F.col("r.rise") > max_rise)
    return over.select("r.curve", x, F.round(100 * F.col("r.rise"), 2).alias("rise_pts"))


