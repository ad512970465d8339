"""Quality rules: fixed limits, then robust outliers within each language and source.

Four shape figures of a text are transformed to be comparable between short and long texts. For each
(language, source) the minimum covariance determinant estimate of their centre and spread is found:
starting from the median and from both quartiles, with quartile ranges as spread, concentration steps
keep the three quarters of all documents that lie nearest and estimate again from them, until no
determinant falls any more; the start that ends at the least determinant is taken. A document is rejected when its squared
Mahalanobis distance passes the chi-square limit. Groups below ``GROUP_ROWS`` documents are pooled
by language, then all together; if even the pool is that small, nothing is rejected by distance.

All steps are group-wise sums and mergeable quantiles, and estimates are sent to the documents (or, if
there are more than ``SENT_GROUPS``, those of hot groups are repeated), so a group of any size is never
gathered.

Null and empty texts have no words and fail the fixed limits; null languages and sources are groups
of their own. Repeated rows count each time; ties at the concentration limit are all kept; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import long, map_texts
from cohortlens.operators.spread import hot_keys, lookup_join
from cohortlens.session import cut_lineage

LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words
WINDOW = 8

GROUP_ROWS = 200
KEPT_SHARE = 0.75
#: Concentration steps at most, and the share by which a determinant must fall for another one.
STEPS = 5
FALL = 0.01
#: Starting places of a group's estimate: these of its three quartiles.
STARTS = 3
#: Estimates up to which they are sent to all executors.
SENT_GROUPS = 50_000
#: Spread that every figure has at least, so that a figure that is nearly constant in a group does
#: not make small differences look large.
FLOOR = (0.06, 0.35, 0.25, 0.06)
#: Chi-square limit with four degrees of freedom for one document in a million.
LIMIT = 33.4
P = len(FLOOR)

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    # Equal windows have equal hashes; windows with equal hashes are then compared.
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    seen: dict[tuple[bytes, ...], int] = {}
    marked = np.zeros(len(words) + 1, dtype=np.int64)
    places = order[twin]
    windows = [tuple(words[i : i + WINDOW]) for i in places]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for i, w in zip(places, windows, strict=True):
        if seen[w] > 1:
            marked[i] += 1
            marked[min(i + WINDOW, len(words))] -= 1
    return int((np.cumsum(marked)[:-1] > 0).sum())


def text_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    lines = [line for line in re.split(b"\n", text) if line.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def figures(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def make():
        def work(texts: list[bytes]):
            rows = [text_figures(t) for t in texts]
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return work

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return map_texts(docs, make, [long(n) for n in names], keep).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )


def _vector() -> list[Column]:
    """Shape of a text: word length, symbols, repeated lines and repeated windows.

    Additions to the denominators keep short texts, whose shares jump, near the usual values.
    """
    n = F.col("n_words") + 50
    share = F.col("n_symbols") / (F.col("word_chars") + 200)
    return [
        F.log((F.col("word_chars") + 250) / n),
        F.log1p(200 * share),
        F.log1p(50 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the group whose estimate they use: own, of the language, or of all."""
    own = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < GROUP_ROWS
    pooled = own.withColumn(
        "in_lang", F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    )
    name = (
        F.when(~small, F.to_json(F.array("lang", "source")))
        .when(F.col("in_lang") >= GROUP_ROWS, F.to_json(F.array("lang")))
        .otherwise("[]")
    )
    names = pooled.select(
        F.col("lang").alias("l"), F.col("source").alias("s"), name.alias("group")
    )
    match = rows["lang"].eqNullSafe(names["l"]) & rows["source"].eqNullSafe(names["s"])
    return rows.join(names, match, "left").drop("l", "s")


def _distance() -> Column:
    gap = [F.col(f"x{i}") - F.col("centre")[i] for i in range(P)]
    terms = [
        gap[i] * gap[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2)
        for i in range(P)
        for j in range(i, P)
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _met(rows: DataFrame, known: DataFrame, how: str = "inner", few: bool | None = None) -> DataFrame:
    """``rows`` with what is known of their group; the rows of a group do not meet in one task.

    ``few`` says whether the list is short enough to be sent; without it, it is counted.
    """
    if known.count() <= SENT_GROUPS * STARTS if few is None else few:
        return rows.join(F.broadcast(known), "group", how)
    return lookup_join(rows, known, ["group"], hot=hot_keys(rows, ["group"]), how=how)


def _start(rows: DataFrame) -> DataFrame:
    """Per group and ``start`` a centre, an inverse spread and no determinant yet."""
    quartiles = [
        F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)
    ]
    spread = [
        F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOOR[i] ** 2 for i in range(P)
    ]
    return (
        rows.groupBy("group")
        .agg(*quartiles)
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
        .select(
            "group",
            "start",
            F.array(*[F.get(f"q{i}", "start") for i in range(P)]).alias("centre"),
            F.array(
                *[1 / spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
            ).alias("inverse"),
            F.lit(float("inf")).alias("determinant"),
        )
    )


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse spread from the sums over each group's nearest rows."""
    # The nearest three quarters of a normal sample in four dimensions spread less than the whole.
    correction = KEPT_SHARE / 0.5248
    for frame in frames:
        out = []
        for group, start, n, sums, squares in frame.itertuples(index=False):
            centre = np.array(sums) / n
            spread = np.array(squares).reshape(P, P) / n - np.outer(centre, centre)
            spread = correction * spread + np.diag(np.square(FLOOR))
            out.append((group, start, centre, np.linalg.inv(spread).ravel(), np.linalg.det(spread)))
        yield pd.DataFrame(out, columns=["group", "start", "centre", "inverse", "determinant"])


def _concentrated(rows: DataFrame, estimate: DataFrame, few: bool | None = None) -> DataFrame:
    """The estimates from the rows of each group that lie nearest under ``estimate``."""
    by = ["group", "start"]
    limits = (
        _met(rows, estimate, few=few)
        .withColumn("d", _distance())
        .groupBy(*by)
        .agg(F.percentile_approx("d", KEPT_SHARE, 1000).alias("limit"))
    )
    near = _met(rows, cut_lineage(estimate.join(limits, by)), few=few).withColumn("d", _distance()).where("d <= limit")
    sums = near.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(f"x{i}") for i in range(P)]).alias("sums"),
        F.array(
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(P) for j in range(P)]
        ).alias("squares"),
    )
    shape = "group string, start int, centre array<double>, inverse array<double>, determinant double"
    return sums.mapInPandas(_inverted, shape)


def least_determinant(rows: DataFrame) -> DataFrame:
    """Per group the ``centre`` and ``inverse`` spread of the least determinant found; stored."""
    estimate = cut_lineage(_start(rows))
    few = estimate.count() <= SENT_GROUPS * STARTS
    for _ in range(STEPS):
        after = cut_lineage(_concentrated(rows, estimate, few))
        before = estimate.select("group", "start", F.col("determinant").alias("was"))
        falls = after.join(before, ["group", "start"]).where(F.col("determinant") < (1 - FALL) * F.col("was"))
        estimate = after
        if falls.isEmpty():
            break
    best = F.min(F.struct("determinant", "start", "centre", "inverse"))
    return cut_lineage(estimate.groupBy("group").agg(best.alias("b")).select("group", "b.centre", "b.inverse"))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The figures of every whole text, ``base_failed``, ``distance`` and ``kept``."""
    wanted = tuple(dict.fromkeys((*keep, "lang", "source")))
    measured = figures(docs, wanted)
    vectors = [x.alias(f"x{i}") for i, x in enumerate(_vector())]
    rows = cut_lineage(_grouped(cut_lineage(measured)).select("*", *vectors))

    # Texts that fail the fixed limits are judged, too, but do not shape the estimates.
    usual = rows.where(~F.col("base_failed")).select("group", *[f"x{i}" for i in range(P)])
    sizes = usual.groupBy("group").agg(F.count(F.lit(1)).alias("rows_in_group"))
    usable = least_determinant(usual).join(sizes.where(F.col("rows_in_group") >= GROUP_ROWS // 2), "group")

    distance = _met(rows, cut_lineage(usable), "left").withColumn("distance", _distance())
    return distance.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= LIMIT)).alias("kept"),
        "distance",
    )
