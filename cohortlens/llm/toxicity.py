"""Toxicity by compression distance: how much shorter does a toxic dictionary make a window?

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Each holds the words
that both classes share, in the same order, and before them the segments (words and word beginnings)
that its own class uses clearly more often. A text is cut into windows of words, at two sizes; a
window's gain is its compressed length with the ordinary dictionary minus that with the toxic one.
The gains of all windows give a few features, which a logistic curve, fitted on texts the
dictionaries have not seen, turns into a score; its threshold is moved to 0.5.

Training reads a bounded sample: at most ``TOXIC_TEXTS`` and ``ORDINARY_TEXTS`` different texts of at
most ``TEXT_CHARS`` characters, the ones with the smallest hashes. Scoring reads every whole text.

Null and empty texts score as texts without windows. Labels that are null do not train; a document
labelled twice counts as toxic if one label says so; without both classes every score is 0. Repeated
rows get the same score each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import double, map_texts, plain_words, trim_memory

TOXIC_TEXTS = 2400
ORDINARY_TEXTS = 4800
TEXT_CHARS = 20_000

#: Words of a window, and the shortest match the compressor may use in it.
SCALES = ((16, 5), (24, 4))
SEGMENT_SHARE = 0.012
SEGMENT_ODDS = 2.0
SHARED_WORDS = 4000
SHARED_ODDS = 1.5
GAIN = 2
FEATURES = 6 * len(SCALES)
FOLDS = 3
RECALL_WEIGHT = 2.0


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self):
        """For each scale: words of a window, ordinary and toxic compressor."""
        made = []
        for words, shortest in SCALES:
            parameters = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY,
                min_match=shortest,
                window_log=17,
                hash_log=16,
                chain_log=16,
                search_log=4,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            pair = []
            for content in (self.ordinary, self.toxic):
                known = zstandard.ZstdCompressionDict(
                    content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                )
                known.precompute_compress(compression_params=parameters)
                pair.append(
                    zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress
                )
            made.append((words, *pair))
        return made


def segments(words: set[bytes]) -> set[bytes]:
    """Words between blanks, and their beginnings of four to eight bytes."""
    out = {b" %b " % w for w in words}
    for w in words:
        out.update(b" " + w[:k] for k in range(4, min(len(w), 9)))
    return out


def _odds(segment: bytes, own: Counter, n: int, other: Counter, m: int) -> float:
    return math.log((own[segment] + 0.5) / (n + 1) * (m + 1) / (other[segment] + 1))


def _own_segments(own: Counter, n: int, other: Counter, m: int) -> list[bytes]:
    least = max(3.0, SEGMENT_SHARE * n)
    rated = sorted(
        (
            (-count * odds, -len(segment), segment)
            for segment, count in own.items()
            if count >= least and (odds := _odds(segment, own, n, other, m)) >= SEGMENT_ODDS
        )
    )
    chosen: list[bytes] = []
    for _, _, segment in rated:
        longer = (c for c in chosen if segment in c)
        if not any(own[c] >= 0.8 * own[segment] for c in longer):
            chosen.append(segment)
    return chosen


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The two dictionaries, trained on texts of each class."""
    counts = []
    for texts in (toxic, ordinary):
        seen: Counter = Counter()
        for value in texts:
            seen.update(segments(set(plain_words(value))))
        counts.append((seen, max(1, len(texts))))
    (bad, n), (good, m) = counts
    frequent = sorted((bad + good).items(), key=lambda x: (-x[1], x[0]))
    shared = [s for s, _ in frequent[: 2 * SHARED_WORDS] if s.endswith(b" ")][:SHARED_WORDS]
    shared = [s for s in shared if _odds(s, bad, n, good, m) < SHARED_ODDS]
    block = b"".join(reversed(shared))
    return (
        b"".join(_own_segments(bad, n, good, m))[:8192] + block,
        b"".join(_own_segments(good, m, bad, n))[:8192] + block,
    )


def gains(words: list[bytes], size: int, ordinary, toxic) -> list[int]:
    """Bytes that each window is shorter with the toxic dictionary, largest first."""
    out = []
    for at in range(0, len(words), size):
        window = b" %b " % b" ".join(words[at : at + size])
        out.append(len(ordinary(window)) - len(toxic(window)))
    out.sort(reverse=True)
    return out


def features(text: bytes, scales) -> list[float]:
    words = plain_words(text)
    row: list[float] = []
    for size, ordinary, toxic in scales:
        found = gains(words, size, ordinary, toxic)
        top = [max(0, g) for g in found[:3]] + [0, 0, 0]
        clear = [g for g in found if g >= GAIN]
        row += [
            min(top[0], 20),
            min(top[1], 20),
            min(top[2], 20),
            sum(clear) / (len(found) + 4),
            len(clear) / (len(found) + 4),
            math.log1p(len(found)),
        ]
    return row


def _logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.5)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(curve, slope)
    return w


def train(toxic: list[bytes], ordinary: list[bytes], toxic_share: float) -> Model | None:
    """The model, or None without texts of both classes. ``toxic_share``: of all labels."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    # The curve is fitted on features from dictionaries that have not seen the text.
    rows: list[list[float]] = []
    y = np.array([float(k) for fold in range(FOLDS) for k, t in ((1, toxic), (0, ordinary)) for _ in t[fold::FOLDS]])
    for fold in range(FOLDS):
        rest = [[t for i, t in enumerate(kind) if i % FOLDS != fold] for kind in (toxic, ordinary)]
        scales = Model(*dictionaries(*rest), (), (), ()).compressors()
        rows += [features(t, scales) for kind in (toxic, ordinary) for t in kind[fold::FOLDS]]
    x = np.array(rows)
    bad, good = dictionaries(toxic, ordinary)
    weight = np.where(
        y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum())
    ) * len(y)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    w = _logit((x - centre) / scale, y, weight)

    logit = (x - centre) / scale @ w[:-1] + w[-1]
    order = np.argsort(-logit)
    hit = np.cumsum((weight * y)[order])
    named = np.cumsum(weight[order])
    # F-measure in which recall counts twice, for the final dictionaries err less than those here.
    measure = (1 + RECALL_WEIGHT) * hit / (named + RECALL_WEIGHT * (weight * y).sum())
    best = int(np.argmax(measure))
    here = logit[order]
    w[-1] -= (here[best] + here[min(best + 1, len(here) - 1)]) / 2
    return Model(bad, good, tuple(centre), tuple(scale), tuple(w))


def fit(docs: DataFrame, labels: DataFrame, trains: Column) -> Model | None:
    """Trains on the labels for which ``trains`` (of doc_id) holds; see the module for the bound."""
    rated = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & trains)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in rated.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts: dict[int, list[bytes]] = {}
    for kind, most in ((1, TOXIC_TEXTS), (0, ORDINARY_TEXTS)):
        # Twice as many ids as texts, for some texts are equal; both are bounded numbers.
        ids = (
            rated.where(F.col("toxic") == kind)
            .select("doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(2 * most)
        )
        chosen = (
            docs.where(F.length("text").between(1, TEXT_CHARS))
            .select("doc_id", "text")
            .join(F.broadcast(ids), "doc_id", "left_semi")
            .select("text")
            .distinct()
            .orderBy(F.xxhash64("text"), "text")
            .limit(most)
        )
        texts[kind] = [r["text"].encode() for r in chosen.collect()]
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = train(texts[1], texts[0], share)
    texts.clear()
    trim_memory()
    return model


def score(
    docs: DataFrame,
    model: Model | None,
    keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """Score from 0 to 1 and prediction (1 from 0.5 on) of every whole text, under ``names``."""

    def make():
        if model is None:
            return lambda texts: [[0.0] * len(texts), [0] * len(texts)]
        scales = model.compressors()
        centre, scale = np.array(model.centre), np.array(model.scale)
        weights = np.array(model.weights)

        def work(texts: list[bytes]):
            x = np.array([features(t, scales) for t in texts]).reshape(-1, FEATURES)
            logit = (x - centre) / scale @ weights[:-1] + weights[-1]
            scores = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            return [scores, (scores >= 0.5).astype(np.int32)]

        return work

    fields = [double(names[0]), T.StructField(names[1], T.IntegerType())]
    return map_texts(docs, make, fields, keep)


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the texts predicted to be toxic."""
    scored = score(docs, model, tuple(docs.columns), ("__score", "__predicted"))
    return scored.where("__predicted = 0").select(*docs.columns)


def training_fold() -> Column:
    """Whether a document's label may train: crc32 of its id as text, modulo 5, is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
