import itertools
import random

import numpy as np
import samples

from cohortlens.llm import quality


def brute_figures(text):
    space = " \t\n\x0b\x0c\r"
    found, word = [], ""
    for c in text + " ":
        if c in space:
            if word:
                found.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(space):
            repeated += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(marked)


def test_figures_are_those_of_a_plain_count(spark):
    rng = random.Random(3)
    texts = [samples.words(rng, rng.randint(0, 60), ["a", "b", "é|", "c\n", "\x0b", "\u00a0", "#x", "\x1c"]) for _ in range(300)]
    texts += [f"{t}\n{t}\n{t}" for t in texts[:60]] + [" ".join(["x"] * n) for n in range(20)]
    for t in texts:
        assert quality.text_figures(t.encode()) == brute_figures(t)


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "house", "garden", "walked", "over", "window", "and", "morning", "slowly"]
    clean = [(100 + i, ". ".join(samples.words(rng, rng.randint(30, 400), vocabulary) for _ in range(2))) for i in range(600)]
    junk = [(5000 + i, " ".join(w + "***$$$" for w in samples.words(rng, 80, vocabulary).split())) for i in range(20)]
    odd = [(6000 + i, " ".join("x" * 300 for _ in range(25)) + f" {i}") for i in range(5)]
    rows = {r["doc_id"]: r for r in quality.judge(samples.documents(spark, clean + junk + odd)).collect()}
    assert sum(rows[i]["kept"] for i, _ in clean) >= 598
    assert not any(rows[i]["kept"] for i, _ in junk)
    assert not any(rows[i]["kept"] for i, _ in odd)
    assert rows[0]["base_failed"] and not rows[0]["kept"] and rows[0]["n_words"] == 0
    assert all(not r["kept"] for r in rows.values() if r["base_failed"])


def test_estimate_is_robust(spark):
    """A fifth of a group far away must not move the centre."""
    rng = np.random.default_rng(1)
    usual = rng.normal(0, 1, (2000, quality.P))
    away = rng.normal(8, 0.5, (500, quality.P))
    rows = [("g", *map(float, x)) for x in np.concatenate([usual, away])]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    estimate = quality._start(df)
    for _ in range(quality.STEPS):
        estimate = quality._concentrated(df, estimate).cache()
    centre = np.array(estimate.first()["centre"])
    assert np.abs(centre).max() < 0.25


def test_small_tables_are_judged_by_the_limits_alone(spark):
    docs = samples.documents(spark)
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality.judge(samples.empty(spark)).count() == 0


def test_least_determinant_is_that_of_all_subsets(spark):
    """Groups of 12 rows, three of them away: 9 rows are kept, and all 220 ways are tried."""
    rng = np.random.default_rng(5)
    groups = {f"g{k}": np.concatenate([rng.normal(0, 1, (9, quality.P)), rng.normal(6, 1, (3, quality.P))]) for k in range(6)}
    rows = [(g, *map(float, x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    got = {r["group"]: np.array(r["centre"]) for r in quality.least_determinant(df).collect()}

    def determinant(xs):
        return np.linalg.det(0.75 / 0.5248 * np.cov(xs.T, bias=True) + np.diag(np.square(quality.FLOOR)))

    for g, xs in groups.items():
        best = min((xs[list(s)] for s in itertools.combinations(range(12), 9)), key=determinant)
        assert np.allclose(got[g], best.mean(axis=0))
