import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import neighbours

SHAPE = "vec_id long, embedding array<float>, label int, _leaf string"


def table(spark, rows):
    made = [(i, v if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows]
    return spark.createDataFrame(made, SHAPE).repartition(3)


def brute(rows, k=10):
    """All pairs, in double precision of the single-precision values."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q, v in ok.items():
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok.items() if i != q)
            out[q] = near[:k]
    return out


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found = got.setdefault(r["query_id"], [])
        found.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found)
    return got


def ask(rows_df, k=10):
    index = neighbours.build(rows_df, k)
    return index, neighbours.search(index, rows_df.filter("vec_id % 100 = 0"))


def test_one_leaf_is_exact_and_awkward_rows_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(150)]
    rows += [(200, None), (300, [0.0] * 8), (400, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8)]
    rows += [(None, rows[0][1]), (600, [float("inf")] * 8), (700, [1.0, 2.0]), rows[7], rows[100]]
    want = brute([r for r in rows if r[0] != 700])
    _, got = ask(table(spark, rows))
    got = result(got)
    assert got.keys() == want.keys() == {0, 100}
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in near], abs=1e-12)


def test_a_vector_of_a_third_of_all_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_CLASSES", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    rng = np.random.default_rng(2)
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, hot if i % 3 == 0 else rng.integers(-3, 4, 4).tolist()) for i in range(1800)]
    rows = [(i, v if any(v) else hot) for i, v in rows]
    want = brute(rows)
    index, got = ask(table(spark, rows))
    got = result(got)
    assert index.tree.n_leaves > 8 and index.placed.count() < 1300
    same = sum(len(set(got[q]) & set(near)) for q, near in want.items())
    assert got.keys() == want.keys() and same >= 0.95 * 10 * len(want)
    for q in want:
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
    # the hot vector's queries find its smallest ids at no distance
    assert got[300] == [(0.0, i) for i in range(0, 30, 3)]


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_CLASSES", 32)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = list(enumerate(vectors.tolist()))
    want = brute(rows)
    index, got = ask(table(spark, rows))
    got = result(got)
    assert 1 < index.visits < index.tree.n_leaves and index.recall >= neighbours.RECALL
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(len(near) for near in want.values())


def test_leaves_come_best_bin_first_and_all_of_them():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(900, 5))
    tree = neighbours.fit_tree(rows, 40)
    leaves = tree.assign(rows)
    for q, leaf in zip(rows[:50], leaves[:50], strict=True):
        order = list(tree.visits(q))
        assert sorted(order) == list(range(tree.n_leaves))
        assert order.index(leaf) < 5
    assert neighbours.fit_tree(np.ones((50, 3)), 10).n_leaves == 1


def test_small_tables(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert ask(empty)[1].count() == 0
    _, got = ask(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])]))
    assert result(got) == {0: [(0.0, 2), (pytest.approx(2**0.5), 1)]}
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    _, alone = ask(table(spark, [(100, [1.0, 0.0])]))
    assert alone.count() == 0
    twice = table(spark, [(100, [1.0, 0.0]), (100, [0.0, 2.0]), (5, [3.0, 0.0])])
    assert ask(twice)[1].filter(F.col("vec_id") == 5).count() == 2
