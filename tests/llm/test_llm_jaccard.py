import random

import numpy as np
import samples

from cohortlens.llm import jaccard


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    found = [w for w in lower.split(" ") if w]
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute(rows):
    """(size, component) of each (id, text), by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return [(i, len(s), find(i)) for i, s in sets]


def family(rng, vocabulary):
    """Texts of all sizes with near copies at and around the limit."""
    texts = []
    for size in [*range(1, 40), 60, 61, 90, 140, 200, 400, 900]:
        base = samples.words(rng, size, vocabulary).split()
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.randint(1, max(1, size // 25))):
                at = rng.randrange(len(near))
                change = rng.random()
                if change < 0.4:
                    near[at] = "changed"
                elif change < 0.7 and len(near) > 1:
                    del near[at]
                else:
                    near.insert(at, "added")
            cut = rng.randint(0, max(0, size // 6))
            texts.append("  ".join(near[cut:]).upper() if rng.random() < 0.3 else " ".join(near[cut:]))
    return texts


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = family(rng, vocabulary) + family(rng, vocabulary[:6])
    passage = samples.words(rng, 60, vocabulary)
    texts += [f"{samples.words(rng, 150, vocabulary)} {passage} {samples.words(rng, 40, vocabulary)}" for _ in range(60)]
    chain = samples.words(rng, 120, vocabulary).split()
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 40, 4)]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.join(docs).collect())
    want = sorted(brute(rows))
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 50


def test_signatures_of_linked_sets_meet():
    """At every size and any ranking of contents, two sets that link are filed under a common key."""
    rng = np.random.default_rng(3)
    met = 0
    for size in [*range(1, 70), 100, 187, 188, 189, 190, 300, 598, 700, 1900]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            keep = rng.permutation(len(a))[: rng.integers(int(0.7 * len(a)), len(a) + 1)]
            more = rng.integers(0, 2**64, rng.integers(0, len(a) // 5 + 2), dtype=np.uint64)
            b = np.unique(np.concatenate([a[keep], more]))
            if not len(b) or not jaccard.linked(a, b) or np.array_equal(a, b):
                continue
            hot = np.sort(rng.choice(np.concatenate([np.concatenate(jaccard.signatures(s, (a[:0], a[:0].astype(int)))) if len(jaccard.signatures(s, (a[:0], a[:0].astype(int)))) else a[:0] for s in (a, b)]), 3))
            costs = (hot, np.arange(3, 3 + len(hot)))
            one, two = (set(np.concatenate(jaccard.signatures(s, costs)).tolist()) for s in (a, b))
            assert one & two, (len(a), len(b))
            met += 1
    assert met > 150


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64)]))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_large_groups_of_copies_and_near_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    base = samples.words(rng, 200, vocabulary)
    rows = [(i, base) for i in range(0, 300)]
    rows += [(300 + i, f"{base} tail{i}") for i in range(300)]
    rows += [(600 + i, samples.words(rng, 200, vocabulary)) for i in range(100)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(600))
    assert all(got[i] == i for i in range(600, 700))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500 + i, 700) for i in range(100)] + [(7, 7)]
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "hub long, doc_id long")
    got = {r["node"]: r["component"] for r in jaccard.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{500 + i: 500 for i in range(100)}, 700: 500}


def test_awkward_rows(spark):
    docs = samples.documents(spark)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.join(docs).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[2, 0] == 2 and got[3, 1] == 3
    assert got[5, 6] == 5 and got[6, 6] == 5
    assert any(d is None and c is None for (d, _), c in got.items())
    assert jaccard.join(docs).count() == docs.count()
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert jaccard.join(samples.empty(spark)).count() == 0


def test_an_id_with_two_texts_joins_their_groups(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(5, one), (5, two), (1, two), (9, one), (7, "other words that stand alone here")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 1, 1: 1, 9: 1, 7: 7}
