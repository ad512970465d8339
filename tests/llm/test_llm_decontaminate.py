import random

import numpy as np
import samples

from cohortlens.llm import decontaminate as d
from cohortlens.llm.common import plain_words


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_subsequence_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert d.lcs(a, b) == brute_lcs(a, b)


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(9)
    parts = "th er on an re ing ed tion ly al ou ent sh wh ea nd".split()
    vocabulary = ["the", "of", "and", "in"] * 30 + [f"{a}{b}" for a in parts for b in parts]
    items = [(i, samples.words(rng, rng.randint(12, 60), vocabulary)) for i in range(80)]
    items += [(200, "What is it? Answer: forty two"), (201, None), (202, ""), (203, "of ered")]
    docs, want = [], set()
    for i in range(400):
        text = samples.words(rng, rng.randint(20, 900), vocabulary)
        if i % 4 == 0:
            item, passage = rng.choice(items[:80])
            found = passage.split()
            if i % 8 == 0:  # a paraphrase: an eighth of the words replaced
                for k in range(0, len(found), 8):
                    found[k] = rng.choice(vocabulary)
            before = text.split()
            at = rng.randint(0, len(before))
            text = " ".join(before[:at] + found + before[at:])
            want.add((1000 + i, item))
        docs.append((1000 + i, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in d.matches(samples.documents(spark, docs), benchmark).collect()}

    # Brute force: every item at every word of every document.
    truth = set()
    read = [d.read_item(*i) for i in items if i[1]]
    for doc, text in docs:
        found = plain_words(text.encode())
        for item in read:
            need = d.COVERED * len(item.words)
            if len(item.words) < d.LEAST or d.lcs(item.words, found) < need:
                continue
            width = int(d.STRETCH * len(item.words))
            if any(d.lcs(item.words, found[s : s + width]) >= need for s in range(0, len(found), 2)):
                truth.add((doc, item.number))
    assert want <= truth
    assert len(want & got.keys()) >= 0.97 * len(want)
    assert len(truth & got.keys()) >= 0.9 * len(truth)
    clean = {1000 + i for i in range(400)} - {i for i, _ in truth} - {i for i, k in got if k == 203}
    assert not clean & {i for i, _ in got}


def test_answers_must_stand_in_the_text():
    item = d.read_item(1, "the river that runs through the old town is called Answer: silver brook")
    found = [b"x"] * 10 + plain_words(b"the river that runs through the old town is called answer silver brook") + [b"y"] * 10
    assert d.confirmed(item, found, 10)
    wrong = [b"x"] * 10 + plain_words(b"the river that runs through the old town is called answer golden creek") + [b"y"] * 10
    assert d.confirmed(item, wrong, 10) is None


def test_empty_sides(spark):
    docs = samples.documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a plain sentence of more than five words stands here")], "item_id long, text string")
    assert d.matches(docs, none).count() == 0
    assert d.matches(samples.empty(spark), some).count() == 0
    assert sorted(r["doc_id"] for r in d.matches(docs, some).collect()) == [5, 5, 6]
    left = d.clean(docs, some)
    assert left.columns == docs.columns and left.count() == docs.count() - 3


def test_copies_of_an_item_that_many_documents_hold(spark):
    """The item's words are then light, and those beside it heavy."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvwxz"]
    rare = [f"{w}{v}" for w in vocabulary for v in ("ing", "ous", "ly")]
    for every in (3, 1):
        items = [(i, samples.words(rng, n, vocabulary)) for i, n in enumerate((12, 16, 20, 24, 30))]
        others = [(100 + i, samples.words(rng, 25, vocabulary)) for i in range(60)]
        docs, want = [], set()
        for i in range(240):
            found = samples.words(rng, rng.randint(60, 200), rare).split()
            if i % every == 0:
                for number, item in items:
                    at = rng.randint(0, len(found))
                    found[at:at] = item.split()
                    found[at:at] = samples.words(rng, 20, rare).split()
            docs.append((i, " ".join(found)))
            want |= {(i, number) for number, item in items if item in docs[-1][1]}
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = d.matches(frame, spark.createDataFrame(items + others, "item_id long, text string")).collect()
        assert want and want <= {(r["doc_id"], r["item_id"]) for r in got}


def test_short_items_are_found_wherever_they_stand(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvwxz"]
    items = [(n, " ".join(f"short{n}{i}" for i in range(n))) for n in range(1, 6)]
    docs = []
    for i in range(200):
        found = samples.words(rng, rng.randint(1, 120), vocabulary).split()
        at = rng.randint(0, len(found))
        found[at:at] = items[i % 5][1].split()
        docs.append((i, " ".join(found)))
    docs.append((300, "short50 short51 short52 short54 short53 short30 short31 short20"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = d.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 1 + i % 5) for i in range(200)]
    assert {r["covered"] for r in got} == {1.0}


def test_no_pair_that_would_be_confirmed_is_ruled_out():
    rng = random.Random(12)
    vocabulary = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(90)]
    items = []
    for number in range(40):
        said = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 7, 16, 33, 60]))]
        items.append(d.read_item(number, " ".join(said)))
    texts = []
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        item = rng.choice(items)
        copy = [w.decode() for w in item.words if rng.random() > rng.choice([0.0, 0.2, 0.35])]
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + copy + words[at:]).encode())
    slots = d.word_slots(texts)
    frequency = np.zeros(d.SLOTS)
    for s in slots:
        frequency[d.slots_once(s)] += 1
    idf = d._weights(frequency, len(texts))
    rare = d.Rare(d._item_slots(items), idf)
    words, pairs, halves = [], [], 0
    for k, s in enumerate(slots):
        held, numbers = rare.halves(s)
        words.append((halves + held, numbers))
        size = -(-len(s) // d.STEP)
        for at in d.passage_starts(len(s)):
            for item in items:
                pairs.append((k, at, halves + at // d.STEP, halves, halves + size, item.number))
        halves += size
    _, _, half, low, high, numbers = np.array(pairs).T
    possible = rare.possible(words, half, low, high, numbers)
    found = 0
    for (k, at, *_, number), kept in zip(pairs, possible, strict=True):
        if d.confirmed(items[number], plain_words(texts[k]), at):
            found += 1
            assert kept
    assert found > 30 and possible.mean() < 0.9


def test_every_document_counts_in_the_fit(spark):
    """More documents than a sample would hold, long ones cut at passages, and one word of its own each."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "bdfgklmn" for b in "aeiou"]
    docs = [(i, f"own{i} " + samples.words(rng, rng.choice([0, 5, 40, 70]), vocabulary)) for i in range(2600)]
    docs += [(3000, None), (3001, ""), (3002, samples.words(rng, 3 * d.FIT_WORDS, vocabulary))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    frequency, texts = d._document_frequencies(frame)
    idf = d._weights(frequency, texts)
    total, n = d._multiplied(frame, idf)
    want, rows = np.zeros((d.SLOTS, d.PROBES)), 0
    probes = d._random(d.PROBES).astype(np.float64)
    for ids in d.word_slots([(t or "").encode() for _, t in docs]):
        for at in range(0, len(ids), d.PASSAGE):
            slots, counts = np.unique(ids[at : at + d.PASSAGE], return_counts=True)
            weight = counts * idf[slots].astype(np.float64)
            weight /= np.linalg.norm(weight)
            want[slots] += weight[:, None] * (weight @ probes[slots])
            rows += 1
    assert n == rows and np.allclose(total, want, rtol=1e-3, atol=0.05)
    factor = d.document_factor(frame, idf)
    assert factor.shape[0] == d.SLOTS and np.linalg.norm(factor @ (factor.T @ probes) - want / rows) < 0.05 * np.linalg.norm(want / rows)


def test_only_passages_with_enough_of_an_items_words_are_projected():
    """The pairs are those that the rarer words leave of all, whatever text stands beside them."""
    rng = random.Random(21)
    vocabulary = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(90)]
    items = [d.read_item(i, samples.words(rng, n, vocabulary)) for i, n in enumerate([1, 2, 5, 7, 16, 33, 60] * 4)]
    texts = [samples.words(rng, n, vocabulary) for n in (0, 1, 15, 16, 17, 32, 33, 48, 300, 0)]
    texts += [f"{rng.choice(texts[2:])} {' '.join(w.decode() for w in items[i].words)}" for i in range(20)]
    slots = d.word_slots([t.encode() for t in texts])
    idf = np.ones(d.SLOTS, dtype=np.float32)
    rare = d.Rare(d._item_slots(items), idf)
    projected = d._filled(np.random.default_rng(4).standard_normal((d.SLOTS, 8)).astype(np.float32))
    targets = np.array([projected[s].sum(0) / np.linalg.norm(projected[s].sum(0)) for s in d._item_slots(items)])

    want = {}
    for k, s in enumerate(slots):
        held, numbers = rare.halves(s)
        for at in d.passage_starts(len(s)) if len(s) else ():
            row = projected[s[at : at + d.PASSAGE]].sum(0)
            cosines = targets @ row / np.linalg.norm(row)
            ends = [np.full(len(items), v) for v in (at // d.STEP, 0, -(-len(s) // d.STEP))]
            possible = rare.possible([(held, numbers)], *ends, np.arange(len(items)))
            for i, item in enumerate(d._item_slots(items)):
                n = min(len(item), d.GRAM)
                grams = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)}
                # The last passage has the words in a row that begin in its second half, too.
                till = len(s) if at == d.passage_starts(len(s))[-1] else at + d.STEP
                shared = any(tuple(s[j : j + n]) in grams for j in range(at, min(till, len(s) - n + 1)))
                if possible[i] and (cosines[i] >= d.COSINE or shared):
                    want[k, at, i] = cosines[i]
    got = list(zip(*(v.tolist() for v in d._candidates(slots, projected, targets, d.Grams(d._item_slots(items)), rare)), strict=True))
    assert want and {g[:3] for g in got} == want.keys() and len(got) == len(want)
    assert all(abs(want[k, at, i] - cosine) < 1e-4 for k, at, i, cosine in got)
    assert got == sorted(got, key=lambda g: g[:3])
