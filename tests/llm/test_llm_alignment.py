import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import samples
from pyspark.sql import functions as F

from cohortlens.llm import alignment
from cohortlens.llm.queries import BYTE_LEVEL, PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_LEVEL), reason="no model files")

SIGNS = "abcdest  \n\t,.'é漢🙂▁ﬁ<>0x1"


def texts(n, seed=4):
    rng = random.Random(seed)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    made += ["the end", " the  end ", "the end\n the end", "<|endoftext|> <s> it's", "漢字" * 300, "x " * 300]
    made += ["a  b", "a　 b c", "tab\t end", " ", "\n", "a \n b", "\x1c d", "e\x85 f"]
    return made


@pytest.fixture(scope="module")
def models():
    return alignment.Tokenizers(BYTE_LEVEL, PIECE_MODEL)


def whole(models, text):
    """Spans of both tokenizers over the whole text, by the libraries alone."""
    a = models.a.encode(" " + text, add_special_tokens=False).ids
    b = models.b.encode(text)
    signs = alignment._byte_signs()
    names = [bytes(signs[c] for c in models.a.id_to_token(i)) for i in a]
    pieces = [
        bytes([int(models.b.id_to_piece(i)[3:5], 16)])
        if models.b.is_byte(i)
        else models.b.id_to_piece(i).replace("▁", " ").encode()
        for i in b
    ]
    spelled = (" " + text).encode()
    if not text or b"".join(names) != spelled or b"".join(pieces) != spelled:
        return [], []

    def spans(ids, parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends, ids, strict=True))

    return spans(a, names), spans(b, pieces)


def brute(models, rows):
    """Every result by comparing all pairs of tokens."""
    links, found = [], {}
    for key, text in rows:
        a, b = whole(models, text or "")
        met = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        parts, start = [], 0
        for end in ends:
            inside = [[t[2] for t in side if start <= t[0] and t[1] <= end] for side in (a, b)]
            parts.append("|".join(",".join(map(str, ids)) for ids in inside))
            start = end
        digest = sha256(";".join(parts).encode()).hexdigest() if a else ""
        links += met
        found[key] = (len(a), len(b), len(ends), met, digest)
    counts = Counter(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return {
        key: (n_a, n_b, n_groups, len(met), sum(counts[p] == best[p[1]] for p in met),
              sum(counts[p] for p in met), digest)
        for key, (n_a, n_b, n_groups, met, digest) in found.items()
    }


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def result(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_pieces_of_a_text_have_the_ids_of_the_whole(models):
    for text in texts(1500):
        if not text:
            continue
        a, b = models.ids(models.pieces_of(text))
        assert a == models.a.encode(" " + text, add_special_tokens=False).ids
        assert b == models.b.encode(text), repr(text)


WHITES = ["\u200b", "\u180e", "\u2028", "\x85", "\x1c", "\xa0", "\u3000", "\u200c"]
ODD = [f"{x}{w}{y}" for w in WHITES for x in ("a", "a ", "") for y in ("b c", " b", "")]


def test_texts_cut_by_columns_are_the_pieces_of_each(models):
    made = ["", *texts(1500), *ODD]
    pieces, counts = models.cut(pa.array(made))
    assert counts.tolist() == [len(models.pieces_of(t)) if t else 0 for t in made]
    assert pieces.to_pylist() == [p for t in made if t for p in models.pieces_of(t)]


def test_pieces_have_the_same_ids_alone_and_together(models):
    made = [t for t in [*texts(1500), *ODD] if t]
    for text in made:
        a, b = zip(*(models.ids([p]) for p in models.pieces_of(text)), strict=True)
        assert sum(a, []) == models.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert sum(b, []) == models.b.encode(text), repr(text)
    pieces = list({p: None for t in made for p in models.pieces_of(t) if p[-1] not in " \n\t"})
    random.Random(1).shuffle(pieces)
    a, b = zip(*(models.ids([p]) for p in pieces), strict=True)
    assert models.ids(pieces) == (sum(a, []), sum(b, []))


def test_pieces_with_line_breaks_share_a_text(models, monkeypatch):
    pieces = [f"end{i}.\nThen" for i in range(alignment.TOGETHER)]
    alone = [models.ids([p]) for p in pieces]
    given, real = [], models.b

    class Counted:
        def encode(self, texts, **more):
            given.extend(texts)
            return real.encode(texts, **more)

    monkeypatch.setattr(models, "b", Counted())
    assert models.ids(pieces) == tuple(sum(side, []) for side in zip(*alone, strict=True))
    assert len(given) == 1


def test_new_pieces_are_aligned_together(models, monkeypatch):
    calls, real = [], alignment.align_windows
    monkeypatch.setattr(alignment, "align_windows", lambda *x: calls.append(1) or real(*x))
    windows = alignment.Windows(models)
    windows.of_texts([f"one{i} two{i}  three{i}.\n four{i}" for i in range(200)])
    assert len(calls) <= 2


def test_groups_of_empty_and_unspelled_texts(spark):
    docs = spark.createDataFrame([(0, ""), (1, "the ▁ end"), (2, None), (3, "the end")], "doc_id long, text string")
    for rows in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).coalesce(1)):
        got = {r["doc_id"]: len(r["groups"]) for r in alignment.groups(rows, BYTE_LEVEL, PIECE_MODEL).collect()}
        assert got[0] == got[1] == got[2] == 0 < got[3]


def test_every_column_equals_brute_force(spark, models):
    rows = list(enumerate([None, *texts(150)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(models, rows)
    assert result(alignment.digests(docs, BYTE_LEVEL, PIECE_MODEL)) == want
    # with room for few pairs nearly all counts travel by the join
    assert result(alignment.digests(docs, BYTE_LEVEL, PIECE_MODEL, listed=5)) == want


def test_windows_that_are_forgotten_are_counted(spark, models):
    rows = list(enumerate(texts(40, seed=9)))
    windows = alignment.Windows(models)
    total = Counter()
    for _, text in rows:
        (found,) = windows.of_texts([text])
        windows.count(np.array(found or [], np.int64))
        pairs, n = windows.counted_links()
        total.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
        windows.clear()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = alignment.aligned(docs, BYTE_LEVEL, PIECE_MODEL)[1].collect()
    assert {r["a"] << 32 | r["b"]: r["n"] for r in counted} == dict(total)


def test_groups_spell_the_text(spark, models):
    rows = list(enumerate(texts(60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in alignment.groups(docs, BYTE_LEVEL, PIECE_MODEL).collect():
        for g in r["groups"]:
            left = b"".join(models.a_bytes[i] for i in g["a"])
            assert left == b"".join(models.b_bytes[i] for i in g["b"])
        spelled = b"".join(models.a_bytes[i] for g in r["groups"] for i in g["a"])
        text = dict(rows)[r["doc_id"]]
        assert spelled in (b"", (" " + text).encode())


def test_tables_of_any_rows(spark, models):
    docs = samples.documents(spark).withColumn("n_best", F.lit("other"))
    got = alignment.digests(docs, BYTE_LEVEL, PIECE_MODEL).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["n_a"] == by_id[i]["count_sum"] == 0 and by_id[i]["groups_sha256"] == "" for i in (0, 1, 8))
    assert sum(r["doc_id"] == 5 for r in got) == 2 and by_id[5]["n_links"] > 0
    assert by_id[7]["n_a"] == len(models.a.encode(" " + samples.LONG, add_special_tokens=False).ids)
    empty = alignment.digests(samples.empty(spark), BYTE_LEVEL, PIECE_MODEL)
    assert empty.count() == 0 and empty.columns == ["doc_id", *COLUMNS]
