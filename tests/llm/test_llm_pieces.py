import itertools
import os
import random

import pytest
import samples

from cohortlens.llm import pieces
from cohortlens.llm.queries import PIECE_MODEL

needs_model = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no model file")


@needs_model
def test_ids_are_those_of_the_library():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECE_MODEL)
    own = pieces.Pieces.load(PIECE_MODEL)
    rng = random.Random(5)
    signs = "abcdetsng  \n\té漢🙂▁ﬁ<>0x"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k + "x" + " " * (40 - k) for k in range(41)] + ["", " ", "☃", "  ☃", samples.LONG[:5000]]
    flat, ends = own.encode(texts)
    for i, text in enumerate(texts):
        ids = list(flat[ends[i] : ends[i + 1]])
        assert ids == library.encode(text), text
        assert own.decode(ids) == text.replace("▁", " ")


def best_split(word, scores, least):
    """Largest sum of scores over all ways to cut the word; single characters may be unknown."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, part = [], word[0]
        for c, cut in zip(word[1:], cuts, strict=True):
            if cut:
                parts.append(part)
                part = c
            else:
                part += c
        parts.append(part)
        if all(p in scores or len(p) == 1 for p in parts):
            total = sum(scores.get(p, least) for p in parts)
            best = total if best is None else max(best, total)
    return best


def test_unigram_finds_the_best_split():
    rng = random.Random(2)
    vocabulary = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.5)]
    vocabulary += [(p, -rng.uniform(1, 4)) for p in ("ab", "ba", "aab", "▁a", "▁ab", "bb", "abab")]
    own = pieces.Pieces(vocabulary, "unigram", {0})
    scores = dict(vocabulary[1:])
    words = {"".join(w) for n in range(7) for w in itertools.product("abc", repeat=n)}
    found = own.encode_words(words)
    for word in words:
        ids = found[word]
        total = sum(own.scores[i] if i else own.least for i in ids)
        assert total == pytest.approx(best_split("▁" + word, scores, own.least))


@needs_model
def test_tables_of_any_rows(spark):
    docs = samples.documents(spark)
    got = pieces.encode(docs, PIECE_MODEL)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (0, 1))
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(got, PIECE_MODEL).collect()}
    assert back == {(r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in docs.collect()}
    assert pieces.encode(samples.empty(spark), PIECE_MODEL).count() == 0


@needs_model
def test_ids_outside_the_model_are_refused():
    own = pieces.Pieces.load(PIECE_MODEL)
    with pytest.raises(ValueError):
        own.decode([10**6])
