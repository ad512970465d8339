import random
import re

import pytest
import samples

from cohortlens.llm import licenses
from cohortlens.llm.common import plain_words


def as_pattern(markup):
    """The same template as a regular expression over words that are followed by one blank."""
    out, at = "", 0
    for m in [*re.finditer(r"<<(beginOptional|endOptional|var;[^;]*;(\d+)-(\d+))>>", markup), None]:
        out += "".join(f"{re.escape(w.decode())} " for w in plain_words(markup[at : m.start() if m else None].encode()))
        if m is None:
            return out
        at = m.end()
        kind = m[1]
        out += "(?:" if kind == "beginOptional" else ")?" if kind == "endOptional" else rf"(?:\S+ ){{{m[2]},{m[3]}}}"


def test_places_are_those_of_regular_expressions():
    rng = random.Random(1)
    vocabulary = [
        "gnu general public license", "version", "version 2", "version 3", "as published by the free software foundation",
        "either", "of the license", "or", "at your option", "any later version", "released under the", "terms of the",
        "mit license", "copyright", "jane", "all rights reserved", "cc by", "nc", "4 0", "apache license", "2 0",
    ]
    automaton = licenses.Automaton(licenses.TEMPLATES)
    patterns = {k: re.compile(as_pattern(v)) for k, v in licenses.TEMPLATES.items()}
    full = [re.sub("<<[^v][^>]*>>", " ", re.sub("<<var[^>]*>>", " x ", t)) for t in licenses.TEMPLATES.values()]
    texts = [samples.words(rng, 60, vocabulary) for _ in range(400)]
    texts += [f"{samples.words(rng, 5, vocabulary)} {t} {samples.words(rng, 5, vocabulary)}" for t in full]
    hits = 0
    for text in texts:
        found = plain_words(text.encode())
        line = "".join(f"{w.decode()} " for w in found)
        starts = [0, *(m.end() for m in re.finditer(" ", line))][:-1]
        want = {(k, i) for k, p in patterns.items() for i, at in enumerate(starts) if p.match(line, at)}
        got = {(label, start) for label, start, _ in automaton.run(found)}
        assert got == want
        hits += len(want)
    assert hits > 100
    assert {label for t in texts for label, _, _ in automaton.run(plain_words(t.encode()))} == set(licenses.TEMPLATES)


def test_base_counts_every_place(spark):
    text = "MIT License. The GNU-General public LICENSE, cc by and CC BY; apache\nlicense mit license"
    docs = samples.documents(spark, [(50, text), (51, "mit-licensee, mit  x license")])
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    r = rows[50]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (16, 6, 0, 14)
    assert r["base_labels"] == "apache,cc-by,gpl,mit"
    assert 0 < r["score"] <= 1
    assert (rows[51]["n_base"], rows[51]["first_word"], rows[51]["labels"], rows[51]["score"]) == (0, None, "", 0.0)
    assert rows[0]["n_words"] == rows[1]["n_words"] == 0 and rows[0]["labels"] == ""
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(samples.empty(spark)).count() == 0


def test_regions_may_be_left_out_and_replaced_but_not_the_wording():
    a = licenses.Automaton({"x": "grant <<beginOptional>>free <<beginOptional>>of charge<<endOptional>><<endOptional>> to <<var;who;1-3>> use"})
    accepted = ["grant to me use", "grant free to you and me use", "grant free of charge to x use"]
    refused = ["grant to use", "grant of charge to me use", "grant to a b c d use", "grant to me used"]
    assert all(a.run(plain_words(t.encode())) for t in accepted)
    assert not any(a.run(plain_words(t.encode())) for t in refused)
    for wrong in ("<<var;a;0-2>> x", "<<beginOptional>> x", "x <<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton({"x": wrong})
