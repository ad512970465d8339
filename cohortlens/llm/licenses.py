"""License scan: templates with optional and replaceable regions, compiled into word automata.

A template is plain wording with marks: ``<<beginOptional>> ... <<endOptional>>`` encloses words a
text may leave out (regions nest), ``<<var;name;low-high>>`` stands for ``low`` to ``high`` words of
any wording. All other words are mandatory and must stand in the text exactly, one after the other;
case, punctuation and white space do not count. All templates share one automaton; a text is read
only from words that some template begins with.

Null and empty texts have no words: no places, no labels, score 0. Repeated rows are judged each
for itself, ties do not arise, and extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from cohortlens.llm.common import double, long, map_texts, plain_words, string

# Phrases whose places are counted, and the label of each.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common licenses and notices.
TEMPLATES = {
    "apache-2.0": "Apache License<<beginOptional>>, Version<<endOptional>> 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may
        not use this file except in compliance with the License.
        <<beginOptional>>You may obtain a copy of the License at
        <<var;address;0-12>><<endOptional>>""",
    "gpl-2.0": """GNU General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2""",
    "gpl-3.0": """GNU General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3""",
    "gpl-or-later": """GNU General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;number;1-2>>
        <<beginOptional>>of the License<<endOptional>> or
        <<beginOptional>>(at your option)<<endOptional>> any later version""",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-sa-4.0": "CC BY-SA 4.0",
    "cc-by-nc-4.0": "CC BY-NC 4.0",
    "cc-by-nd-4.0": "CC BY-ND 4.0",
    "mit-notice": "released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all
        copies or substantial portions of the Software.""",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>>
        distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification,
        are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer.""",
    "all-rights-reserved": """<<beginOptional>>Copyright <<var;holder;0-10>><<endOptional>>
        All rights reserved""",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^;>]*;(\d+)-(\d+))>>")


class Automaton:
    """Nondeterministic automaton over words for a set of templates.

    A state is a number. ``steps`` are its edges by word, ``anything`` its edge on any word,
    ``jumps`` its edges without a word and ``ends`` the labels accepted there. Edges only lead
    forward, so a run ends after as many words as the longest template has.
    """

    def __init__(self, templates: Mapping[str, str]):
        self.steps: list[dict[bytes, int]] = []
        self.anything: list[int | None] = []
        self.jumps: list[set[int]] = []
        self.ends: dict[int, str] = {}
        for label, markup in templates.items():
            self._add(label, markup)
        self.closures = [self._closure(s) for s in range(len(self.steps))]

        begin: dict[bytes, set[int]] = {}
        for start in self.starts:
            for state in self.closures[start]:
                if state in self.ends or self.anything[state] is not None:
                    raise ValueError("a template needs a mandatory word before replaceable ones")
                for word, to in self.steps[state].items():
                    begin.setdefault(word, set()).update(self.closures[to])
        self.begin = {w: frozenset(s) for w, s in begin.items()}

    def _state(self) -> int:
        self.steps.append({})
        self.anything.append(None)
        self.jumps.append(set())
        return len(self.steps) - 1

    def _add(self, label: str, markup: str) -> None:
        at = self._state()
        self.starts = [*getattr(self, "starts", []), at]
        open_regions: list[int] = []
        done = 0
        for mark in [*_MARK.finditer(markup), None]:
            for word in plain_words(markup[done : mark.start() if mark else None].encode()):
                to = self._state()
                self.steps[at][word] = to
                at = to
            if mark is None:
                break
            done = mark.end()
            if mark[1] == "beginOptional":
                open_regions.append(at)
            elif mark[1] == "endOptional":
                if not open_regions:
                    raise ValueError(f"{label}: no optional region is open")
                to = self._state()
                self.jumps[at].add(to)
                self.jumps[open_regions.pop()].add(to)
                at = to
            else:
                low, high = int(mark[2]), int(mark[3])
                passed = [at := self._jump(at)]
                for _ in range(high):
                    to = self._state()
                    self.anything[at] = to
                    passed.append(at := to)
                end = self._state()
                for state in passed[low:]:
                    self.jumps[state].add(end)
                at = end
        if open_regions:
            raise ValueError(f"{label}: an optional region is not closed")
        self.ends[at] = label

    def _jump(self, at: int) -> int:
        to = self._state()
        self.jumps[at].add(to)
        return to

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in self.jumps[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def run(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last) of the shortest match at every start."""
        found = []
        if self.begin.keys().isdisjoint(words):
            return found
        for start, word in enumerate(words):
            states = self.begin.get(word)
            if states is None:
                continue
            here: set[str] = set()
            at = start + 1
            while states:
                for state in states:
                    label = self.ends.get(state)
                    if label is not None and label not in here:
                        here.add(label)
                        found.append((label, start, at))
                if at == len(words):
                    break
                after: set[int] = set()
                for state in states:
                    to = self.steps[state].get(words[at])
                    if to is not None:
                        after |= self.closures[to]
                    to = self.anything[state]
                    if to is not None:
                        after |= self.closures[to]
                states, at = after, at + 1
        return found


def scan(
    docs: DataFrame,
    base: Mapping[str, str] = BASE,
    templates: Mapping[str, str] = TEMPLATES,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """License findings per row: counts and places of the base phrases, labels and a score.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start. ``labels`` joins the labels of base phrases and of accepted
    templates. ``score`` is the share of the text's words that lie in a match.
    """

    def make():
        marked = {f"base\0{label}\0{phrase}": phrase for phrase, label in base.items()}
        automaton = Automaton({**marked, **templates})

        def work(texts: list[bytes]):
            rows = []
            for value in texts:
                words = plain_words(value)
                found = automaton.run(words)
                places = sorted(at for name, at, _ in found if name.startswith("base\0"))
                base_labels = {n.split("\0")[1] for n, _, _ in found if n.startswith("base\0")}
                labels = base_labels | {n for n, _, _ in found if not n.startswith("base\0")}
                covered, reached = 0, 0
                for _, start, end in sorted(found, key=lambda f: (f[1], f[2])):
                    covered += max(0, end - max(start, reached))
                    reached = max(reached, end)
                rows.append(
                    (
                        len(words),
                        len(places),
                        places[0] if places else None,
                        places[-1] if places else None,
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(labels)),
                        covered / len(words) if words else 0.0,
                    )
                )
            return list(zip(*rows, strict=True)) if rows else [[]] * 7

        return work

    fields = [
        long("n_words"),
        long("n_base"),
        long("first_word"),
        long("last_word"),
        string("base_labels"),
        string("labels"),
        double("score"),
    ]
    return map_texts(docs, make, fields, keep, text)
