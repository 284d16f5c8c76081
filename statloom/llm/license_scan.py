"""License scans with a generalised suffix automaton of license tokens.

The automaton recognises every run of consecutive tokens of every template. A text is streamed
through it once; after each word the state tells the longest run of license tokens that ends there
(the matching statistic). For each template the matches that go on neither way in that template are chained
into spans, in the order of both text and template and with bounded gaps, so a template that stands within a
longer run of another one keeps its own match. The automaton is a few thousand states, fixed by the
templates and not by the data; texts need no shuffle.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from statloom.llm.text import ascii_words, byte_texts, small_batches

# Phrases and their labels; every place where one stands counts.
BASE_PHRASES: Mapping[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of public license notices, each with the label its presence gives.
NOTICES: Sequence[tuple[str, str]] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mit-notice", "Released under the MIT License"),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
)

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, covered: long, coverage: double>>"
)
SPAN_TYPE = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("covered", pa.int64()),
            ("coverage", pa.float64()),
        ]
    )
)


@dataclass
class State:
    length: int = 0
    link: int = -1
    step: dict[int, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)
    phrases: list[tuple[int, int]] = field(default_factory=list)


class LicenseAutomaton:
    """Suffix automaton over several token sequences; phrase i stands before notice texts."""

    def __init__(self, phrases: Mapping[str, str], notices: Sequence[tuple[str, str]]):
        self.phrase_labels = list(phrases.values())
        self.labels = self.phrase_labels + [label for label, _ in notices]
        texts = list(phrases) + [text for _, text in notices]
        self.templates = [ascii_words(t.encode()) for t in texts]
        self.vocabulary: dict[bytes, int] = {}
        for words in self.templates:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.states = [State()]
        for number, words in enumerate(self.templates):
            at = 0
            for place, w in enumerate(words):
                at = self._extend(at, self.vocabulary[w])
                self.states[at].ends.add((number, place))
        by_length = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in by_length:  # a shorter context occurs wherever a longer one does
            self.states[self.states[s].link].ends |= self.states[s].ends
        self.states[0].ends = set()
        for number in range(len(self.phrase_labels)):
            self.states[self.walk(self.templates[number])].phrases.append((number, len(self.templates[number])))
        for s in reversed(by_length):
            self.states[s].phrases = self.states[s].phrases + self.states[self.states[s].link].phrases

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        known = states[last].step.get(token)
        if known is not None and states[known].length == states[last].length + 1:
            return known
        if known is not None:
            return self._split(last, token, known)
        new = len(states)
        states.append(State(length=states[last].length + 1))
        at = last
        while at != -1 and token not in states[at].step:
            states[at].step[token] = new
            at = states[at].link
        if at == -1:
            states[new].link = 0
        else:
            target = states[at].step[token]
            fits = states[target].length == states[at].length + 1
            states[new].link = target if fits else self._split(at, token, target)
        return new

    def _split(self, at: int, token: int, target: int) -> int:
        """A copy of ``target`` for the contexts no longer than ``at`` plus the token."""
        states = self.states
        old = states[target]
        copy = len(states)
        states.append(State(states[at].length + 1, old.link, dict(old.step), set(old.ends)))
        while at != -1 and states[at].step.get(token) == target:
            states[at].step[token] = copy
            at = states[at].link
        old.link = copy
        return copy

    def walk(self, words: Sequence[bytes]) -> int:
        at = 0
        for w in words:
            at = self.states[at].step[self.vocabulary[w]]
        return at

    def statistics(self, words: Sequence[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, match length) after each word of the vocabulary; other words reset the match."""
        get, states = self.vocabulary.get, self.states
        state = length = 0
        before = -2
        for place, token in [(i, t) for i, t in enumerate(map(get, words)) if t is not None]:
            if place != before + 1:
                state = length = 0
            before = place
            while state and token not in states[state].step:
                state = states[state].link
                length = states[state].length
            if token in states[state].step:
                state = states[state].step[token]
                length += 1
            yield place, state, length

    def occurrences(self, state: int, length: int, min_match: int) -> dict[tuple[int, int], int]:
        """Template places where the match ends, each with the longest run of words that ends there."""
        found: dict[tuple[int, int], int] = {}
        while state and length >= min_match:
            for place in self.states[state].ends:
                found.setdefault(place, length)
            state = self.states[state].link
            length = self.states[state].length
        return found

    def scan(self, words: Sequence[bytes], min_match: int, max_gap: int, min_coverage: float) -> dict:
        """Phrase places and chained spans of one text."""
        starts: list[int] = []
        found: set[str] = set()
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        held: dict[tuple[int, int], int] = {}
        before = -1

        def close(going_on: Mapping[tuple[int, int], int]) -> None:
            for (number, end), size in held.items():
                if (number, end + 1) not in going_on and number >= len(self.phrase_labels):
                    pieces.setdefault(number, []).append((before - size + 1, end - size + 1, size))

        for place, state, length in self.statistics(words):
            if held or length >= min_match:
                ending = self.occurrences(state, length, min_match)
                close(ending if place == before + 1 else {})
                held, before = ending, place
            for number, size in self.states[state].phrases:
                if size <= length:
                    starts.append(place - size + 1)
                    found.add(self.phrase_labels[number])
        close({})
        spans, best = self._chain(pieces, max_gap, min_coverage)
        return {
            "starts": starts,
            "base": sorted(found),
            "labels": sorted(found | {s["label"] for s in spans}),
            "score": 1.0 if starts else best,
            "spans": spans,
        }

    def _chain(self, pieces: dict[int, list[tuple[int, int, int]]], max_gap: int, min_coverage: float):
        """Best chains of matches in text and template order; looks back over ``max_gap`` words only."""
        spans, best = [], 0.0
        for number, own in pieces.items():
            own.sort()
            size = len(self.templates[number])
            chains: list[tuple[int, int, int, int]] = []  # covered, first word, last word, place in the template
            open_from = 0
            for start, inside, length in own:
                while open_from < len(chains) and chains[open_from][2] < start - max_gap - size:
                    open_from += 1
                covered, first = length, start
                for c, f, last, end in chains[open_from:]:
                    if last < start and end < inside and start - last <= max_gap and inside - end <= max_gap:
                        if c + length > covered:
                            covered, first = c + length, f
                chains.append((covered, first, start + length - 1, inside + length - 1))
            taken: list[tuple[int, int]] = []  # disjoint and in order
            for covered, first, last, _ in sorted(chains, reverse=True):
                share = min(1.0, covered / size)
                best = max(best, share)
                if share < min_coverage:
                    break
                at = bisect.bisect(taken, (first, last))
                if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
                    continue
                taken.insert(at, (first, last))
                spans.append(
                    {
                        "label": self.labels[number],
                        "first_word": first,
                        "last_word": last,
                        "covered": covered,
                        "coverage": share,
                    }
                )
        spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"]))
        return spans, best


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE_PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_match: int = 3,
    max_gap: int = 12,
    min_coverage: float = 0.75,
) -> DataFrame:
    """Scan every text; one row per input row with the id column, the fields of SCHEMA and the spans.

    ``labels`` joins the labels of the phrases found and of the notices covered to ``min_coverage``;
    ``score`` is 1 where a phrase stands, else the best share of a notice that a chain covers.
    Null and empty texts have no words, null places, empty labels and score 0. Repeated rows and
    null ids are scanned like any other; further columns are not carried.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenseAutomaton(phrases, notices)
        for batch in small_batches(batches):
            out: dict[str, list] = {name: [] for name in (f.split()[0] for f in SCHEMA.split(", ")[:7])}
            spans = []
            for data in byte_texts(batch, text_column):
                words = ascii_words(data)
                got = automaton.scan(words, min_match, max_gap, min_coverage)
                out["n_words"].append(len(words))
                out["n_base"].append(len(got["starts"]))
                out["first_word"].append(min(got["starts"], default=None))
                out["last_word"].append(max(got["starts"], default=None))
                out["base_labels"].append(",".join(got["base"]))
                out["labels"].append(",".join(got["labels"]))
                out["score"].append(float(got["score"]))
                spans.append(got["spans"])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(v, k) for v, k in zip(out.values(), kinds)]
                + [pa.array(spans, SPAN_TYPE)],
                names=[id_column, *out, "spans"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(scan, f"`{id_column}` {kind}, {SCHEMA}")
