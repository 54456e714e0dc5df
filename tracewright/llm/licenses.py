"""Licence scans: a generalised suffix automaton over the words of licence texts, matching statistics, chained spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import byte_table, doc_text, lean, pieces, slices

_WORD = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)

#: Phrases whose every place is reported, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence texts and notices by label. A label may have several.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)


class Automaton:
    """All substrings of several word sequences: one state for the substrings that end at the same places.

    ``ends[s]`` names the phrases that are suffixes of state s, each with the length that a match must have; ``places[s]``
    has every (template, end) of the state's substrings.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        split = lambda text: [w for part in pieces(pa.scalar(text), _WORD) for w in part]
        self.labels, self.phrases = [label for label, _ in templates], [label for _, label in phrases]
        texts, spoken = [split(text) for _, text in templates], [split(phrase) for phrase, _ in phrases]
        if not all(texts) or not all(spoken):
            raise ValueError("a template or phrase without words")
        self.sizes, self.phrase_sizes = [len(t) for t in texts], [len(p) for p in spoken]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in (*texts, *spoken) for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ended: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate((*texts, *spoken)):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._extend(last, self.vocabulary[w])
                if k < len(texts):
                    ended.setdefault(last, []).append((k, end))
        places: list[set[tuple[int, int]]] = [set(ended.get(s, ())) for s in range(len(self.next))]
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(by_length):
            if self.link[s] > 0:
                places[self.link[s]] |= places[s]
        self.places = [tuple(sorted(p)) for p in places]
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(spoken):
            s = 0
            for w in words:
                s = self.next[s][self.vocabulary[w]]
            whole.setdefault(s, []).append((k, len(words)))
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in by_length:
            self.ends[s] = (*whole.get(s, ()), *self.ends[self.link[s]])

    def _extend(self, last: int, w: int) -> int:
        """The state of ``last``'s longest substring with the word ``w`` behind it."""
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            old = self.next[last][w]
            self.link[new] = old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
        return new

    def _split(self, last: int, w: int, old: int) -> int:
        """The part of ``old`` that is as long as ``last`` and one word, as a state of its own."""
        part = self._state(self.length[last] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = part
        while last >= 0 and self.next[last].get(w) == old:
            self.next[last][w] = part
            last = self.link[last]
        return part

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


@dataclass
class Found:
    """What one text holds: its number of words, (phrase, start) of every phrase, and the matches that no further word
    extends, of at least the wanted length, as (end, length, state)."""

    words: int
    phrases: list[tuple[int, int]]
    matches: list[tuple[int, int, int]]


def walk(automaton: Automaton, text: pa.StringScalar, least: int) -> Found:
    """The matching statistics of a text: after each word, the longest suffix that some template holds."""
    following, link, length, ends, word = automaton.next, automaton.link, automaton.length, automaton.ends, automaton.vocabulary.get
    at, state, held = 0, 0, 0
    spoken, matches = [], []
    for words in pieces(text, _WORD):
        for w in map(word, words):
            if w is None:
                if held >= least:
                    matches.append((at, held, state))
                state = held = 0
                at += 1
                continue
            to = following[state].get(w)
            if to is None:
                if held >= least:
                    matches.append((at, held, state))
                while to is None:  # the first state knows every word of the vocabulary
                    state = link[state]
                    held = length[state]
                    to = following[state].get(w)
            state = to
            held += 1
            at += 1
            for phrase, size in ends[state]:
                if held >= size:
                    spoken.append((phrase, at - size))
    if held >= least:
        matches.append((at, held, state))
    return Found(at, spoken, matches)


def chained(automaton: Automaton, matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int, int]]:
    """(template, start, end, covered): matches of a template in order, at most ``max_gap`` words apart in text and
    template, as spans; ``covered`` counts the template's words that they match.

    A match follows the chain that covers most among those it can follow. Only chains that ended at most ``max_gap`` words
    ago can be followed, and a text's words end at most one match each, so the work grows with the matches alone.
    """
    spans: list[tuple[int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: (end in text, end in template, start in text, covered)

    def close(template: int) -> None:
        taken: list[tuple[int, int]] = []
        for end, _, start, covered in sorted(open_.pop(template), key=lambda c: (-c[3], c[2], c[0])):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                spans.append((template, start, end, covered))

    for end, size, state in matches:
        for template, place in automaton.places[state]:
            chains = open_.get(template, [])
            if chains and end - size - chains[-1][0] > max_gap:
                close(template)
                chains = []
            best = (end, place, end - size, size)
            for a in reversed(chains):
                if end - size - a[0] > max_gap:
                    break
                twice = max(0, a[0] - (end - size), a[1] - (place - size))
                if a[1] < place and a[0] < end and place - size - a[1] <= max_gap and twice < size and a[3] + size - twice > best[3]:
                    best = (end, place, a[2], a[3] + size - twice)
            open_.setdefault(template, chains).append(best)
    for template in list(open_):
        close(template)
    return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


SPANS = "array<struct<label:string,start:long,end:long,covered:double>>"


def scan(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, min_words: int = 4, max_gap: int = 12) -> DataFrame:
    """(doc_id, n_words, phrases array of (label, start), spans array of (label, start, end, covered)) of every whole text.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered. Texts stream through the automaton a
    piece at a time; a phrase is found where the matched suffix ends with it, whatever else matches there. A span is a
    chain of matches of ``min_words`` words or more of one template, with at most ``max_gap`` words between them;
    ``covered`` is the share of the template's words in it. Spans of different templates may overlap. Null and empty texts
    have no words; repeated rows are scanned one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
        for part in slices(batches):
            rows = []
            for text in part.column("text"):
                found = walk(automaton, text, min_words)
                covers = [(automaton.labels[t], a, b, n / automaton.sizes[t]) for t, a, b, n in chained(automaton, found.matches, max_gap)]
                rows.append((found.words, [(automaton.phrases[p], a) for p, a in found.phrases], covers))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"label": a, "start": b} for a, b in r[1]] for r in rows], kind),
                 pa.array([[{"label": a, "start": b, "end": c, "covered": d} for a, b, c, d in r[2]] for r in rows], spans)], ["doc_id", "n_words", "phrases", "spans"],
            )

    return doc_text(docs).mapInArrow(lean(run), f"doc_id long, n_words long, phrases array<struct<label:string,start:long>>, spans {SPANS}")


def report(scanned: DataFrame, *, min_covered: float = 0.6) -> DataFrame:
    """Of :func:`scan`, per row: n_words, n_base (places of phrases), first_word and last_word (their least and greatest
    start, null without any), base_labels (of phrases), labels (with those of the spans that cover at least ``min_covered``
    of a template; both distinct, sorted, comma-joined) and score (the largest share of one template or phrase that a span
    covers, 0 without any). A text without words has no labels and score 0."""
    base = F.transform("phrases", lambda p: p["label"])
    starts = F.transform("phrases", lambda p: p["start"])
    good = F.transform(F.filter("spans", lambda s: s["covered"] >= min_covered), lambda s: s["label"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, good)).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )
