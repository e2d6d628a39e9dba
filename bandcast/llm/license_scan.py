"""License scans with a generalised suffix automaton over the words of licence templates.

The automaton has one state per class of word runs that end at the same
places of the templates.  A text is streamed through it word by word: the
matching statistic after a word is the length of the longest run ending there
that occurs in some template, and the state tells where.  Runs that cannot be
extended are seeds; seeds of one template that follow each other in the text
and in the template are chained, a chain covers a span of the template, and
the covered share of its words is the template's score in the text.

Short phrases are templates too: a phrase ends at a word exactly if the
matching statistic there reaches the phrase's length and the phrase's state is
the current state or one of its suffixes, so every place of a phrase is found
on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import LOWER_BYTES, prepare

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence notices, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
        the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license,
        visit http://creativecommons.org/licenses/by/4.0/""",
    "cc0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
        software to the public domain worldwide. This software is distributed without any warranty.""",
}

SEED_WORDS = 4              # shortest run that is a seed
GAP_WORDS = 64              # most words of the text between seeds of one chain
MIN_SHARE = 0.5             # covered share from which a template's label is given
CHUNK = 1 << 20             # characters of a text split into words at a time

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")       # before A-Z are lower-cased


def lowered(text: str) -> str:
    """A-Z as a-z, all else unchanged."""
    return text.encode().translate(LOWER_BYTES).decode()


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lists, a bounded stretch of text at a time."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(lowered(text[at:end]))
        at = end


class Automaton:
    """Generalised suffix automaton of templates (lists of word numbers)."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, seq in enumerate(templates):
            last = 0
            for at, w in enumerate(seq):
                last = self._extend(last, w, ends)
                ends[last].append((t, at + 1))
        #: places (template, words up to the end) of a state's runs, longest states first into their suffixes
        self.ends = ends
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                ends[self.link[v]].extend(ends[v])

    def _new(self, length: int, link: int, edges: dict[int, int], ends: list) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int, ends: list) -> int:
        """The state of the runs of ``q`` that ``p`` reaches by ``w``, parted from the longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:                   # the run is there already, from an earlier template
            return self._split(last, q, w, ends)
        made, p = self._new(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][w], w, ends)
        return made

    def find(self, seq: list[int]) -> int:
        v = 0
        for w in seq:
            v = self.next[v][w]
        return v


class Scanner:
    """Phrases and templates in one automaton."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.numbers: dict[str, int] = {}
        split = lambda t: [self.numbers.setdefault(w, len(self.numbers)) for ws in words(t) for w in ws]
        sequences = [(split(text), label) for text, label in phrases.items()]
        self.n_phrases = len(sequences)
        sequences += [(split(text), label) for label, text in templates.items()]
        self.labels = [label for _, label in sequences]
        self.sizes = [len(seq) for seq, _ in sequences]
        if 0 in self.sizes:
            raise ValueError("a phrase or template has no words")
        self.automaton = Automaton([seq for seq, _ in sequences])
        own: dict[int, list[int]] = {}
        for p, (seq, _) in enumerate(sequences[:self.n_phrases]):
            own.setdefault(self.automaton.find(seq), []).append(p)
        #: phrases that are a suffix of a state's longest run, by state
        self.phrases: list[tuple[int, ...]] = [()] * len(self.automaton.length)
        for v in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[v] = (*own.get(v, ()), *(self.phrases[self.automaton.link[v]] if self.automaton.link[v] > 0 else ()))

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, set[str], dict[int, tuple[int, int, int]]]:
        """Words, places of phrases, their first and last start, their labels, and per template
        the best chain: (template words covered, first word, last word)."""
        edges, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        known, sizes = self.numbers.get, self.sizes
        n = places = 0
        first = last = None
        found: set[str] = set()
        chains = Chains(self)
        v = size = 0
        for block in words(text):
            for i, w in enumerate(map(known, block), n):
                if w is None:
                    if v:
                        chains.seed(v, size, i)
                        v = size = 0
                    continue
                if w not in edges[v]:
                    chains.seed(v, size, i)
                    while v and w not in edges[v]:
                        v = link[v]
                        size = length[v]
                if w in edges[v]:
                    v = edges[v][w]
                    size += 1
                for p in phrases[v]:
                    if sizes[p] <= size:
                        places += 1
                        start = i + 1 - sizes[p]
                        first = start if first is None else min(first, start)
                        last = start if last is None else max(last, start)
                        found.add(self.labels[p])
            n += len(block)
        chains.seed(v, size, n)
        return n, places, first, last, found, chains.best


class Chains:
    """Chains of seeds per template, kept for the last ``GAP_WORDS`` words of the text only."""

    def __init__(self, scanner: Scanner):
        self.scanner = scanner
        self.open: dict[int, list[tuple[int, int, int, int]]] = {}      # template: (text end, template end, covered, first word)
        self.best: dict[int, tuple[int, int, int]] = {}

    def seed(self, state: int, size: int, end: int) -> None:
        """A run of ``size`` words ends before word ``end`` of the text."""
        if size < SEED_WORDS:
            return
        for t, at in self.scanner.automaton.ends[state]:
            if t < self.scanner.n_phrases:
                continue
            seeds = [s for s in self.open.get(t, ()) if s[0] >= end - size - GAP_WORDS]
            covered, first = size, end - size
            for text_end, template_end, sum_, begin in seeds:
                more = min(size, end - text_end, at - template_end)     # words of the run behind both ends
                if more > 0 and (sum_ + more, begin) > (covered, first):
                    covered, first = sum_ + more, begin
            self.open[t] = [*seeds, (end, at, covered, first)]
            if covered > self.best.get(t, (0,))[0]:
                self.best[t] = (covered, first, end - 1)


_SCANNERS: dict[tuple, Scanner] = {}


def scanner_of(phrases: Mapping[str, str], templates: Mapping[str, str]) -> Scanner:
    """One per worker and set of templates."""
    key = (tuple(phrases.items()), tuple(templates.items()))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(phrases, templates)
    return _SCANNERS[key]


NAMES = ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
         templates: Mapping[str, str] = TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base`` (places where a phrase's words stand
    consecutively), ``first_word`` and ``last_word`` (smallest and largest start of such a place,
    words from 0; null if none), ``base_labels``, ``labels``, ``score``, ``spans``.

    ``base_labels`` are those of the phrases found; ``labels`` adds those of
    templates of which a chain covers ``min_share`` or more; both distinct,
    sorted, comma-joined.  ``score`` is 1 if a phrase is found, else the
    largest covered share of a template.  ``spans`` has the best chain of each
    template that gives its label (ties: the earliest in the text): first and
    last word of the text, words of the template covered and their share.

    ``phrases`` maps phrases to labels, ``templates`` labels to texts; both
    are parameters of bounded size that every worker indexes itself.  Nothing
    is shuffled and a text streams through in bounded memory.

    Null text counts as empty and has no words; repeated rows get the same
    answer; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    phrases, templates = dict(phrases), dict(templates)
    frame = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(phrases, templates)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                n, places, first, last, found, best = scanner.scan(text)
                shares = {t: covered / scanner.sizes[t] for t, (covered, _, _) in best.items()}
                spans = [{"label": scanner.labels[t], "first_word": best[t][1], "last_word": best[t][2], "covered": best[t][0], "share": shares[t]}
                         for t in sorted(best) if shares[t] >= min_share]
                labels = sorted(found | {s["label"] for s in spans})
                rows.append((n, places, first, last, ",".join(sorted(found)), ",".join(labels),
                             1.0 if found else max(shares.values(), default=0.0), spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(SPAN)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], NAMES)

    made = frame.mapInArrow(run, f"_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                                 "labels string, score double, "
                                 "spans array<struct<label: string, first_word: bigint, last_word: bigint, covered: bigint, share: double>>")
    return made.withColumnRenamed("_id", id_col)
