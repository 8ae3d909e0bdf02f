"""License scans with a generalised suffix automaton over template words.

The automaton accepts every run of consecutive words of every template. A text's words stream
through it; at each word it holds the longest run that ends there (matching statistics). Runs of
``LEAST`` words or more are chained per template, in order in both the text and the template, and
the chain that covers most of a template names the text's license if it covers ``COVER`` of it.

Words outside all templates reset the automaton, so only stretches of known words are streamed.
The templates are few and fixed, and each text is looked at on its own, so nothing is shuffled.

Defined cases: a null or empty text has no words, places or labels and scores 0; repeated rows are
scanned each; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ensure_columns

# Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Usual wordings of license notices and bodies, by label.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
        "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
        "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such "
        "Derivative Works in Source or Object form.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction',
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    "proprietary": ("All rights reserved.",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
}
LEAST, COVER = 3, 0.75
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,words:long,cover:double>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Words of digits, letters and characters beyond ASCII; only A-Z are lower-cased."""
    return _WORD.findall((text or "").encode().lower())


@dataclass
class Automaton:
    """A suffix automaton of several word sequences; ``ends`` has where each state's runs end."""

    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, steps: dict[bytes, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for the runs no longer than those of ``state`` plus one word."""
        copy = self._state(self.length[state] + 1, dict(self.steps[target]), self.link[target])
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def extend(self, last: int, word: bytes) -> int:
        known = self.steps[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.steps[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, word, target)
        return new

    def add(self, number: int, words: list[bytes]) -> None:
        last, passed = 0, []
        for word in words:
            last = self.extend(last, word)
            passed.append(word)
        state = 0
        for at, word in enumerate(passed):
            state = self.steps[state][word]
            self.ends[state].add((number, at))

    def finish(self) -> None:
        """Pass the ends on to the states of the runs' endings."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def statistics(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Per word: the longest run that ends there, and its state."""
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in self.steps[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.steps[state]:
                state, size = self.steps[state][word], size + 1
            out.append((size, state))
        return out


@cache
def _compiled(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, list[str], list[int], frozenset]:
    automaton, labels, sizes, known = Automaton(), [], [], set()
    for number, (label, text) in enumerate(templates):
        words = words_of(text)
        automaton.add(number, words)
        labels.append(label)
        sizes.append(len(words))
        known.update(words)
    automaton.finish()
    return automaton, labels, sizes, frozenset(known)


def _chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Best chains of one template's matches ``(text place, template place, words)``.

    A chain goes forward in the text and in the template, with gaps in the text of at most ``gap`` words, which is
    the template's length. Returned as ``(first word, words of text, words covered)``, best first, none overlapping.
    """
    matches.sort()
    longest = max((size for *_, size in matches), default=0)
    best: list[tuple[int, int]] = []  # words covered, match before
    for j, (at, place, size) in enumerate(matches):
        top = (size, -1)
        for i in range(j - 1, -1, -1):
            a, p, n = matches[i]
            if at - a > gap + longest:
                break
            if a + n <= at and p + n <= place and at - (a + n) <= gap and best[i][0] + size > top[0]:
                top = (best[i][0] + size, i)
        best.append(top)
    used: set[int] = set()
    out = []
    for j in sorted(range(len(matches)), key=lambda j: (-best[j][0], j)):
        path, k = [], j
        while k >= 0 and k not in used:
            path.append(k)
            k = best[k][1]
        if k >= 0 or not path:
            continue
        used.update(path)
        first, last = matches[path[-1]], matches[path[0]]
        out.append((first[0], last[0] + last[2] - first[0], best[j][0]))
    return out


def _scan(words: list[bytes], compiled, least: int, cover: float):
    """Spans ``label, first word, words, cover`` of all templates, and the best cover of any."""
    automaton, labels, sizes, known = compiled
    flags = np.fromiter((w in known for w in words), dtype=bool, count=len(words))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    matches: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a < least:
            continue
        runs = automaton.statistics(words[a:b])
        for k, (size, state) in enumerate(runs):
            longest = k + 1 == len(runs) or runs[k + 1][0] <= size
            if size >= least and longest:
                for number, end in automaton.ends[state]:
                    matches.setdefault(number, []).append((a + k + 1 - size, end + 1 - size, size))
    spans, best = [], 0.0
    for number, found in matches.items():
        for first, length, covered in _chains(found, sizes[number]):
            share = min(1.0, covered / sizes[number])
            best = max(best, share)
            if share >= cover:
                spans.append((labels[number], first, length, share))
    return sorted(spans, key=lambda s: (s[1], s[0], -s[2])), best


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of ``phrase`` stand consecutively, found from its last word."""
    n, out, at = len(phrase), [], -1
    while True:
        try:
            at = words.index(phrase[-1], at + 1)
        except ValueError:
            return out
        if at + 1 >= n and words[at + 1 - n : at + 1] == phrase:
            out.append(at + 1 - n)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    least: int = LEAST,
    cover: float = COVER,
) -> DataFrame:
    """Per row: word and phrase counts, labels, the best cover as ``score``, and covered ``spans``."""
    ensure_columns(docs, "doc_id", "text")
    flat = tuple((label, text) for label, texts in templates.items() for text in texts)
    wanted = [(words_of(phrase), label) for phrase, label in phrases]

    def row(text: str | None) -> tuple:
        words = words_of(text)
        places: list[int] = []
        base = set()
        present = set(words)
        for phrase, label in wanted:
            if present.issuperset(phrase) and (found := _places(words, phrase)):
                places += found
                base.add(label)
        spans, best = _scan(words, _compiled(flat), least, cover)
        labels = base | {s[0] for s in spans}
        score = 1.0 if base else best
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score,
            [dict(zip(("label", "first", "words", "cover"), s, strict=True)) for s in spans],
        )

    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("cover", pa.float64())])
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)
