"""License scans by patience alignment of texts with license templates.

A template is looked for where enough of its words stand close together; there the words
that are unique in both are matched, the longest increasing run of them anchors the
alignment, and the gaps between anchors are aligned in the same way. Coverage is the share
of the template's words that the alignment matches; the words that tell sibling licenses
apart must be among them, and no other such word may stand between them. Texts are independent: one map.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from relloom.llm.common import Batches, map_batches, steps, text_columns

#: Public license notices, a template each (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
WORD = re.compile(r"[^\W_]+")
#: Words that tell sibling licenses apart; numbers do too. A template's must all be matched.
NAMES = frozenset(
    "apache mit bsd gnu gpl lgpl agpl mozilla mpl isc general public creative commons cc by attribution international".split()
)
#: Words that make another license of one, wherever they are put in.
QUALIFIERS = frozenset("lesser affero lgpl agpl nc sa nd noncommercial sharealike noderivatives noderivs".split())
#: Words that do so in a template of at most SHORT words, where inserted words count, too.
SHORT_QUALIFIERS = NAMES | {"library", "non", "commercial", "share", "alike", "no", "derivatives", "derivs", "unported"}
SHORT = 20


class Match(NamedTuple):
    license: str
    first: int
    end: int
    matched: int
    coverage: float


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def telling(word: str) -> bool:
    return word in NAMES or word in QUALIFIERS or word.isdigit()


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles with back links."""
    tops: list[int] = []
    at: list[int] = []
    below: list[int] = []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        below.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = below[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words of ``a`` and ``b``, both ascending, by patience.

    Equal ends of a part are matched first. Words unique in both parts anchor the rest; a
    part without such words is left unmatched.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        both = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [both[k] for k in increasing([y for _, y in both])]
        if not anchors:
            continue
        pairs += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


class Templates:
    """Templates by name, with the words that make them up."""

    def __init__(self, texts: dict[str, str], coverage: float, stretch: float):
        self.coverage, self.stretch = coverage, stretch
        self.parts = {name: words(text) for name, text in texts.items()}
        self.counts = {name: Counter(part) for name, part in self.parts.items()}
        self.least = {name: max(1, -int(-coverage * len(part) // 1)) for name, part in self.parts.items()}
        self.telling = {n: {w for w in part if telling(w)} for n, part in self.parts.items()}
        self.all = set().union(*self.parts.values()) if self.parts else set()

    def regions(self, name: str, hits: list[tuple[int, str]]) -> list[tuple[int, int]]:
        """Stretches of the text that hold enough of the template's words.

        Every run of at most ``stretch`` template lengths with ``least`` of its words, each
        counted as often as the template has it, lies in one of them.
        """
        counts, least = self.counts[name], self.least[name]
        width = int(self.stretch * len(self.parts[name])) + 1
        found: list[tuple[int, int]] = []
        inside: Counter[str] = Counter()
        have = start = 0
        for at, word in hits:
            while hits[start][0] <= at - width:
                gone = hits[start][1]
                have -= inside[gone] <= counts[gone]
                inside[gone] -= 1
                start += 1
            inside[word] += 1
            have += inside[word] <= counts[word]
            if have >= least:
                a, b = hits[start][0], at + 1
                if found and a < found[-1][1]:
                    found[-1] = (found[-1][0], b)
                else:
                    found.append((a, b))
        return found

    def scan(self, listed: list[str]) -> list[Match]:
        """Matches in text order; of templates that match in one place the best stays."""
        met = [(k, w) for k, w in enumerate(listed) if w in self.all]
        here = Counter(w for _, w in met)
        found: list[Match] = []
        for name, part in self.parts.items():
            counts = self.counts[name]
            if sum(min(n, here[w]) for w, n in counts.items()) < self.least[name]:
                continue
            for a, b in self.regions(name, [(k, w) for k, w in met if w in counts]):
                found += self.within(name, part, listed, a, b)
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.first, m.license))
        kept: list[Match] = []
        for m in found:
            if all(m.end <= k.first or k.end <= m.first for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.first)

    def within(self, name: str, part: list[str], listed: list[str], a: int, b: int) -> list[Match]:
        """Matches in a region, which is aligned window by window if it is a long one."""
        out, size = [], len(part)
        step = int(self.stretch * size) + 1
        at = a
        while at < b:
            end = min(b, at + step)
            best = None
            # a copy may begin anywhere: start where the template's first matched words do
            for begin in [k for k in range(at, end) if listed[k] in self.starts(name)] or [at]:
                pairs = align(listed[begin : min(b, begin + step)], part)
                if pairs and self.holds(name, part, listed[begin + pairs[0][0] : begin + pairs[-1][0] + 1], pairs):
                    m = Match(name, begin + pairs[0][0], begin + pairs[-1][0] + 1, len(pairs), len(pairs) / size)
                    if best is None or (m.matched, -(m.end - m.first), -m.first) > (
                        best.matched, -(best.end - best.first), -best.first
                    ):
                        best = m
            if best:
                out.append(best)
            at = best.end if best else end
        return out

    def holds(self, name: str, part: list[str], span: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the words of an alignment, and those put in between, are this license's."""
        size, own = len(part), self.telling[name]
        if len(pairs) / size < self.coverage or not own <= {part[y] for _, y in pairs}:
            return False
        at = {x - pairs[0][0] for x, _ in pairs}
        inserted = [w for k, w in enumerate(span) if k not in at]
        if any(w in QUALIFIERS for w in inserted):
            return False
        if size > SHORT:
            return True
        return len(pairs) / (size + len(inserted)) >= self.coverage and not any(
            w in SHORT_QUALIFIERS or w.isdigit() for w in inserted
        )

    def starts(self, name: str) -> set[str]:
        """Words of which a match of enough coverage holds one first."""
        part = self.parts[name]
        return set(part[: len(part) - self.least[name] + 1])


def _scan(batches: Batches, texts: dict[str, str], coverage: float, stretch: float) -> Batches:
    templates = Templates(texts, coverage, stretch)
    for batch in batches:
        for part in steps(batch):
            rows = []
            for text in part["text"].to_pylist():
                listed = words(text or "")
                found = templates.scan(listed)
                best = max(found, key=lambda m: (m.coverage, m.matched, -m.first), default=None)
                rows.append((
                    len(listed), len(found), best.license if best else None, best.coverage if best else 0.0,
                    ",".join(f"{m.license}:{m.first}:{m.end}:{m.matched}" for m in found),
                ))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *made], names=["doc_id", "n_words", "n_licenses", "license", "coverage", "matches"]
            )


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, stretch: float = 1.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: words, licenses found, the best one, and all matches.

    ``matches`` holds ``license:first:end:matched`` (words, end exclusive) in text order;
    matches do not overlap. A null text and one without words match nothing; ties go to
    the earlier match, then the template's name; repeated rows repeat their result.
    """
    texts = TEMPLATES if templates is None else templates
    return map_batches(
        text_columns(docs, id_col, text_col), lambda b: _scan(b, texts, coverage, stretch),
        "doc_id long, n_words long, n_licenses long, license string, coverage double, matches string",
    )
