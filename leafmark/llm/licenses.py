"""Licence scans with a generalised suffix automaton of licence templates.

Files are streamed through the automaton: at each word it knows the longest
stretch of words ending there that stands in some template (the matching
statistics). Long stretches are chained, in order in both file and template, into
covered spans. Words weigh the more the fewer templates hold them; words of the file
that a chain steps over are taken off. A template covered enough, with its naming
phrase unbroken, gives its label; of spans on the same words the heaviest stays. The
score is the covered share of the best span; without one, of the best chain, halved
where the name is missing.

Defined results: a null or empty text has no words, no labels and score 0; words
are cut after lower-casing A-Z; of equal spans the one with the larger share, then the
earlier, then the label first in the alphabet stays; repeated rows are scanned alike; a
very long text is scanned whole; an empty table gives no rows; extra columns are
ignored. Everything is local to a row: no shuffle, memory bounded by one text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from leafmark.llm.common import documents, map_rows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and labels of the base rule.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening passages of public licences and notices that name one, each with
# its label and the phrases that must stand in it unbroken ("" where the passage itself tells).
TEMPLATES: list[tuple[str, str, str]] = [
    (
        "mit",
        "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "boost",
        "",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ),
    (
        "zlib",
        "",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ),
    (
        "unlicense",
        "",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "apache",
        "apache license",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "gnu general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "gnu lesser general public license",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl",
        "gnu affero general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("gpl", "gnu general public license", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "gnu lesser general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "gnu lesser general public license", "This work is licensed under the GNU Lesser General Public License."),
    ("agpl", "gnu affero general public license", "This work is licensed under the GNU Affero General Public License."),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0."),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "mit license", "This project is licensed under the terms of the MIT license."),
    ("cc0", "cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. CC0 1.0 Universal."),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl", "eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("bsd", "bsd 2 clause license", "Licensed under the BSD 2-Clause License."),
    ("bsd", "bsd 3 clause license", "Licensed under the BSD 3-Clause License."),
    ("gpl", "gpl v2", "Licensed under the GNU GPL v2."),
    ("gpl", "gpl v3", "Licensed under the GNU GPL v3."),
    ("apache", "apache 2 0", "Apache-2.0"),
    ("cc0", "cc0 1 0", "CC0 1.0"),
    ("isc", "isc license", "Licensed under the ISC License."),
    ("mpl", "mozilla public license", "Licensed under the Mozilla Public License, Version 2.0."),
]

# Names of the Creative Commons licences, their versions, and labels of SPDX names.
COMMONS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
SPDX = {
    "mit": ("MIT",),
    "apache": ("Apache-2.0",),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "isc": ("ISC",),
    "zlib": ("Zlib",),
    "boost": ("BSL-1.0",),
    "unlicense": ("Unlicense",),
    "mpl": ("MPL-2.0",),
    "epl": ("EPL-2.0",),
    "cc0": ("CC0-1.0",),
}


def _by_rule() -> list[tuple[str, str, str]]:
    """Notices of the Creative Commons licences in all versions, and SPDX tags."""
    phrase = lambda name: re.sub(r"[^a-z0-9]+", " ", name.lower())
    out = []
    for kind, name in COMMONS.items():
        for version in COMMONS_VERSIONS:
            where = "International" if version == "4.0" else "Unported"
            full = f"Creative Commons {name} {version}"
            out.append((f"cc-{kind}", phrase(full), f"This work is licensed under a {full} {where} License."))
            out.append((f"cc-{kind}", phrase(f"CC {kind} {version}"), f"Licensed under CC {kind.upper()} {version}."))
            out.append((f"cc-{kind}", phrase(f"identifier CC {kind} {version}"), f"SPDX-License-Identifier: CC-{kind.upper()}-{version}"))
    for label, names in SPDX.items():
        out += [(label, phrase(f"identifier {name}"), f"SPDX-License-Identifier: {name}") for name in names]
    return out


TEMPLATES += _by_rule()

#: Words that a stretch must have, or else (two at least) its share of the template; words of the file that
#: may stand between chained stretches, what each of them takes off, and the least covered share.
MIN_STRETCH, MIN_PART, MAX_GAP, GAP_COST, MIN_COVER = 4, 0.25, 24, 0.5, 0.6


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z only) text, as UTF-8."""
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """Generalised suffix automaton over word ids; every state knows one place in
    each template in which its words stand."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [{}]
        for t, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._add(last, word)
                self.ends[last].setdefault(t, []).append(at)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for t, places in self.ends[state].items():
                up.setdefault(t, []).extend(places)
        self.ends[0] = {}
        self.ends = [{t: sorted(set(p)) for t, p in e.items()} for e in self.ends]

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def stretches(self, ids: list[int | None]) -> list[tuple[int, int, int]]:
        """(end place, words, state) of each stretch that can't be made longer to the right."""
        out, state, size = [], 0, 0
        for at, word in enumerate(ids):
            if word is None:
                if size:
                    out.append((at - 1, size, state))
                    state = size = 0
                continue
            grown = self.next[state].get(word)
            if grown is None and size:
                out.append((at - 1, size, state))
            while grown is None and state:
                state = self.link[state]
                size = self.size[state]
                grown = self.next[state].get(word)
            if grown is not None:
                state, size = grown, size + 1
        if size:
            out.append((len(ids) - 1, size, state))
        return out


class Chain(NamedTuple):
    """Stretches of one template in order: net weight, file and template end, first file word,
    whether the template's phrase stands in one of them."""

    weight: float
    end: int
    place: int
    first: int
    named: bool


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [label for label, _, _ in templates]
        cut = [words_of(text) for _, _, text in templates]
        self.ids: dict[bytes, int] = {}
        for word in (w for words in cut for w in words):
            self.ids.setdefault(word, len(self.ids))
        self.templates = [[self.ids[w] for w in words] for words in cut]
        self.automaton = Automaton(self.templates)
        # A word weighs the more, the fewer templates hold it; sums up to each place.
        held = Counter(w for words in self.templates for w in set(words))
        weigh = lambda w: math.log(1 + len(templates) / held[w])
        self.sums = [[0.0, *accumulate(map(weigh, words))] for words in self.templates]
        self.names: list[list[tuple[int, int]]] = []
        for words, (_, phrase, _) in zip(cut, templates, strict=True):
            name = words_of(phrase)
            self.names.append([(at, at + len(name)) for at in range(len(words) - len(name) + 1) if name and words[at : at + len(name)] == name])
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.firsts: dict[bytes, list[int]] = {}
        for i, (words, _) in enumerate(self.phrases):
            self.firsts.setdefault(words[0], []).append(i)

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, phrase) of every place where a phrase stands."""
        return [(at, i) for at, w in enumerate(words) if w in self.firsts for i in self.firsts[w] if words[at : at + len(self.phrases[i][0])] == self.phrases[i][0]]

    def _named(self, t: int, opens: int, place: int) -> bool:
        return any(opens <= a and b <= place + 1 for a, b in self.names[t])

    def chains(self, t: int, matches: list[tuple[int, int, int]]) -> list[Chain]:
        """The best chain that ends with each of a template's matches (file end, place, words).

        Stretches follow one another in file and template; where a stretch begins inside
        the one before, it is trimmed. A file word skipped between them costs ``GAP_COST``.
        """
        sums, out, near = self.sums[t], [], 0
        for end, place, size in matches:
            start, opens = end - size + 1, place - size + 1
            best = Chain(sums[place + 1] - sums[opens], end, place, start, self._named(t, opens, place))
            while near < len(out) and out[near].end < start - MAX_GAP - 1:
                near += 1
            for c in out[near:]:
                trim = max(0, c.end + 1 - start, c.place + 1 - opens)
                if trim < size and c.end < end and c.place < place:
                    gap = max(0, start + trim - c.end - 1)
                    if gap <= MAX_GAP:
                        weight = c.weight + sums[place + 1] - sums[opens + trim] - GAP_COST * gap
                        if weight > best.weight:
                            best = Chain(weight, end, place, c.first, c.named or self._named(t, opens + trim, place))
            out.append(best)
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of the chains that cover enough
        of a template; of those on the same words the heaviest stays. And the rest's best."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in self.automaton.stretches(list(map(self.ids.get, words))):
            if size < 2:
                continue
            for t, places in self.automaton.ends[state].items():
                for place in places:
                    if size >= MIN_STRETCH or size > 1 and self.sums[t][place + 1] - self.sums[t][place - size + 1] >= MIN_PART * self.sums[t][-1]:
                        found.setdefault(t, []).append((end, place, size))
        enough, rest = [], 0.0
        for t, matches in found.items():
            for c in self.chains(t, matches):
                share = c.weight / self.sums[t][-1]
                if share >= MIN_COVER and (c.named or not self.names[t]):
                    enough.append((-c.weight, -share, c.first, c.end, self.labels[t]))
                else:
                    rest = max(rest, share if c.named or not self.names[t] else share / 2)
        out: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []  # (first, last), ascending and apart
        for _, share, first, last, label in sorted(enough):
            at = bisect_left(taken, (first, first))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                taken.insert(at, (first, last))
                out.append((label, first, last, -share))
        return out or [("", 0, 0, rest)]

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        places = self.places(words)
        base = {self.phrases[i][1] for _, i in places}
        spans = self.spans(words)
        found = [s for s in spans if s[0]]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in found})),
            "score": min(1.0, max(s[3] for s in spans)),
            "spans": [{"label": s[0], "first": s[1], "last": s[2], "covered": min(1.0, s[3])} for s in found],
        }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels, score and covered spans of every whole text."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>"

    def make():
        one = Scanner().scan

        def step(rows: dict) -> dict:
            found = [one(text) for text in rows["text"]]
            return {"doc_id": rows["doc_id"], **{k: [f[k] for f in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}}

        return step

    return map_rows(documents(docs, id_col, text_col), make, schema)
