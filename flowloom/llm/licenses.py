"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are pairs of neighbouring words, so the order of words counts and line ends do not.  A template of L words is
compared with blocks of s words at steps of s / 2, where s is the smallest power of two of at least 2 L (that of the
longest template where templates are alike), so each run of L words of a text is in a block whole.  A block matches
if it holds at least ``threshold`` of the template's distinct tokens.  Which blocks match is found without comparing
all of them with all templates:

* template tokens are ordered by how many documents of the whole corpus have them, rarest first;
* prefix filter: a template of n tokens, k of which are needed, has a match only in blocks with one of its first
  n - k + 1 tokens, so only these are indexed;
* length filter: a block with fewer than k distinct tokens of templates cannot match;
* positional filter: where the first shared token stands at place p of the template's and at place q of the block's m
  tokens in that order, at most n - p and at most m - q can be shared.

What passes is verified by intersection, so the filters cost nothing in exactness.

Templates are alike if they share half of the smaller one's tokens, as versions of one license do.  Of alike
templates that match overlapping blocks only the closest stay: those with the most shared less missing tokens.  Only
template tokens are counted over the corpus; the templates are the broadcast side and their number is a parameter of
the caller.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.columns import bound_batches, map_batches, utf8

#: Phrases that name a license, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public wording of licenses and of the notices that refer to them, and the label of each.
TEMPLATES = {
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under the apache license version 2.0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "released under the mit license": "mit-notice",
    "released under the bsd 3 clause license": "bsd-3-clause",
    "licensed under the mozilla public license version 2.0": "mpl-2.0",
    "all rights reserved": "all-rights-reserved",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation
    the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
    to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of
    the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
    CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
    IN THE SOFTWARE.""": "mit-text",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
    USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd-2-clause",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution.
    3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
    USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd-3-clause",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies.
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
    DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
    USE OR PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
    held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
    alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
    software. If you use this software in a product, an acknowledgment in the product documentation would be
    appreciated but is not required.
    2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
    software.
    3. This notice may not be removed or altered from any source distribution.""": "zlib",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
    on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
    the specific language governing permissions and limitations under the License.""": "apache-2.0",
    """TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
    1. Definitions.
    "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
    through 9 of this document.
    "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the
    License.
    "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by,
    or are under common control with that entity.""": "apache-2.0",
    """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
    Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
    any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details.""": "gpl-2.0",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
    Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
    any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details.""": "gpl-3.0",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
    General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
    option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
    more details.""": "agpl-3.0",
    """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
    General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
    your option) any later version.
    This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
    more details.""": "lgpl-2.1",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
    not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""": "mpl-2.0",
    """This is free and unencumbered software released into the public domain.
    Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
    form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "unlicense",
}

#: The largest template set that is sent to every task.
MOST_TEMPLATE_BYTES = 16 << 20

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90))
_TO_WORDS = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other alphabets, A to Z in lower case."""
    return list(filter(None, text.translate(_TO_WORDS).split(b" ")))


def tokens_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Pairs of neighbouring words; a single word is one token, so a template of one word is in texts of one word only."""
    return list(zip(words, words[1:], strict=False)) if len(words) != 1 else [(words[0],)]


class Template:
    __slots__ = ("alike", "label", "need", "size", "tokens", "words")

    def __init__(self, text: str, label: str, threshold: float):
        words = words_of(text.encode())
        self.label, self.words, self.tokens = label, len(words), frozenset(tokens_of(words)) if words else frozenset()
        self.need = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))
        self.size, self.alike = 1 << max(2 * len(words) - 1, 1).bit_length(), 0


def prepared(templates: dict[str, str], threshold: float) -> list[Template]:
    """Templates with the words of their blocks and the number of those they are alike to; wordless ones are left out."""
    found = [t for t in (Template(text, label, threshold) for text, label in templates.items()) if t.tokens]
    kin = list(range(len(found)))

    def root(i: int) -> int:
        while kin[i] != i:
            i = kin[i]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if 2 * len(a.tokens & b.tokens) >= min(len(a.tokens), len(b.tokens)):
                low, high = sorted((root(i), root(j)))
                kin[high] = low
    for i, t in enumerate(found):
        t.alike = root(i)
    for t in found:
        t.size = max(x.size for x in found if x.alike == t.alike)
    return found


class Match(NamedTuple):
    """A template in a block, from its first word up to but not with ``end``."""

    template: Template
    block: int
    start: int
    end: int
    shared: int

    @property
    def closeness(self) -> int:
        return 2 * self.shared - len(self.template.tokens)

    @property
    def share(self) -> float:
        return self.shared / len(self.template.tokens)


class Index:
    """Templates under the tokens of their prefixes; tokens are known by their ranks, the rarest first."""

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[tuple[bytes, ...], int]):
        self.templates = prepared(templates, threshold)
        every = {x for t in self.templates for x in t.tokens}
        self.rank = {x: i for i, x in enumerate(sorted(every, key=lambda x: (frequency.get(x, 0), x)))}
        self.ranks = [frozenset(self.rank[x] for x in t.tokens) for t in self.templates]
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (t, ranks) in enumerate(zip(self.templates, self.ranks, strict=True)):
            for place, r in enumerate(sorted(ranks)[: len(ranks) - t.need + 1]):
                self.prefix[r].append((i, place))
        self.firsts = frozenset(x[0] for x, r in self.rank.items() if r in self.prefix)
        self.counts = {"prefix": 0, "length": 0, "positional": 0, "verified": 0}

    def every(self, words: list[bytes]) -> list[Match]:
        """All matching blocks of a text.  Blocks are sets of template tokens: others have no part in a join."""
        tokens, known = tokens_of(words) if words else [], self.rank
        at = [i for i, x in enumerate(tokens) if x in known]
        ranks, width = [known[tokens[i]] for i in at], 2 if len(words) > 1 else 1
        first: dict[tuple[int, int], tuple[int, int]] = {}  # (template, block) -> place and rank of the rarest shared token of the prefix
        for i, r in zip(at, ranks, strict=True):
            for t, place in self.prefix.get(r, ()):
                step = self.templates[t].size // 2
                last = max(0, (len(words) - step - 1) // step)
                for block in range(max(0, i // step - 1), min(i // step, last) + 1):
                    if i + width <= block * step + 2 * step:
                        first[t, block] = min((place, r), first.get((t, block), (place, r)))
        found, counts, blocks = [], self.counts, {}
        for (t, block), (place, r) in first.items():
            template = self.templates[t]
            start = block * template.size // 2
            end = min(start + template.size, len(words))
            if (start, end) not in blocks:
                blocks[start, end] = sorted(set(ranks[bisect_left(at, start) : bisect_left(at, end - width + 1)]))
            have, need = blocks[start, end], template.need
            counts["prefix"] += 1
            if len(have) < need:
                continue
            counts["length"] += 1
            if min(len(template.tokens) - place, len(have) - bisect_left(have, r)) < need:
                continue
            counts["positional"] += 1
            shared = len(self.ranks[t].intersection(have))
            if shared >= need:
                counts["verified"] += 1
                found.append(Match(template, block, start, end, shared))
        return found

    def match(self, words: list[bytes]) -> list[Match]:
        """The closest of alike templates, in every block that matches one."""
        every, best = self.every(words), {}
        for m in every:  # blocks of alike templates have one size, so those that overlap are neighbours
            at = (m.template.alike, m.block)
            best[at] = max(best.get(at, m.closeness), m.closeness)
        return [m for m in every if all(best.get((m.template.alike, m.block + d), m.closeness) <= m.closeness for d in (-1, 0, 1))]


def token_frequency(docs: DataFrame, templates: dict[str, str]) -> dict[tuple[bytes, ...], int]:
    """In how many rows of the corpus each template token occurs; one row per template token is collected."""
    wanted = frozenset(x for t in prepared(templates, 1.0) for x in t.tokens)
    firsts = frozenset(x[0] for x in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, ...], int] = defaultdict(int)
        for batch in batches:
            for text in utf8(batch.column(0)):
                words = words_of(text)
                if not firsts.isdisjoint(words):
                    for x in wanted.intersection(tokens_of(words)):
                        seen[x] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(x) for x in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    bound_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r["token"]).split(b" ")): r["n"] for r in counted.collect()}


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Where a phrase's words stand consecutively, as ``(place, label)``."""
    found = []
    for phrase, label in phrases:
        at, last = -1, phrase[-1]
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            start = at - len(phrase) + 1
            if start >= 0 and words[start : at + 1] == phrase:
                found.append((start, label))
    return found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)`` of every row.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the smallest and largest of
    them (null without any), ``base_labels`` their labels and ``labels`` those and the matched templates' labels,
    distinct, sorted and comma-joined.  ``score`` is 1 with a phrase, else the largest contained share of a
    matching template, else 0.  ``matches`` has label, share, first word and end of every matching block, in order;
    alike templates that match a block equally closely all stay.  ``docs`` needs ``doc_id`` and ``text``; other
    columns are ignored.  Null text is empty: no words, no labels, score 0.  An empty table gives no rows, repeated
    rows are scanned like others.
    """
    phrases, templates = phrases if phrases is not None else PHRASES, templates if templates is not None else TEMPLATES
    if sum(map(len, templates)) > MOST_TEMPLATE_BYTES:
        raise ValueError("scan with parts of this template set in turn")
    index = Index(templates, threshold, token_frequency(docs, templates))
    split = [(words_of(p.encode()), label) for p, label in phrases.items()]
    lasts = frozenset(p[-1] for p, _ in split)
    kind = docs.schema["doc_id"].dataType.simpleString()
    match = pa.struct([("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(match)]

    def scan(text: bytes) -> tuple:
        words = words_of(text)
        have = set(words)
        places = phrase_places(words, split) if have & lasts else []
        found = index.match(words) if have & index.firsts else []
        rows = sorted((m.start, m.end, m.template.label, m.share) for m in found)
        base = {label for _, label in places}
        at = [p for p, _ in places]
        score = 1.0 if at else max((m.share for m in found), default=0.0)
        blocks = [{"label": label, "share": share, "first_word": start, "end_word": end} for start, end, label, share in rows]
        labels = base | {m.template.label for m in found}
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in utf8(batch.column(1))]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    blocks = "array<struct<label: string, share: double, first_word: long, end_word: long>>"
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {blocks}")
