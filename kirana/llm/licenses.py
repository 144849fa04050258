"""License notices by conditional compression (operator 5).

1. Candidate blocks are the runs of words around the templates' telling words, over the
   whole text and its line breaks; a template whose telling words a text lacks can't agree
   with any of its blocks.
2. Each candidate block is compressed alone and with *each* template as zstandard raw
   dictionary; templates are ranked by the bytes that they save, and those that save
   nothing are out.
3. In that order a template is confirmed, or rejected, by the exact words in which the
   block and it differ: the block holds most of the template's words in order, and no more
   than half as many others among them; words that name a license (name, version, NC, SA and
   ND marks) are neither missing nor added, and templates of up to ``EXACT`` words have no
   difference at all and no denial before them.  Words confirmed for one template are not
   given to another, so a whole license wins over a sentence of it.

Defined results: null and empty texts have no blocks and return no row; equal
notices of a document return a row each, with the number of the line on which they
begin; ties between templates go to the first name; an empty table returns no rows;
other columns are not read.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kirana.llm.common import prepare, texts

_CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-SA": "Attribution-ShareAlike"}
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: The customary short notices of licenses.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-1.0": "Licensed under the Apache License, Version 1.0.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Released under the BSD License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.0": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
} | {f"CC-{k}-{v}": f"Licensed under CC {k} {v}." for k in _CC for v in _CC_VERSIONS} | {
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License."}
#: Further wordings of the same licenses.
WORDINGS = [("CC-BY-4.0", "Licensed under CC BY 4.0.")] + [
    (f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {t} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License.")
    for k, t in _CC.items() for v in _CC_VERSIONS if (k, v) != ("BY", "4.0")]
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
#: The texts and headers by which licenses are given in full.
LONG = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""),
    *[(f"{short}-{v}.0", _GNU.format(name=name, version=v)) for short, name, versions in
      (("GPL", "General Public License", "23"), ("AGPL", "Affero General Public License", "3"), ("LGPL", "Lesser General Public License", "3")) for v in versions],
    ("LGPL-2.1", _GNU.format(name="Lesser General Public License", version="2.1")),
]
#: Identifiers in lines such as "SPDX-License-Identifier: MIT".
SPDX = """MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Unlicense Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 BSL-1.0
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later""".split()
#: Words that tell one license from another: neither missing nor added ones are passed over.  Numbers count with them, unless they are added years.
NAMES = frozenset("affero agpl apache artistic boost bsd bsl cc commercial commons creative derivatives eclipse epl gnu gpl isc lesser lgpl library mit mozilla mpl nc nd "
                  "noncommercial noderivatives noderivs sa share sharealike spdx unencumbered unlicense zlib".split())
#: Words without which a template doesn't agree either.
NEEDED = frozenset("attribution binary by clause endorse fee granted later liable only redistribution reserved rights sublicense".split())
#: Words before a notice that deny it.
DENIALS = frozenset("no not some without".split())
#: Share of the words that must agree, in order.
AGREE = 0.8
#: Templates of up to so many words agree word for word; longer ones than ``SHORT`` are compared by the longest common runs.
EXACT, SHORT = 3, 40
LEVEL = 3


WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Words and numbers of a text in small letters; 2.0 is 2."""
    return [_plain(w) for w in WORD.findall(text)]


def _plain(word: str) -> str:
    return re.sub(r"(?:\.0)+$", "", word) if word[0].isdecimal() else word


def _names(word: str) -> bool:
    return word in NAMES or word[0].isdecimal()


def _year(word: str) -> bool:
    return len(word) == 4 and word.isdecimal()


def _telling(words: list[str]) -> set[str]:
    """Words of a template of which a block that agrees holds one: a word that names the license, or else the longest, one more than may be missing."""
    known = [w for w in words if w in NAMES] or [w for w in words if w in NEEDED]
    return set(sorted(set(known or words), key=lambda w: (-len(w), w))[:1 if known else len(words) - math.ceil(AGREE * len(words)) + 1])


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words = [_words(t.lower()) for _, t in templates]
        self.may_miss = [0 if len(w) <= EXACT else len(w) - math.ceil(AGREE * len(w)) for w in self.words]
        self.may_add = [0 if len(w) <= EXACT else (len(w) + 1) // 2 for w in self.words]
        #: Words up to each place that may not be missing.
        self.firm = [[0, *itertools.accumulate(_names(w) or w in NEEDED for w in words)] for words in self.words]
        self.by_word: dict[str, list[int]] = {}
        for t, words in enumerate(self.words):
            for w in _telling(words):
                self.by_word.setdefault(w, []).append(t)
        #: Words on either side of a telling word in which a notice lies that it tells of.
        self.reach = {w: max(len(self.words[t]) + self.may_add[t] for t in ts) for w, ts in self.by_word.items()}
        letter = r"[^\W\d_]"
        # patterns that begin with plain letters are searched quickly
        self.gates = {w: re.compile(rf"{w}(?<!{letter}{w})(?!{letter})" if w.isalpha() else re.escape(w)) for w in sorted(self.by_word)}
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        raw = [" ".join(t.lower().split()).encode() for _, t in templates]
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(r, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for r in raw]

    def _agreeing(self, template: int, words: list[str], at: int) -> tuple[int, int, int] | None:
        """Differing words, first and end of the best run of words around ``at`` that agrees with a template."""
        want, may_miss, firm = self.words[template], self.may_miss[template], self.firm[template]
        n, more = len(want), self.may_add[template]
        around = range(max(0, at - n - more + 1), min(len(words), at + n + more))
        near = set(words[around.start:around.stop])
        if sum(w in near for w in want) < n - may_miss:
            return None
        best = None
        # (words of the template passed, of these missing) -> (extra words, minus the first word)
        live: dict[tuple[int, int], tuple[int, int]] = {}
        for i in around:
            may_add = not _names(words[i]) or _year(words[i])
            new = {state: (extra + 1, first) for state, (extra, first) in live.items() if may_add and extra < more}
            begin = {(j, j): (0, -i) for j in range(may_miss + 1) if not firm[j]} if i <= at else {}
            for (j, missing), had in [*live.items(), *begin.items()]:
                for to in range(j, min(n, j + may_miss - missing + 1)):
                    if want[to] != words[i] or firm[to] > firm[j]:
                        continue
                    state = to + 1, missing + to - j
                    new[state] = min(had, new.get(state, had))
                    lost = state[1] + n - to - 1
                    if lost <= may_miss and firm[n] == firm[to + 1] and i >= at and (best is None or lost + had[0] < best[0]):
                        best = lost + had[0], -had[1], i + 1
            live = new
        return best

    def _agreeing_long(self, template: int, words: list[str], at: int) -> tuple[int, int, int] | None:
        """The same for a long template, by the longest runs that both have in order."""
        want, more = self.words[template], self.may_add[template]
        begin, stop = max(0, at - len(want) - more + 1), min(len(words), at + len(want) + more)
        near = words[begin:stop]
        runs = [r for r in difflib.SequenceMatcher(None, want, near, autojunk=False).get_matching_blocks() if r.size]
        common = sum(r.size for r in runs)
        if not runs or common < len(want) - self.may_miss[template]:
            return None
        first, end = runs[0].b, runs[-1].b + runs[-1].size
        missing = set(range(len(want))).difference(*[range(r.a, r.a + r.size) for r in runs])
        added = set(range(first, end)).difference(*[range(r.b, r.b + r.size) for r in runs])
        if len(added) > more or any(_names(want[k]) or want[k] in NEEDED for k in missing) or any(_names(near[k]) and not _year(near[k]) for k in added):
            return None
        return len(missing) + len(added), begin + first, begin + end

    def _confirmed(self, template: int, words: list[str], at: int) -> tuple[int, int, int] | None:
        got = (self._agreeing if len(self.words[template]) <= SHORT else self._agreeing_long)(template, words, at)
        denied = got and len(self.words[template]) <= EXACT and got[1] > 0 and words[got[1] - 1] in DENIALS
        return None if denied else got

    def _candidates(self, words: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """Runs of words in which the notices around telling words lie, and where these stand; overlapping ones are
        joined up to the length of the longest notice."""
        longest = max(self.reach.values())
        held: tuple[int, int, list[int]] | None = None
        for at, w in enumerate(words):
            if w in self.reach:
                a, z = max(0, at - self.reach[w]), min(len(words), at + self.reach[w])
                if held and a <= held[1] and max(z, held[1]) - min(a, held[0]) <= longest:
                    held = min(a, held[0]), max(z, held[1]), [*held[2], at]
                else:
                    if held:
                        yield held
                    held = a, z, [at]
        if held:
            yield held

    def ranking(self, block: str) -> list[tuple[float, int]]:
        """Bytes that each template saves a block, most first, without those that save none."""
        raw = " ".join(block.split()).encode()
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(c.compress(raw)), t) for t, c in enumerate(self.given)]
        return sorted(((s, t) for s, t in saved if s > 0), key=lambda x: (-x[0], self.names[x[1]]))

    def blocks(self, text: str) -> list[tuple[int, str, float, int]]:
        """Line, name, share of the size saved and differing words of every confirmed notice of a text."""
        text = text.lower()
        if not any(w in text and gate.search(text) for w, gate in self.gates.items()):
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = _words(text)
        found: dict[tuple[int, int], tuple[str, float, int]] = {}
        for a, z, inside in self._candidates(words):
            for _, t in self.ranking(text[spans[a][0]:spans[z - 1][1]]):
                for at in inside:
                    if t not in self.by_word[words[at]] or not (got := self._confirmed(t, words, at)):
                        continue
                    differing, first, end = got
                    if all(end <= p or q <= first for p, q in found):
                        raw = text[spans[first][0]:spans[end - 1][1]].encode()
                        found[first, end] = self.names[t], 1 - len(self.given[t].compress(raw)) / len(self.plain.compress(raw)), differing
        return [(text.count("\n", 0, spans[first][0]), *rest) for (first, _), rest in sorted(found.items())]


def license_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed block: the key, ``line``, ``license``, ``saved`` (share of the size), ``differing`` (words)."""
    prepare(docs.sparkSession)
    chosen = list(templates.items()) if templates else [*TEMPLATES.items(), *WORDINGS, *LONG, *[(n, f"SPDX-License-Identifier: {n}") for n in SPDX]]
    names = [key, "line", "license", "saved", "differing"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen)
        for b in batches:
            keys, rows = [], []
            for at, t in enumerate(texts(b.column(1))):
                for got in known.blocks(t):
                    keys.append(at)
                    rows.append(got)
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64())))], names)

    return docs.select(key, text).mapInArrow(work, f"`{key}` {dict(docs.dtypes)[key]}, line long, license string, saved double, differing long")
