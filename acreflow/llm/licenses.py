"""License scans by conditional compression.

Lines up to a blank one make a paragraph, read as words: line breaks and comment marks don't count. The words around
each licensing cue are a candidate block. Every block is compressed with every template, zstandard with the template's
wordings as a raw dictionary, and the templates are ranked by the bytes that this saves. All are then confirmed in that
order, by the exact differences of their wordings from the words of the block: where the words that name a template
(title, version) stand in order and few words differ, the license holds, unless a word of its clause denies it. Short
names count as titles, after "licensed under" and the like, and after "License:"; so do addresses of license texts. A
place names one license, that of the highest rank. A name that several licenses share ("BSD License") confirms the one
that ranks clearly above the others, and none where none does. SPDX tags are read by their own form, with every license of the
expression.

A reported block is the lines of a confirmed notice, or a line that holds a licensing cue outside of them. It has as many
entries as licenses.

Defined results: offsets count code points, ends are exclusive; a null text is an empty one without blocks; a block
without a confirmed license has one entry without; repeated blocks count each; a notice whose lines hold no cue
doesn't count; ties rank by difference, then by name; the input's other columns are not read. Memory is one text, and
bounded memos of paragraphs, blocks and differences.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from acreflow.llm.common import Memo, slices, strings

# Wordings of public license notices by SPDX identifier, and the words that must stand in order.
TEMPLATES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "Apache-2.0": (
        ("Licensed under the Apache License, Version 2.0.", ("apache", "license", "2.0")),
        ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ("apache", "license", "2.0")),
    ),
    "BSD-2-Clause": (("Released under the BSD 2-Clause License.", ("bsd", "2-clause")), ("Released under the Simplified BSD License.", ("simplified", "bsd"))),
    "BSD-3-Clause": (
        ("Released under the BSD 3-Clause License.", ("bsd", "3-clause")),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution", "source", "binary", "forms", "permitted", "conditions")),
    ),
    "CC-BY-4.0": (("Licensed under CC BY 4.0.", ("cc", "by", "4.0")), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4.0"))),
    "CC-BY-SA-4.0": (("Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "attribution-sharealike", "4.0"))),
    "CC-BY-NC-4.0": (("Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "attribution-noncommercial", "4.0"))),
    "CC0-1.0": (("Released under CC0 1.0 Universal.", ("cc0", "1.0")), ("To the extent possible under law, the author has waived all copyright and related rights to this work.", ("waived", "all", "copyright", "rights"))),
    "GPL-2.0": (
        ("This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "license", "2")),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "general", "public", "license", "version", "2")),
    ),
    "GPL-3.0": (
        ("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "license", "3")),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "public", "license", "version", "3")),
    ),
    "LGPL-3.0": (
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "general", "public", "license", "3")),
        ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "lesser", "general", "public", "license", "version", "3")),
    ),
    "AGPL-3.0": (
        ("This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "general", "public", "license", "3")),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "affero", "general", "public", "license", "version", "3")),
    ),
    "ISC": (
        ("Released under the ISC License.", ("isc", "license")),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission", "use", "purpose", "with", "without", "fee", "granted")),
    ),
    "MIT": (
        ("Released under the MIT License.", ("mit", "license")),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission", "granted", "free", "charge", "person", "copy", "software", "without", "restriction")),
    ),
    "MPL-2.0": (("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "public", "license", "2.0")),),
    "Unlicense": (("This is free and unencumbered software released into the public domain.", ("free", "unencumbered", "public", "domain")),),
}
# What follows a notice in the same public texts; only for the dictionaries.
MORE: dict[str, str] = {
    "Apache-2.0": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
}
_GNU_NOTICE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
MORE |= {"GPL-2.0": MORE["GPL-3.0"], "LGPL-3.0": _GNU_NOTICE.format("GNU Lesser General Public License"), "AGPL-3.0": _GNU_NOTICE.format("GNU Affero General Public License")}
MORE["BSD-2-Clause"] = MORE["BSD-3-Clause"].split(" Neither the name")[0]


def _gnu(title: str, short: str, version: str) -> tuple[str, ...]:
    """The ways to write a GNU license's name with its version."""
    forms = [f"version {version}", f"v{version}", f"v{version}.0", version, f"{version}.0"]
    return tuple(f"{name} {form}" for name in (title, f"gnu {short}", short) for form in forms) + (f"{short}v{version}", f"gnu {short}v{version}", f"{short}-{version}.0", f"{short}{version}")


def _creative(long: str, short: str) -> tuple[str, ...]:
    return (f"creative commons {long} 4.0 international license", f"creative commons {long} 4.0 international", f"creative commons {long} 4.0", f"cc {short} 4.0", f"cc-{short} 4.0", f"cc-{short}-4.0")


# Short names, in words.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache software license 2.0", "apache-2.0", "apache 2.0", "apache 2"),
    "BSD-2-Clause": ("bsd 2-clause license", "2-clause bsd license", "bsd-2-clause license", "bsd-2-clause", "bsd 2-clause", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3-clause license", "3-clause bsd license", "bsd-3-clause license", "bsd-3-clause", "bsd 3-clause", "new bsd license", "modified bsd license"),
    "CC-BY-4.0": _creative("attribution", "by"), "CC-BY-SA-4.0": _creative("attribution-sharealike", "by-sa"), "CC-BY-NC-4.0": _creative("attribution-noncommercial", "by-nc"),
    "CC0-1.0": ("cc0 1.0 universal", "cc0 1.0", "cc0-1.0", "cc0"),
    "GPL-2.0": _gnu("gnu general public license", "gpl", "2"), "GPL-3.0": _gnu("gnu general public license", "gpl", "3"),
    "LGPL-3.0": _gnu("gnu lesser general public license", "lgpl", "3"), "AGPL-3.0": _gnu("gnu affero general public license", "agpl", "3"),
    "ISC": ("isc license", "isc"), "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v 2.0", "mpl 2.0", "mpl-2.0"), "Unlicense": ("unlicense",),
}
# Names that licenses share, and addresses of their texts.
FAMILIES: dict[str, tuple[str, ...]] = {"bsd license": ("BSD-2-Clause", "BSD-3-Clause"), "gnu general public license": ("GPL-2.0", "GPL-3.0"), "gnu gpl": ("GPL-2.0", "GPL-3.0"), "gpl": ("GPL-2.0", "GPL-3.0")}
ADDRESSES: dict[str, str] = {
    "creativecommons.org/licenses/by/4.0": "CC-BY-4.0", "creativecommons.org/licenses/by-sa/4.0": "CC-BY-SA-4.0", "creativecommons.org/licenses/by-nc/4.0": "CC-BY-NC-4.0", "creativecommons.org/publicdomain/zero/1.0": "CC0-1.0",
    "opensource.org/licenses/mit": "MIT", "opensource.org/license/mit": "MIT", "opensource.org/licenses/isc": "ISC", "opensource.org/licenses/bsd-2-clause": "BSD-2-Clause", "opensource.org/licenses/bsd-3-clause": "BSD-3-Clause",
    "apache.org/licenses/license-2.0": "Apache-2.0", "gnu.org/licenses/gpl-3.0": "GPL-3.0", "gnu.org/licenses/lgpl-3.0": "LGPL-3.0", "gnu.org/licenses/agpl-3.0": "AGPL-3.0", "mozilla.org/mpl/2.0": "MPL-2.0", "unlicense.org": "Unlicense",
}
#: Words that put a text under what follows, what may stand between, and what may follow a title in its line.
UNDER, BETWEEN = ("licensed", "licenced", "relicensed", "dual-licensed", "released", "distributed", "redistributed", "available", "published", "provided", "offered", "shared"), ("the", "a", "an", "terms", "and", "conditions", "of")
AFTER_TITLE = re.compile(r"[0-9]+|january|february|march|april|may|june|july|august|september|october|november|december|mit|isc|bsd|mpl|[al]?gpl(?:v[0-9])?")
#: Words that deny a notice, before it in its clause.
DENIALS = ("not", "never", "neither", "nor", "cannot", "isn", "nothing", "none", "nobody", "no")
CUES = ("permission to use", "licen", "copyright", "creative commons", "creativecommons", "cc by", "cc0", "public domain", "permission is hereby", "redistribution and use", "spdx", "mozilla.org/mpl")
#: Share of a wording's words that may lack, and words that a block may add between its own.
LACKING, ADDED = 0.34, 6
#: Bytes by which one license must save more than the others that share its name.
MARGIN = 16
#: Words of a candidate block before and after its cue: more than the longest wording.
BEFORE, AFTER = 16, 72
#: Distinct paragraphs, and blocks and stretches of words, whose answers a worker keeps.
MEMO_BLOCKS, MEMO_PARTS = 50_000, 100_000

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
_CLAUSE = re.compile(r"[.!?;:,](?:\s|$)|\n[^\S\n]*[-*][^\S\n]")
_TAGGED = re.compile(r"[\"'`*_\])>]*\s*[:=]")
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]*[^\s][^\n]*)*")
# On lowered text; the blanks of a cue may be line breaks with comment marks after them.
_CUE = re.compile("|".join(re.escape(c).replace("\\ ", r"(?:\x20|[^\S\n]*\n[\s#*/;%>|!-]*)") for c in CUES))
_SPDX = re.compile(r"SPDX-License-Identifier:[^\S\n]*(\(*[A-Z0-9.+-]+\)*(?:[^\S\n]+(?:AND|OR|WITH)[^\S\n]+\(*[A-Z0-9.+-]+\)*)*)", re.IGNORECASE | re.ASCII)
_SPDX_ID = re.compile(r"[A-Za-z0-9.+-]+")
_SPDX_NAMES = {name.lower(): name for name in TEMPLATES}
_ADDRESS = re.compile("|".join(re.escape(x) for x in sorted(ADDRESSES, key=len, reverse=True)))
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Match:
    license: str
    saved: int  # bytes of the compressed block that the template's dictionary saves
    lacking: int  # words of the wording that the notice lacks
    added: int  # words of the notice that the wording lacks


def lowered(text: str) -> str:
    """Lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def aligned(block: list[str], wording: list[str], named: tuple[str, ...], most: int) -> dict[int, tuple[int, int, int]]:
    """Alignments from the first word on, that ends freely: words added -> (lacking, words taken, last naming word's
    place), the least lacking for each; all of ``named`` are held in order. Exact up to ``most`` lacking and ADDED."""
    found: dict[int, tuple[int, int, int]] = {}
    # (wording words passed, words added, naming words held) -> (lacking, last naming word's place)
    now: dict[tuple[int, int, int], tuple[int, int]] = {(0, 0, 0): (0, 0)}
    for i in range(len(block) + 1):
        for j in range(len(wording)):
            for state in [x for x in now if x[0] == j]:
                lacking, last = now[state]
                at = (j + 1, *state[1:])
                if lacking < most and lacking + 1 < now.get(at, (most + 1, 0))[0]:
                    now[at] = lacking + 1, last
        after: dict[tuple[int, int, int], tuple[int, int]] = {}
        for (j, k, q), (lacking, last) in now.items():
            if j == len(wording):
                if q == len(named) and lacking < found.get(k, (most + 1, 0))[0]:
                    found[k] = lacking, i, last
                continue
            if i == len(block):
                continue
            if wording[j] == block[i]:
                held = q < len(named) and block[i] == named[q]
                at = (j + 1, k, q + held)
                if lacking < after.get(at, (most + 1, 0))[0]:
                    after[at] = lacking, i if held else last
            if k < ADDED and lacking < after.get((j, k + 1, q), (most + 1, 0))[0]:
                after[j, k + 1, q] = lacking, last
        if not (now := after):
            break
    return found


def difference(block: list[str], place: int, wording: list[str], named: tuple[str, ...]) -> tuple[int, int, int, int, int] | None:
    """(lacking, added, first and end word, last naming word) of the wording at the first naming word's ``place``, if
    few words differ, with the least difference."""
    cut, most, best = wording.index(named[0]), int(LACKING * len(wording)), None
    right = aligned(block[place : place + len(wording) - cut + ADDED], wording[cut:], named, most)
    if not right:
        return None
    left = aligned(block[max(0, place - cut - ADDED) : place][::-1], wording[:cut][::-1], (), most) if cut else {0: (0, 0, 0)}
    for more, (l_lacking, l_taken, _) in left.items():
        for k, (lacking, taken, last) in right.items():
            d = (lacking + l_lacking, k + more, place - l_taken, place + taken, place + last)
            if d[0] <= most and d[1] <= ADDED and (best is None or (d[0] + d[1], d[0]) < (best[0] + best[1], best[0])):
                best = d
    return best


def denied(low: str, at: list[tuple[int, int]], own: list[str]) -> list[bool]:
    """For each word whether one that denies stands before it in its clause."""
    out, denies = [], False
    for i, w in enumerate(own):
        if i and _CLAUSE.search(low, at[i - 1][1], at[i][0]):
            denies = False
        out.append(denies)
        denies = denies or w in DENIALS
    return out


def _spelled() -> dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]]:
    """By first word: the words of each short name and its licenses, longer names first."""
    out: dict[str, list] = {}
    every = [(tuple(n.split()), (name,)) for name, names in NAMES.items() for n in names] + [(tuple(n.split()), names) for n, names in FAMILIES.items()]
    for words, names in sorted(every, key=lambda x: (-len(x[0]), x)):
        out.setdefault(words[0], []).append((words, names))
    return out


class Scanner:
    def __init__(self):
        self._plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        self._given = {}
        for name, wordings in sorted(TEMPLATES.items()):
            spelled = [w for w, _ in wordings] + list(NAMES[name][:1]) + [x for x, n in ADDRESSES.items() if n == name] + [MORE.get(name, "")]
            raw = zstandard.ZstdCompressionDict("\n".join(spelled).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._given[name] = zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
        self._wordings = {name: [(_WORD.findall(w.lower()), named) for w, named in each] for name, each in TEMPLATES.items()}
        self._spelled = _spelled()
        self._order = {name: i for i, name in enumerate(sorted(TEMPLATES))}
        self._memo, self._ranks, self._differences = Memo(MEMO_BLOCKS), Memo(MEMO_PARTS), Memo(MEMO_PARTS)

    def saved(self, block: str) -> np.ndarray:
        """Bytes that the dictionary of each template, by name, saves of the compressed block."""
        if (known := self._ranks.get(block)) is not None:
            return known
        raw = block.encode()
        alone = len(self._plain.compress(raw))
        return self._ranks.put(block, np.array([alone - len(self._given[name].compress(raw)) for name in self._order], np.int32))

    def _difference(self, own: list[str], place: int, which: tuple[str, int]) -> tuple[int, int, int, int, int] | None:
        """``difference`` by the words around ``place`` alone, so that repeated ones are compared once."""
        wording, named = self._wordings[which[0]][which[1]]
        first = max(0, place - wording.index(named[0]) - ADDED)
        near = tuple(own[first : place + len(wording) + ADDED])
        key = (which, place - first, near)
        if key not in self._differences:
            self._differences.put(key, difference(list(near), place - first, wording, named))
        d = self._differences[key]
        return None if d is None else (d[0], d[1], *(x + first for x in d[2:]))

    def _names(self, text: str, low: str, at: list[tuple[int, int]], own: list[str]) -> Iterator[tuple[tuple[str, ...], int, int]]:
        """(licenses, first word, last word) of the short names that stand as titles or put the text under them."""
        starts = {i for i in range(len(at)) if not i or "\n" in text[at[i - 1][1] : at[i][0]]}
        for i, w in enumerate(own):
            for words, names in self._spelled.get(w, ()):
                end = i + len(words)
                if tuple(own[i:end]) != words:
                    continue
                k = i - 1
                while k >= 0 and own[k] in BETWEEN:
                    k -= 1
                under = k > 0 and own[k] == "under" and own[k - 1] in UNDER
                tagged = i > 0 and own[i - 1] in ("license", "licence", "licensed") and _TAGGED.match(low, at[i - 1][1], at[i][0]) is not None
                last = end
                while last < len(own) and AFTER_TITLE.fullmatch(own[last]) and last not in starts:
                    last += 1
                # A title fills its line, but for an article before it, and isn't the end of a sentence.
                title = text[at[last - 1][1] : at[last - 1][1] + 1] != "." and (i in starts or i - 1 in starts and own[i - 1] == "the") and (last == len(own) or last in starts) and (len(words) > 1 or words[0] == "unlicense")
                if under or tagged or title:
                    yield names, i, end - 1
                    break

    def _notices(self, text: str, low: str) -> list[tuple[int, int, Match]]:
        """(start, end, match) of the words of each notice of a paragraph."""
        at = [m.span() for m in _WORD.finditer(low)]
        own = [low[a:b] for a, b in at]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            places.setdefault(w, []).append(i)
        # Each candidate block, compressed with every template; of the blocks that hold a word the most bytes saved.
        starts, none = [a for a, _ in at], np.iinfo(np.int32).min
        most = np.full((len(own), len(self._order)), none, np.int32)
        for m in _CUE.finditer(low):
            cue = max(0, bisect_right(starts, m.start()) - 1)
            first, end = max(0, cue - BEFORE), min(len(own), cue + AFTER)
            if first < end:
                np.maximum(most[first:end], self.saved(text[at[first][0] : at[end - 1][1]]), out=most[first:end])
        saved = lambda place, name: int(most[place, self._order[name]])
        near, denies = (most > none).any(axis=1).tolist(), denied(low, at, own)
        found = []
        for name in sorted(TEMPLATES):
            for k, (wording, named) in enumerate(self._wordings[name]):
                if not all(w in places for w in named):
                    continue
                for place in places[named[0]]:
                    if near[place] and not denies[place] and (d := self._difference(own, place, (name, k))) is not None:
                        lacking, added, first, end, last = d
                        found.append((-saved(place, name), lacking + added, -len(wording), name, place, last, at[first][0], at[end - 1][1], lacking, added))
        for names, first, last in self._names(text, low, at, own):
            if near[first] and not denies[first]:
                ranked = sorted(((saved(first, n), n) for n in names), reverse=True)
                if len(ranked) == 1 or ranked[0][0] >= ranked[1][0] + MARGIN:
                    found.append((-ranked[0][0], 0, first - last - 1, ranked[0][1], first, last, at[first][0], at[last][1], 0, 0))
        out = []
        held = [False] * len(own)
        for less, _, _, name, place, last, a, b, lacking, added in sorted(found):
            if not any(held[place : last + 1]):
                held[place : last + 1] = [True] * (last + 1 - place)
                out.append((a, b, Match(name, -less, lacking, added)))
        for m in _ADDRESS.finditer(low):
            i = bisect_right(starts, m.start()) - 1
            if i >= 0 and near[i] and not held[i] and not denies[i]:
                name = ADDRESSES[m[0]]
                out.append((*m.span(), Match(name, saved(i, name), 0, 0)))
        for m in _SPDX.finditer(text):
            for x in _SPDX_ID.findall(m[1]):
                name = _SPDX_NAMES.get(re.sub(r"(?:-only|-or-later|\+)$", "", x.lower()))
                if name:
                    out.append((*m.span(), Match(name, int(self.saved(m[0])[self._order[name]]), 0, 0)))
        return out

    def _blocks(self, text: str) -> list[tuple[int, int, Match | None]]:
        """(start, end, match) of the blocks of a paragraph, by place and license."""
        if (known := self._memo.get(text)) is not None:
            return known
        low = lowered(text)
        lines = [m.span() for m in _LINE.finditer(text)]
        starts = [a for a, _ in lines]
        line = lambda at: bisect_right(starts, at) - 1
        cues = sorted({line(m.start()) for m in _CUE.finditer(low)})
        best: dict[tuple[int, int, str], Match] = {}
        for a, b, match in self._notices(text, low):
            first, last = line(a), line(b - 1)
            if (k := bisect_left(cues, first)) < len(cues) and cues[k] <= last:
                key = (first, last, match.license)
                best[key] = min(best.get(key, match), match, key=lambda m: (-m.saved, m.lacking + m.added))
        out = [(lines[i][0], lines[j][1], m) for (i, j, _), m in best.items()]
        covered, reach = set(), -1
        for i, j, _ in sorted(best):
            covered.update(range(max(i, reach + 1), j + 1))
            reach = max(reach, j)
        out += [(*lines[c], None) for c in cues if c not in covered]
        return self._memo.put(text, sorted(out, key=lambda x: (x[0], x[1], x[2].license if x[2] else "")))

    def match(self, block: str) -> Match | None:
        """The license of ``block`` that ranks highest."""
        return min((m for _, _, m in self.scan(block) if m), key=lambda m: (-m.saved, m.lacking + m.added, m.license), default=None)

    def scan(self, text: str) -> list[tuple[int, int, Match | None]]:
        """(start, end, match) of each block and license."""
        low = lowered(text)
        if not _CUE.search(low):
            return []
        return [(p.start() + a, p.start() + b, m) for p in _PARAGRAPH.finditer(text) if _CUE.search(low, *p.span()) for a, b, m in self._blocks(p[0])]


_SCANNERS: list[Scanner] = []
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.int64()), ("lacking", pa.int64()), ("added", pa.int64())]))
_FOUND_SQL = "array<struct<start: long, end: long, license: string, saved: long, lacking: long, added: long>>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blocks): every row's blocks with their confirmed licenses, one entry each (null: none). One pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        own = _SCANNERS[0]
        for batch in it:
            for part in slices(batch, 1):
                rows = [[{"start": a, "end": b} | (vars(m) if m else {}) for a, b, m in own.scan(x)] for x in strings(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _FOUND)], ["key", "blocks"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, blocks {_FOUND_SQL}").withColumnRenamed("key", key)
