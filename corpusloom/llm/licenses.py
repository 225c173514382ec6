"""License scans by patience alignment of texts with license templates.

A word that every copy of a template must have some of opens a window of the text where
the template would lie. Window and template are aligned: words that occur once in both are
anchors, the longest increasing run of them is kept, and the gaps between anchors are
aligned in the same way. Coverage is the share of the template's words that found their
match. A find covers ``LEAST_COVERAGE`` or more, and has the words that tell a license
from its relatives, its name and version, side by side and unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.text import text_of
from corpusloom.session import ship

LEAST_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

# Published notices and license texts. Double brackets hold what names the license.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the [[Apache License, Version 2.0]].",
    "Apache-2.0-notice": (
        'Licensed under the [[Apache License, Version 2.0]] (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MIT-line": "Released under the [[MIT License]].",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-line": "Released under the [[BSD License]].",
    "BSD-2-Clause-line": "Released under the [[BSD 2-Clause]] License.",
    "BSD-3-Clause-line": "Released under the [[BSD 3-Clause]] License.",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "ISC-line": "Released under the [[ISC License]].",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "[[provided that]] the above copyright notice and this permission notice appear in all copies."
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is [[hereby granted. THE SOFTWARE IS PROVIDED]]",
    "GPL-2.0-line": "This work is licensed under the [[GNU General Public License, version 2]].",
    "GPL-3.0-line": "This work is licensed under the [[GNU General Public License, version 3]].",
    "LGPL-2.1-line": "This work is licensed under the [[GNU Lesser General Public License, version 2.1]].",
    "LGPL-3.0-line": "This work is licensed under the [[GNU Lesser General Public License, version 3]].",
    "AGPL-3.0-line": "This work is licensed under the [[GNU Affero General Public License, version 3]].",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the [[GNU General Public License]] as "
        "published by the Free Software Foundation; either [[version 2]] of the License, or (at your option) any later version."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the [[GNU General Public License]] as "
        "published by the Free Software Foundation, either [[version 3]] of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the [[GNU Lesser General Public License]] as "
        "published by the Free Software Foundation; either [[version 2.1]] of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the [[GNU Lesser General Public License]] as "
        "published by the Free Software Foundation, either [[version 3]] of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the [[GNU Affero General Public License]] as "
        "published by the Free Software Foundation, either [[version 3]] of the License, or (at your option) any later version."
    ),
    "MPL-2.0-line": "Licensed under the [[Mozilla Public License, version 2.0]].",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the [[Mozilla Public License, v. 2.0]]. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "EPL-1.0-line": "Licensed under the [[Eclipse Public License, version 1.0]].",
    "EPL-2.0-line": "Licensed under the [[Eclipse Public License, version 2.0]].",
    "ECL-2.0-line": "Licensed under the [[Educational Community License, Version 2.0]].",
    "CDDL-1.0-line": "Licensed under the [[Common Development and Distribution License, version 1.0]].",
    "EUPL-1.2-line": "Licensed under the [[European Union Public Licence, version 1.2]].",
    "Artistic-2.0-line": "Released under the [[Artistic License 2.0]].",
    "BSL-1.0-line": "Distributed under the [[Boost Software License, Version 1.0]].",
    "OFL-1.1-line": "This Font Software is licensed under the [[SIL Open Font License, Version 1.1]].",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "WTFPL": "You just [[DO WHAT THE FUCK YOU WANT TO]].",
    "CC0-1.0-line": "Released under [[CC0 1.0]] Universal.",
}
# Rule: the licenses of one family, by their terms, names and versions.
CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in CC_TERMS.items():
    for _version in ("3.0", "4.0"):
        TEMPLATES[f"CC-{_short}-{_version}-line"] = f"Licensed under [[CC {_short} {_version}]]."
        TEMPLATES[f"CC-{_short}-{_version}-notice"] = f"This work is licensed under a [[Creative Commons {_long} {_version}]] International License."

#: Words too common to open a window, where a template has others.
COMMON = frozenset("a all an and any are as at be by can copy for form from in is it list no not of on or the this that to use with without you".split())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs``, which ascend in the first place, ascending in the second."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before.append(at[k - 1] if k else -1)
        tails[k:k + 1], at[k:k + 1] = [b], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _once(words: list[str], low: int, high: int) -> dict[str, int]:
    place: dict[str, int] = {}
    for i in range(low, high):
        place[words[i]] = -1 if words[i] in place else i
    return {w: i for w, i in place.items() if i >= 0}


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched positions ``(in text, in template)``, ascending in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        mine, theirs = _once(text, a, b), _once(template, c, d)
        anchors = _increasing(sorted((i, theirs[w]) for w, i in mine.items() if w in theirs))
        out += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    """Words of a template, the places of its names, and the words that open windows.

    A find has all of the name words, so the rarest of them is enough to open a window.
    Without a name, a find misses fewer words than ``openers`` has places.
    """

    def __init__(self, name: str, text: str, least: float = LEAST_COVERAGE):
        self.name, self.words, self.names = name, [], []
        for k, part in enumerate(re.split(r"\[\[|\]\]", text.lower())):
            found = WORD.findall(part)
            if k % 2 and found:
                self.names.append((len(self.words), len(self.words) + len(found)))
            self.words += found
        if not self.words:
            raise ValueError(f"template {name} has no words")
        number = {w: self.words.count(w) for w in self.words}
        rarest = sorted(range(len(self.words)), key=lambda i: (self.words[i] in COMMON, number[self.words[i]], -len(self.words[i]), i))
        named = [i for i in rarest if any(a <= i < b for a, b in self.names)]
        most_missing = len(self.words) - -int(-least * len(self.words) // 1)
        self.openers: dict[str, list[int]] = {}
        for i in named[:1] or rarest[:most_missing + 1]:
            self.openers.setdefault(self.words[i], []).append(i)

    def find(self, window: list[str], least: float) -> list[tuple[int, int]] | None:
        """Matched positions if the window holds the template, its names unchanged."""
        pairs = patience(window, self.words)
        if len(pairs) < least * len(self.words):
            return None
        at = {j: i for i, j in pairs}
        for a, b in self.names:
            if any(j not in at or at[j] - at[a] != j - a for j in range(a, b)):
                return None
            if window[at[b - 1] + 1:at[b - 1] + 2] and self.words[b - 1].isdigit() and window[at[b - 1] + 1].isdigit() and self.words[b:b + 1] != window[at[b - 1] + 1:at[b - 1] + 2]:
                # A version goes on in the text: 2 is not 2.1, but it is 2.0.
                if set(window[at[b - 1] + 1]) != {"0"}:
                    return None
        return pairs


def scan(text: str, templates: list[Template], least: float = LEAST_COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """``(template, start, end, matched words, coverage)`` of each find; code points, end exclusive."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift positions
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    present = [t for t in templates if any(w in low for w in t.openers)]
    if not present:
        return []
    spots = list(WORD.finditer(low))
    words = [m[0] for m in spots]
    where: dict[str, list[int]] = {w: [] for t in present for w in t.openers}
    for i, w in enumerate(words):
        if w in where:
            where[w].append(i)
    out = []
    for t in present:
        n, done = len(t.words), -1
        for i, offset in sorted((i, o) for w, places in t.openers.items() for o in places for i in where[w]):
            if i <= done:
                continue
            # First a window of the template's size with some slack, then, for worn copies, a wide one.
            for slack in (3 + n // 4, 3 + n):
                start = max(0, done + 1, i - offset - slack)
                matched = t.find(words[start:i - offset + n + slack], least)
                if matched:
                    first, last = start + matched[0][0], start + matched[-1][0]
                    out.append((t.name, spots[first].start(), spots[last].end(), len(matched), len(matched) / n))
                    done = last
                    break
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per document: ``doc_id``, ``license`` (the find with most matched words,
    ties to the earlier, then by name), ``coverage`` and ``finds``.

    Null, empty and unlicensed texts have no license, coverage 0 and no finds. Repeated
    rows are scanned alike; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    chosen = dict(TEMPLATES if templates is None else templates)
    find = "struct<name:string,start:long,end:long,words:long,coverage:double>"

    def run(batches):
        tools = [Template(n, t) for n, t in chosen.items()]
        kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64())]))
        for batch in batches:
            found = [scan(t, tools, least) for t in batch.column("_text").to_pylist()]
            best = [min(f, key=lambda x: (-x[3], x[1], x[0])) if f else None for f in found]
            rows = [[dict(zip(("name", "start", "end", "words", "coverage"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([b[0] if b else None for b in best], pa.string()),
                    pa.array([b[4] if b else 0.0 for b in best], pa.float64()), pa.array(rows, kind),
                ],
                ["doc_id", "license", "coverage", "finds"],
            )

    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("_text"))
    return source.mapInArrow(run, f"doc_id long, license string, coverage double, finds array<{find}>")
