"""License scans by patience alignment.

Words that are unique in both the text and a template are anchors; the longest increasing
subsequence of their positions is kept, and the gaps between anchors are aligned in the same way
again.  A text that holds a template twice, or its words elsewhere too, has few anchors or none: windows
of the text that hold enough of the template's words are then aligned exactly, by longest common
subsequences on bits, and the best of all alignments counts.  The share of the template's words that are
aligned is its coverage.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_text, public_id
from .kernels import ALNUM, words

# Names and texts of licenses and license notices.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


#: Words of text per template word within which a notice without unique words counts as one notice.
WIDTH = 2


def tokens(text: str) -> list[str]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    column = pa.array([text])
    (w,) = words(column, lower=True, limit=1 << 62, table=ALNUM)
    raw = w.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start.tolist(), w.end.tolist())]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, given by first member, whose second members rise."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tails, y)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [y]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text position, template position) pairs, rising in both."""
    out = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        wanted = set(template[c:d])
        here, there = Counter(w for w in text[a:b] if w in wanted), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = _rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place and here[w] == 1])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _subsequence(text: list[str], places: dict[str, int], size: int) -> list[int]:
    """Bits of each row of the table of longest common subsequences: a zero is one word more.
    ``places`` has the bits of a template of ``size`` words at which each word stands."""
    full = (1 << size) - 1
    row, out = full, []
    for w in text:
        both = row & places.get(w, 0)
        row = ((row + both) | (row - both)) & full
        out.append(row)
    return out


def _length(rows: list[int], size: int) -> int:
    return size - rows[-1].bit_count() if rows else 0


def windows(text: list[str], template: list[str], least: float, known: int = 0) -> list[tuple[int, int]]:
    """The best alignment within a window of ``WIDTH`` times the template's words and 8, the first of equal
    ones, if it has more than ``known`` words and ``least`` of the template; else none."""
    m, have = len(template), Counter(template)
    width = WIDTH * m + 8
    places: dict[str, int] = {}
    for j, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << j
    hits = [i for i, w in enumerate(text) if w in places]
    within: Counter = Counter()
    most, end, best, start = 0, 0, known, -1
    for k, i in enumerate(hits):
        while end < len(hits) and hits[end] < i + width:
            w = text[hits[end]]
            within[w] += 1
            most += within[w] <= have[w]
            end += 1
        if most >= least * m and most > best:
            got = _length(_subsequence([text[h] for h in hits[k:end]], places, m), m)
            if got > best and got >= least * m:
                best, start = got, k
                if best == m:
                    break
        most -= within[text[i]] <= have[text[i]]
        within[text[i]] -= 1
    if start < 0:
        return []
    own = [h for h in hits[start:] if h < hits[start] + width]
    length = lambda a, b: _length(_subsequence([text[h] for h in own[a:b]], places, m), m)
    last = bisect.bisect_left(range(len(own)), best, key=lambda b: length(0, b + 1)) + 1
    first = bisect.bisect_left(range(last), -best + 1, key=lambda a: -length(a, last)) - 1
    own = own[first:last]
    rows, out = _subsequence([text[h] for h in own], places, m), []
    i, j = len(own), m
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((own[i], j))
    return out[::-1]


def license_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, matches of every row.

    ``matches`` has a struct per template that is covered to ``least`` or more; the other columns
    are of the best (ties: the longer template, then the first named) or null.  Only documents that
    hold enough of a template's distinct words are aligned: with fewer, its coverage can't be
    reached.  A null or empty text has no license; a null id stays null, repeated rows stay; an
    empty table gives no rows.
    """
    split_ = {name: tokens(t) for name, t in templates.items()}

    def vocabulary() -> tuple[np.ndarray, np.ndarray]:
        every = sorted({w for t in split_.values() for w in t})
        (w,) = words(pa.array([" ".join(every)]), lower=True, limit=1 << 62, table=ALNUM)
        h = w.hashes()
        order = np.argsort(h)
        count = np.array([[t.count(every[i]) for i in order] for t in split_.values()])
        return h[order], count

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = vocabulary()
        total = count.sum(1)
        for batch in batches:
            keys, rows = batch[0].to_pylist(), []
            for w in words(batch[1], lower=True, table=ALNUM):
                n = len(w.first) - 1
                h = w.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                # Template words that a document could cover at most: all copies of the words it has.
                has = np.zeros((n, len(known)), bool)
                has[w.doc()[hit], at[hit]] = True
                most = has @ count.T
                raw = w.data.tobytes()
                for i in range(n):
                    found = []
                    names = [k for k, (name, _) in enumerate(split_.items()) if most[i, k] >= least * total[k]]
                    if names:
                        a, b = w.first[i], w.first[i + 1]
                        text = [raw[x:y].decode("utf-8", "replace") for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
                    for k in names:
                        name, template = list(split_.items())[k]
                        pairs = patience(text, template)
                        if len(pairs) < len(template):
                            pairs = windows(text, template, least, len(pairs)) or pairs
                        if len(pairs) >= least * len(template):
                            found.append({"license": name, "coverage": len(pairs) / len(template), "first_word": pairs[0][0], "last_word": pairs[-1][0], "aligned": len(pairs)})
                    best = max(found, key=lambda f: (f["coverage"], f["aligned"]), default=None)
                    rows.append({"_id": keys[w.row0 + i], **{c: best and best[c] for c in ("license", "coverage", "first_word", "last_word")}, "matches": found})
            kind = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("aligned", pa.int64())])
            schema = pa.schema([("_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matches", pa.list_(kind))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = "_id long, license string, coverage double, first_word long, last_word long, matches array<struct<license:string,coverage:double,first_word:long,last_word:long,aligned:long>>"
    out = ids_and_text(docs, id_col, text_col).mapInArrow(scan, schema)
    return out.select(public_id(), "license", "coverage", "first_word", "last_word", "matches")
