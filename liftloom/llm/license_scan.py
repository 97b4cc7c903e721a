"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into words; the hashes of their word k-grams are winnowed (the least of each
window of consecutive hashes is kept) into an inverted index from fingerprint to template and
place.  All k-grams of a whole text are looked up, so a text that shares ``window + k - 1``
words in a row with a template is always found.  ``k`` and ``window`` are those of the template: a text that
covers enough of it, with the other words changed or left out, shares so many words in a row (for 0.75 the window is 1,
so all k-grams are kept; words put in between may still part every one of them).  Hits of one template on nearby diagonals are one
candidate; a banded alignment around its diagonal then counts the template's words that occur in
order and gives the span of the text they lie in.  It is a map: no shuffle, memory bounded by one slice of texts.

Defined cases: a null or empty text has no match and no row.  Words are compared with A-Z
lower-cased and without punctuation at their ends.  Repeated rows give repeated results; a null id passes
through; other columns are ignored.  Ties between matches are ordered by position, then name.
An empty table gives no rows.  The templates are a parameter and small by nature (a few hundred
texts); they are sent with the tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, WINDOW, BAND, LEAST_COVERAGE = 3, 4, 12, 0.75

# Notices and openings of well-known public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "All-rights-notice": "Copyright. All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
# Whole texts of short public licenses, without their copyright lines.
TEMPLATES |= {
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
# ASCII letters and digits, and all bytes of letters beyond ASCII, belong to a word; the rest parts words.
_PLAIN = C.LOWER.copy()
_PLAIN[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window (the last of equal ones); all of a short sequence's least."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, int)
    spans = [hashes[i : i + window] for i in range(max(1, n - window + 1))]
    return np.unique([i + len(s) - 1 - int(np.argmin(s[::-1])) for i, s in enumerate(spans)])


def shape(n: int, least_coverage: float) -> tuple[int, int]:
    """(gram, window) for a template of ``n`` words.

    If ``lost`` of its words are changed or left out, the others are in ``lost + 1`` runs at most, the longest of which has ``run`` words at least.
    """
    matched = min(max(1, math.ceil(least_coverage * n)), n)
    lost = n - matched
    run = -(-matched // (lost + 1))
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


class TemplateIndex:
    """The inverted indexes of all templates, one for each length of grams."""

    def __init__(self, templates: dict[str, str], least_coverage: float = LEAST_COVERAGE):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        entries = defaultdict(list)
        for t, name in enumerate(self.names):
            data = np.frombuffer(templates[name].encode(), np.uint8)
            hashes, _ = C.words(_PLAIN[data], np.array([0, len(data)]))
            if len(hashes) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            self.words.append(hashes)
            gram, window = shape(len(hashes), least_coverage)
            grams = C.roll(hashes, gram)
            entries[gram] += [(int(grams[i]), t, i) for i in winnow(grams, window)]
        # gram -> (keys, template, place)
        self.tables = {g: (np.array([e[0] for e in sorted(found)], np.uint64), *np.array([e[1:] for e in sorted(found)]).T) for g, found in sorted(entries.items())}

    def hits(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """For each length of grams the places of ``hashes`` where a gram of a template starts."""
        return {g: np.flatnonzero(np.isin(C.roll(hashes, g), keys)) if len(hashes) >= g else np.zeros(0, int) for g, (keys, *_) in self.tables.items()}

    def candidates(self, hashes: np.ndarray) -> dict[tuple[int, int], None]:
        """(template, diagonal) of clusters of hits in one text's words."""
        diagonals = defaultdict(set)
        for g, (keys, template, place) in self.tables.items():
            if len(hashes) < g:
                continue
            grams = C.roll(hashes, g)
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                for e in range(lo[i], hi[i]):
                    diagonals[int(template[e])].add(i - int(place[e]))
        found = {}
        for t, at in sorted(diagonals.items()):
            last = None
            for d in sorted(at):
                if last is None or d - last > BAND:
                    found[(t, d)] = None
                    last = d
        return found


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last + 1 place in the text) of a longest common subsequence within ``band`` of a diagonal.

    Of equally long ones it takes a shortest span that ends first.
    """
    width = 2 * band + 1
    # best[k]: (matches, -start of the span) that end at or before text place i + diagonal - band + k
    best = [(0, 0)] * (width + 1)
    ends = [0] * (width + 1)
    n = len(text)
    for i, w in enumerate(template.tolist()):
        row, row_ends = [(0, 0)] * (width + 1), [0] * (width + 1)
        left, left_end = (0, 0), 0
        base = i + diagonal - band
        for k in range(width):
            j = base + k
            value, end = best[k + 1], ends[k + 1]  # template word left out; the text place is the same
            if left > value:
                value, end = left, left_end
            if 0 <= j < n and text[j] == w:
                m, s = best[k]
                cand = (m + 1, s if m else -j)
                if cand > value:
                    value, end = cand, j + 1
            row[k], row_ends[k] = value, end
            left, left_end = value, end
        best, ends = row, row_ends
    k = max(range(width), key=lambda x: best[x])
    return best[k][0], -best[k][1], ends[k]


def outermost(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of matches (start, end, template, matched, words) those that do not lie within a better one, by place.

    The spans kept so far that no other holds have rising starts and rising ends, so one search tells whether any of them holds a span.
    """
    starts: list[int] = []
    ends: list[int] = []
    best = []
    for f in sorted(set(found), key=lambda f: (-f[3], f[4], f[0], f[2])):
        at = bisect_right(starts, f[0])
        if at and ends[at - 1] >= f[1]:
            continue
        best.append(f)
        low, high = bisect_left(starts, f[0]), bisect_right(ends, f[1])
        starts[low : max(low, high)], ends[low : max(low, high)] = [f[0]], [f[1]]
    return sorted(best)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage, n_matched, n_template, byte_start, byte_end.

    Of matches that lie within another of larger count, or of equal count and larger coverage, only the other is given.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates, least_coverage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "license", "coverage", "n_matched", "n_template", "byte_start", "byte_end"]
        for batch in batches:
            rows, out = [], []
            for lo, _, data, at in C.chunks(batch.column(1)):
                plain = _PLAIN[data]
                hashes, first = C.words(plain, at)
                hit = np.unique(np.concatenate([np.zeros(0, int), *index.hits(hashes).values()]))
                if not len(hit):
                    continue
                starts, ends = _bounds(plain, at)
                for d in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
                    a, b = int(first[d]), int(first[d + 1])
                    found = []
                    for t, diagonal in index.candidates(hashes[a:b]):
                        n = len(index.words[t])
                        s = max(a, a + diagonal - BAND)
                        text = hashes[s : min(b, a + diagonal + n + BAND)]
                        # words of the other at all: no alignment has more
                        if min(np.isin(text, index.words[t]).sum(), np.isin(index.words[t], text).sum()) < least_coverage * n:
                            continue
                        m, x, y = align(index.words[t], text, a + diagonal - s)
                        if m >= least_coverage * n:
                            found.append((s + x, s + y, t, m, n))
                    for x, y, t, m, n in outermost(found):
                        rows.append(lo + d)
                        out.append((index.names[t], m / n, m, n, int(starts[x] - at[d]), int(ends[y - 1] - at[d])))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c) for c in zip(*out, strict=True))], names=names)

    schema = "doc_id long, license string, coverage double, n_matched long, n_template long, byte_start long, byte_end long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(C.tidied(work), schema)


def _bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that ``common.words`` hashes."""
    inside = np.append(~C.SPACE[data], False)
    before = np.concatenate([[False], inside[:-1]])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    return np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
