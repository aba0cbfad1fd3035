"""Operator 8, license scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are normalised to words (lower case, outer punctuation off, words of punctuation only left out,
as the marks of wrapped comments are). Of every ``GRAM`` consecutive words a
fingerprint is made; winnowing keeps the least of each ``WINDOW`` neighbours, so a shared run of GRAM + WINDOW - 1
words always shares a kept one. A text that reaches ``coverage`` by changed or missing words alone has such a run if
the template is long enough (from 16 words on at 0.8). Shorter templates have no fingerprints: a text is a candidate
where a stretch of the template's length and the band on both sides holds enough of its words, counted with their
repetitions, so that changed, missing and added words cannot hide a match. The kept ones form an inverted index: fingerprint -> (template, place). A document's
fingerprints are looked up in it. Around a hit of a long template the whole template is aligned with the text that may
belong to it, on as many diagonals as missing and added words make; a short one is aligned within a band of ``BAND``
words around its hits. A match is reported where the share of the template's
words that are aligned to equal words reaches ``coverage``, with its span in characters of the original text.

Templates are a small parameter and travel with the code; documents are scanned where they lie, with no shuffle.

Edge cases: null and empty texts have no match; very long texts are scanned whole; only the id and text columns are
read, so further columns of any name do no harm; every repetition in a text is reported, overlapping matches of
one template only once (the best, then the first); repeated rows are scanned each; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

#: Public notices, as their licenses word them.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The default table: public license texts and notices, whole and as files name them. ``templates`` takes any other table.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        f"of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause-text": f"{_BSD_HEAD} {_BSD_ONE} {_BSD_TWO} {_BSD_END}",
    "bsd-3-clause-text": f"{_BSD_HEAD} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        f"copyright notice and this permission notice appear in all copies. {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
_EDGE = string.punctuation


def normalised(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


class Index:
    """Vocabulary, inverted index of the winnowed fingerprints, and the templates as word numbers."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, coverage: float = COVERAGE):
        self.names, self.gram = list(templates), gram
        self.word: dict[str, int] = {}
        self.templates = [np.array([self.word.setdefault(w, len(self.word)) for w in normalised(t)], np.int64) for t in templates.values()]
        self.base = len(self.word) + 1
        self.need = [math.ceil(coverage * len(t) - 1e-9) for t in self.templates]
        # those that can reach the coverage without a run that surely shares a fingerprint
        self.short = [t for t, w in enumerate(self.templates) if len(w) and -(-self.need[t] // (len(w) - self.need[t] + 1)) < gram + window - 1]
        self.most = np.array([np.bincount(self.templates[t], minlength=self.base) for t in self.short], np.int64).reshape(-1, self.base)
        places: dict[int, set[tuple[int, int]]] = {}
        for t, words in enumerate(self.templates):
            if t in self.short:
                continue
            prints = self.prints(words)
            mixed = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            for at in range(max(1, len(prints) - window + 1)):
                part = mixed[at : at + window]
                if len(part):
                    best = at + int(np.flatnonzero(part == part.min())[-1])  # the rightmost least
                    places.setdefault(int(prints[best]), set()).add((t, best))
        self.keys = np.array(sorted(places), np.int64)
        self.places = [sorted(places[k]) for k in self.keys.tolist()]

    def prints(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.gram + 1
        out = np.zeros(max(0, n), np.int64)
        for i in range(self.gram if n > 0 else 0):
            out = out * self.base + words[i : i + n]
        return out


def align(words: list[int], template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 in the text): best alignment of the whole template near ``diagonal``.

    Text before and after is free; gaps in text or template cost half a match, unequal words one.
    """
    free, worst = 0.0, -1e9
    width = 2 * band + 1
    # cell d of row i stands for text place i + diagonal - band + d; value: (score, matches, start)
    row = [(free, 0, i) for i in range(diagonal - band, diagonal - band + width)]
    for i, t in enumerate(template.tolist()):
        new: list[tuple[float, int, int]] = []
        for d in range(width):
            at = i + diagonal - band + d
            score, hits, start = row[d]
            if 0 <= at < len(words) and words[at] == t:
                best = (score + 1, hits + 1, start)
            else:
                best = (score - 1, hits, start)
            if d + 1 < width and row[d + 1][0] - 0.5 > best[0]:  # a template word is missing in the text
                best = (row[d + 1][0] - 0.5, *row[d + 1][1:])
            if d and new[d - 1][0] - 0.5 > best[0]:  # an extra word in the text
                best = (new[d - 1][0] - 0.5, *new[d - 1][1:])
            new.append(best if best[0] > worst else (worst, 0, at))
        row = new
    d = max(range(width), key=lambda d: (row[d][0], -abs(d - band)))
    end = len(template) + diagonal - band + d
    return row[d][1], max(0, row[d][2]), min(len(words), max(0, end))


def align_within(words: np.ndarray, template: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first, last + 1): best alignment of the whole template with a stretch of text, by whole rows.

    The rules are those of ``align``, without a band: a row is a template word, and extra words of the text are a running
    maximum along it.
    """
    places = np.arange(len(words) + 1)
    half = places * 0.5
    score, hits, start = np.zeros(len(places)), np.zeros(len(places), np.int64), places
    for t in template.tolist():
        same = words == t
        best, best_hits, best_start = score - 0.5, hits, start  # the template's word is missing
        straight = score[:-1] + np.where(same, 1.0, -1.0)
        take = np.append(False, straight >= best[1:])
        best = np.where(take, np.append(0.0, straight), best)
        best_hits = np.where(take, np.append(0, hits[:-1] + same), best_hits)
        best_start = np.where(take, np.append(0, start[:-1]), best_start)
        lifted = best + half
        run = np.maximum.accumulate(lifted)
        come_from = np.maximum.accumulate(np.where(lifted >= run, places, 0))  # extra words since then
        score, hits, start = run - half, best_hits[come_from], best_start[come_from]
    end = int(np.where(score == score.max(), hits, -1).argmax())
    return int(hits[end]), int(start[end]), end


def chained(words: np.ndarray, template: np.ndarray, hits: list[tuple[int, int]], need: int) -> list[tuple[int, int, int]]:
    """(matched, first, last + 1) of the matches of a long template, by way of its shared fingerprints (text place, template place).

    The whole template is aligned with the stretch of text around a hit that may belong to it, so that words that are
    missing or added in a row, up to a quarter of the template or ``BAND``, don't part a match: its pieces lie on several
    diagonals of one alignment. What lies before and after a match is looked at again without it.
    """
    drift = max(BAND, len(template) // 4)
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(words), sorted(hits))]
    while todo:
        low, high, some = todo.pop()
        if not some:
            continue
        spot, place = some[0]
        lo, hi = max(low, spot - place - 2 * drift), min(high, spot + len(template) - place + 2 * drift)
        matched, first, last = align_within(words[lo:hi], template)
        first, last = first + lo, last + lo
        if matched >= need:
            found.append((matched, first, last))
            todo += [(low, first, [h for h in some if h[0] < first]), (last, high, [h for h in some if h[0] >= last])]
        else:  # what is within the drift of this hit was part of the alignment
            todo.append((low, high, [h for h in some[1:] if not (h[0] < hi and abs(h[0] - h[1] - spot + place) <= drift)]))
    return found


def shared_grams(words: np.ndarray, index: Index) -> dict[int, list[tuple[int, int]]]:
    """The kept fingerprints that the text shares with each long template: (text place, template place)."""
    n = len(words) - index.gram + 1
    hits: dict[int, list[tuple[int, int]]] = {}
    if n <= 0 or not len(index.keys):
        return hits
    ok = words[:n] >= 0
    for i in range(1, index.gram):
        ok &= words[i : i + n] >= 0
    spots = np.flatnonzero(ok)
    prints = np.zeros(len(spots), np.int64)
    for i in range(index.gram):
        prints = prints * index.base + words[spots + i]
    at = np.minimum(np.searchsorted(index.keys, prints), len(index.keys) - 1)
    for h in np.flatnonzero(index.keys[at] == prints).tolist():
        for t, place in index.places[at[h]]:
            hits.setdefault(t, []).append((int(spots[h]), place))
    return hits


def shared_words(words: np.ndarray, index: Index, band: int) -> dict[int, set[int]]:
    """The diagonals of each short template in stretches of the text that hold enough of its words."""
    known = words[words >= 0]
    held = np.minimum(np.bincount(known, minlength=index.base), index.most).sum(axis=1)
    diagonals: dict[int, set[int]] = {}
    for s, t in enumerate(index.short):
        if held[s] < index.need[t]:
            continue
        most, template = index.most[s], index.templates[t].tolist()
        spots = np.flatnonzero((words >= 0) & (most[words] > 0)).tolist()  # -1 reads the last number, which no word has
        here, have, first, marked = dict.fromkeys(template, 0), 0, 0, 0
        for last, spot in enumerate(spots):
            here[words[spot]] += 1
            have += here[words[spot]] <= most[words[spot]]
            while spot - spots[first] >= len(template) + 2 * band:
                have -= here[words[spots[first]]] <= most[words[spots[first]]]
                here[words[spots[first]]] -= 1
                first += 1
            if have >= index.need[t]:
                for p in spots[max(first, marked) : last + 1]:
                    diagonals.setdefault(t, set()).update(p - i for i, w in enumerate(template) if w == words[p])
                marked = last + 1
    return diagonals


def scan_text(text: str, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[dict]:
    stripped = [w.strip(_EDGE) for w in text.lower().split()]
    places = [i for i, w in enumerate(stripped) if w]
    number = [index.word.get(stripped[i], -1) for i in places]
    words = np.array(number, np.int64)
    long, short = shared_grams(words, index), shared_words(words, index, band)
    out: list[dict] = []
    spans: list[tuple[int, int]] = []
    for t in long | short:
        template, tried, mine = index.templates[t], None, []
        if t in long:
            mine = [(m / len(template), a, b, m) for m, a, b in chained(words, template, long[t], math.ceil(coverage * len(template) - 1e-9))]
        for diagonal in sorted(short.get(t, ())):
            if tried is not None and diagonal - tried <= band // 2:
                continue  # within the band of the last alignment
            tried = diagonal
            matched, first, last = align(number, template, diagonal, band)
            if matched >= coverage * len(template):
                mine.append((matched / len(template), first, last, matched))
        mine.sort(key=lambda m: (-m[0], m[2] - m[1], m[1]))
        chosen: list[tuple] = []
        for m in mine:
            if all(m[2] <= c[1] or m[1] >= c[2] for c in chosen):
                chosen.append(m)
        if chosen and not spans:
            spans = [m.span() for m in re.finditer(r"\S+", text)]
        out += [{"license": index.names[t], "coverage": c, "matched_words": m, "start": spans[places[a]][0], "end": spans[places[b - 1]][1]} for c, a, b, m in chosen]
    return sorted(out, key=lambda m: (m["start"], m["license"]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: id, n_matches, matches (license, coverage, matched_words, start, end)."""
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(given, coverage=coverage)
        for batch in batches:
            found = [scan_text(t, index, coverage=coverage) if t else [] for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_matches": [len(f) for f in found], "matches": found})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, n_matches int, matches array<struct<license:string,coverage:double,matched_words:int,start:int,end:int>>"
    return rows.mapInPandas(run, kinds).withColumnRenamed("id", id_col)
