"""Licence notices by patience alignment (operator 2).

Words are runs of letters, digits and bytes of other alphabets, lower-cased.
For each template, stretches of text are looked for that hold ``COVERAGE`` of its
words in order, in at most ``STRETCH`` words for each of its own (templates under
``SHORT`` words, whose words are common in prose, keep ``SHORT_STRETCH``).  In a
stretch, words that occur once in both the text and the template are anchors;
their longest increasing subsequence is kept, and the gaps between them are
aligned in the same way (by a plain longest common subsequence where no word is
unique, or where crossing anchors would cost aligned words).  The share of the
template's words that are aligned is the coverage, the place goes from the first to
the last aligned word.

The search loses nothing.  How many of the template's words a stretch can align is
bounded by the words both have, copies counted, for all starts at once; what is left
is read word by word, and for every length of an alignment its latest possible start is
kept.  So the first end of a stretch with enough aligned words is exact: every such stretch of
a text overlaps a notice that is found.  Of the stretches that hold this end, the one with
most aligned words stays, each weighed against ``STRETCH`` words of length.

Defined results: a null or empty text has no notices; several notices, also
equal ones, in one text are all reported, by place, but of overlapping ones
only that with most aligned words (then coverage, then name); repeated rows are treated
alike; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_chunks, word_hashes

COVERAGE = 0.8
STRETCH = 4             # words of text for a word of the template
SHORT, SHORT_STRETCH = 20, 2

# Public licence notices.
TEMPLATES = {
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details."),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "epl-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Lesser General Public License for more details."),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
}

_PLAIN = np.arange(256, dtype=np.uint8)     # every mark between words becomes a blank
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


class Templates:
    """Templates as sequences of word numbers, and the sorted hashes of their words."""

    def __init__(self, texts: dict[str, str]):
        sequences = []
        for _, _, data, offsets in text_chunks(pa.array(list(texts.values()), pa.string())):
            h, first = word_hashes(_PLAIN[data], offsets)
            sequences += [h[a:b] for a, b in zip(first[:-1], first[1:])]
        self.names = list(texts)
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *sequences]))
        self.sequences = [np.searchsorted(self.words, s) for s in sequences]
        self.member = np.zeros((len(self.words), len(sequences)), np.float32)
        for i, s in enumerate(self.sequences):
            self.member[s, i] = 1
        self.need = [max(1, int(np.ceil(COVERAGE * len(s) - 1e-9))) for s in self.sequences]
        self.stretch = [SHORT_STRETCH if len(s) < SHORT else STRETCH for s in self.sequences]
        self.copies = [np.bincount(s, minlength=len(self.words)) for s in self.sequences]
        # aligned words that number ``need`` leave out at most the rest, so at least this many different ones
        self.need_different = [max(1, len(set(s.tolist())) - (len(s) - n)) for s, n in zip(self.sequences, self.need)]


def _unique(x: np.ndarray) -> dict[int, int]:
    """Values that occur once, with their places."""
    values, first, n = np.unique(x, return_index=True, return_counts=True)
    return dict(zip(values[n == 1].tolist(), first[n == 1].tolist()))


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        lo, hi = 0, len(tops)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if tops[mid] < v else (lo, mid)
        before[i] = piles[lo - 1] if lo else -1
        if lo == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[lo], piles[lo] = v, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        hit = np.where(b == a[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned pairs of places in text a and template b, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        ua, ub = _unique(a[a0:a1]), _unique(b[b0:b1])
        anchors = sorted((ua[w], ub[w]) for w in ua.keys() & ub.keys())
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        anchors = [anchors[i] for i in increasing([q for _, q in anchors])]
        out += [(a0 + i, b0 + j) for i, j in anchors]
        edges = [(-1, -1), *anchors, (a1 - a0, b1 - b0)]
        todo += [(a0 + p + 1, a0 + q, b0 + r + 1, b0 + s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def _reachable(place: np.ndarray, term: np.ndarray, copies: np.ndarray, need: int, span: int) -> np.ndarray:
    """Which words lie in some stretch of ``span`` words that has ``need`` words of the template, copies counted."""
    n = len(place)
    order = np.argsort(term, kind="stable")
    source = np.arange(n) - copies[term[order]]
    same = (source >= 0) & (term[order[source]] == term[order])
    before = np.empty(n, np.int64)          # a stretch that begins here or earlier has enough copies without this word
    before[order] = np.where(same, place[order[source]], -1)
    first = np.searchsorted(place, np.maximum(before, place - span) + 1)
    count = np.cumsum(np.bincount(first, minlength=n + 1)[:n] - np.bincount(np.arange(n) + 1, minlength=n + 1)[:n])
    starts = np.flatnonzero(count >= need)
    ends = np.searchsorted(place, place[starts] + span)
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def stretches(place: np.ndarray, term: np.ndarray, sequence: np.ndarray, need: int, stretch: int) -> list[tuple[int, int, int]]:
    """(first place, last place, longest common subsequence) of the stretches of a text that align ``need`` words.

    ``start[j, l]`` is the latest place from which the words read so far align l of the template's first j words.
    """
    size, found = len(sequence), []
    span = size * stretch
    rows = {w: np.flatnonzero(sequence == w)[::-1].tolist() for w in set(sequence.tolist())}
    start = np.full((size + 1, size + 1), -1, np.int64)
    places, terms = place.tolist(), term.tolist()
    aligned = np.arange(size + 1)
    k, best, first_end = 0, None, -1            # best: (value, aligned, first place, last place)
    while k <= len(places):
        # the most that a stretch could still be worth which ends here and begins by the first end
        if best and (k == len(places) or size * stretch - (places[k] - first_end + 1) < best[0]):
            found.append((best[2], best[3], best[1]))
            k, best = bisect_left(places, best[3] + 1), None        # read on behind it
            start[:] = -1
            continue
        if k == len(places):
            break
        p = places[k]
        k += 1
        start[:, 0] = p
        for j in rows[terms[k - 1]]:        # from the last to the first, so that each sees the state before this word
            np.maximum(start[j + 1:, 1:], start[j, :-1].copy(), out=start[j + 1:, 1:])
        low = max(p - span + 1, 0)
        if start[size, need] < low:
            continue
        first_end = first_end if best else p
        most = int((start[size, 1:] >= low).sum())
        begin, n = start[size, need: most + 1], aligned[need: most + 1]
        value = np.where(begin <= first_end, n * stretch - (p - begin + 1), -span)
        at = len(value) - 1 - int(value[::-1].argmax())
        if begin[at] <= first_end and (best is None or (value[at], n[at]) > best[:2]):
            best = (int(value[at]), int(n[at]), int(begin[at]), p)
    return found


def notices(place: np.ndarray, term: np.ndarray, t: Templates, candidates) -> list[tuple[int, int, str, float]]:
    """(first word, word after the last, template, coverage) found among a text's template words, by place."""
    found = []
    for i in candidates:
        sequence, need, stretch = t.sequences[i], t.need[i], t.stretch[i]
        mine = t.member[term, i] > 0
        at, words = place[mine], term[mine]
        if len(at) < need:
            continue
        near = _reachable(at, words, t.copies[i], need, len(sequence) * stretch)
        at, words = at[near], words[near]
        for first, last, most in stretches(at, words, sequence, need, stretch):
            own = words[np.searchsorted(at, first): np.searchsorted(at, last) + 1]
            pairs = align(own, sequence)
            if len(pairs) < most:       # crossing anchors
                pairs = _common(own, sequence)
            found.append((-len(pairs), -len(pairs) / len(sequence), t.names[i], first, last + 1))
    kept: list[tuple[int, int, str, float]] = []
    places: list[int] = []
    for _, coverage, name, a, b in sorted(found):       # where notices overlap, the one with more aligned words
        k = bisect_left(places, b)                      # those before begin in front of this one's end
        if not k or kept[k - 1][1] <= a:
            places.insert(k, a)
            kept.insert(k, (a, b, name, -coverage))
    return kept


def license_notices(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: id, n_words and an array of notices (license, first_word, end_word, coverage)."""
    ship_package(df.sparkSession)
    t = Templates(TEMPLATES if templates is None else templates)
    item = pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("coverage", pa.float64())])

    def run(batches):
        words = t.words
        top = np.zeros(1 << 16, dtype=bool)
        top[words >> np.uint64(48)] = True
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column(1)):
                h, first = word_hashes(_PLAIN[data], offsets)
                maybe = np.flatnonzero(top[h >> np.uint64(48)])
                term = np.searchsorted(words, h[maybe])
                term[term == len(words)] = 0
                true = words[term] == h[maybe] if len(words) else np.zeros(0, bool)
                place, term = maybe[true], term[true]
                cut = np.searchsorted(place, first)
                present = np.zeros((end - at, len(words)), np.float32)
                present[np.repeat(np.arange(end - at), np.diff(cut)), term] = 1
                enough = present @ t.member >= np.array(t.need_different, np.float32)
                out = []
                for d in range(end - at):
                    lo, hi = cut[d], cut[d + 1]
                    found = notices(place[lo:hi] - first[d], term[lo:hi], t, np.flatnonzero(enough[d])) if enough[d].any() else []
                    out.append([{"license": n, "first_word": a, "end_word": b, "coverage": c} for a, b, n, c in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(np.diff(first), pa.int64()), pa.array(out, pa.list_(item))],
                    names=[id_col, "n_words", "notices"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, notices array<struct<license:string,first_word:int,end_word:int,coverage:double>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: number of notices, the best one and all as text."""
    best = F.expr("get(array_sort(notices, (l, r) -> case when l.coverage <> r.coverage then if(l.coverage > r.coverage, -1, 1) "
                  "else (r.end_word - r.first_word) - (l.end_word - l.first_word) end), 0)")
    return found.select(
        id_col, "n_words", F.size("notices").cast("long").alias("n_notices"), best["license"].alias("license"),
        F.round(best["coverage"], 4).alias("coverage"),
        F.expr("array_join(transform(notices, n -> concat_ws(':', n.license, n.first_word, n.end_word)), ',')").alias("places"))
