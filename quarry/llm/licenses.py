"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.spark import arrow_map, documents
from quarry.llm.text import NOT_ALNUM, Words, chunks, code_points, grams

# Wordings of licenses and of the lines that point to them, without names and years.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Tokens of a fingerprinted gram, and grams of a winnowing window: a common run of GRAM + WINDOW - 1 tokens is always seen.
GRAM = 3
WINDOW = 4
#: Diagonals on each side that an alignment may leave its candidate by.
BAND = 12
#: Scores of alignment.
MATCH, MISMATCH, GAP = 2, -2, -2
#: Share of a template's tokens that must be matched.
COVERAGE = 0.6
#: Bytes of templates, at most.
TEMPLATE_BYTES = 8 << 20


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the last of equal ones) of each window; of all grams where there are fewer than a window."""
    if len(h) < window:
        return np.arange(len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class TemplateIndex:
    """Inverted index: gram hash to (template, position) of winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.tokens = [], []
        key, owner, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, text in sorted(templates.items()):
            (_, data, offs), *_ = chunks(pa.array([text or " "], pa.large_string()))
            t = Words(data, offs, NOT_ALNUM).hash
            if len(t) < GRAM:
                continue  # a template of one or two words says nothing
            h, place = grams(t, np.zeros(len(t), np.int8), GRAM)
            # a template of few words is found by any of its grams
            pick = winnow(h, WINDOW if len(t) >= 4 * (GRAM + WINDOW) else 1)
            key.append(h[pick]), at.append(place[pick]), owner.append(np.full(len(pick), len(self.names)))
            self.names.append(name), self.tokens.append(t)
        key = np.concatenate(key)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.at = key[order], np.concatenate(owner)[order], np.concatenate(at)[order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.key >> np.uint64(46)).astype(np.int64)] = True

    def candidates(self, w: Words) -> Iterable[tuple[int, int, int, int]]:
        """(row, template, lowest, highest diagonal) of groups of hits on diagonals that lie within a band."""
        h, at = grams(w.hash, w.row, GRAM)
        keep = np.flatnonzero(self.bits[(h >> np.uint64(46)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, h[keep], "left"), np.searchsorted(self.key, h[keep], "right")
        n = hi - lo
        i = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(at[keep], n)
        hits = np.unique(np.stack([w.row[place], self.owner[i], place - self.at[i]], 1), axis=0)
        if not len(hits):
            return
        new = np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1) | (hits[1:, 2] - hits[:-1, 2] > BAND)]
        first = np.flatnonzero(new)
        for f, t in zip(first, [*first[1:], len(hits)]):
            yield int(hits[f, 0]), int(hits[f, 1]), int(hits[f, 2]), int(hits[t - 1, 2])


def align(want: np.ndarray, have: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment of want to have on diagonals low to high (index in have less index in want): (matched, start, end in have)."""
    width = high - low + 1
    n = len(want)
    score = np.zeros((n + 1, width))
    slide = GAP * np.arange(width)
    same = np.zeros((n, width), bool)
    for i in range(n):  # column c of row i + 1: want[:i + 1] against have[:i + 1 + low + c]
        j = i + low + np.arange(width)
        inside = (j >= 0) & (j < len(have))
        same[i, inside] = have[j[inside]] == want[i]
        best = np.maximum(score[i] + np.where(same[i], MATCH, MISMATCH), 0)
        best[:-1] = np.maximum(best[:-1], score[i, 1:] + GAP)  # a token of want left out
        best = np.maximum.accumulate(best - slide) + slide  # tokens of have left out
        score[i + 1] = np.where(inside, best, 0)
    i, c = np.unravel_index(int(np.argmax(score)), score.shape)
    matched, end = 0, int(i + low + c)
    start = end
    while i > 0 and score[i, c] > 0:
        here = score[i, c]
        step = MATCH if same[i - 1, c] else MISMATCH
        if here == score[i - 1, c] + step or (step == MATCH and here == MATCH):
            matched += int(same[i - 1, c])
            start = int(i - 1 + low + c)
            i -= 1
        elif c + 1 < width and here == score[i - 1, c + 1] + GAP:
            i, c = i - 1, c + 1
        elif c > 0 and here == score[i, c - 1] + GAP:
            c -= 1
        else:
            break
    return matched, start, end


def places(want: np.ndarray, have: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched, start, end in have) of the alignments that reach COVERAGE, around the candidates' lowest and highest diagonals.

    The best alignment of each candidate comes first; what is left on both sides
    of an alignment is aligned again while it holds enough of want's tokens.
    """
    least, wanted, out, rest = COVERAGE * len(want), np.isin(have, want), [], []

    def find(b, e, low, high, alone):
        matched, s, t = align(want, have[b:e], low - b, high - b)
        if matched >= least and not (alone and any(b + s < y and x < b + t for _, x, y in out)):
            out.append((matched, b + s, b + t))
        if matched:
            rest.extend([(b, b + s, low, high), (b + t, e, low, high)])

    for low, high in bands:
        find(max(0, low - BAND), min(len(have), high + len(want) + BAND), low - BAND, high + BAND, False)
    while rest:
        b, e, low, high = rest.pop()
        low, high = max(low, b - len(want) + 1), min(high, e - 1)
        if low <= high and np.count_nonzero(wanted[b:e]) >= least:
            find(b, e, low, high, True)
    return out


def template_texts(table: DataFrame) -> dict[str, str]:
    """The templates of a table (license, text), of which every task will hold a copy; rows with nulls don't count, of repeated names one does."""
    known = table.where("license is not null and text is not null").select(F.col("license").cast("string"), "text")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; {TEMPLATE_BYTES} are allowed")
    return {r[0]: r[1] for r in known.orderBy("license", "text").collect()}


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """A row for each place of a document that holds at least COVERAGE of a template's tokens.

    Columns: doc_id, license, template_tokens, matched, coverage, start, end
    (code points, end exclusive).  Tokens are runs of letters and digits, A-Z
    lower-cased.  Null and empty texts hold none; repeated rows give repeated
    results; an empty table gives no rows; templates of fewer than GRAM words
    are not looked for.  Several places of one template in a document are
    several rows, and places of different templates may overlap; of alignments
    that score alike the one that starts first in the template counts.  Very
    long texts are searched whole.  Extra columns are ignored.  One pass, no
    shuffle.  templates: names to texts, or a table (license, text) of up to
    TEMPLATE_BYTES.
    """
    index = TemplateIndex(template_texts(templates) if isinstance(templates, DataFrame) else templates)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, data, offs in chunks(b.column(1)):
                w = Words(data, offs, NOT_ALNUM)
                out, cp = [], None
                for (row, template), found in itertools.groupby(index.candidates(w), key=lambda x: x[:2]):
                    want, first, last = index.tokens[template], int(w.first[row]), int(w.first[row + 1])
                    for matched, s, e in places(want, w.hash[first:last], [(low - first, high - first) for *_, low, high in found]):
                        cp = code_points(data) if cp is None else cp
                        zero = cp[offs[row]]
                        out.append((ids[at + row], index.names[template], len(want), matched, matched / len(want), int(cp[w.start[first + s]] - zero), int(cp[w.end[first + e - 1]] - zero)))
                if out:
                    yield dict(zip(("doc_id", "license", "template_tokens", "matched", "coverage", "start", "end"), map(list, zip(*out))))

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, license string, template_tokens bigint, matched bigint, coverage double, start bigint, end bigint")


def op1_licenses(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))
