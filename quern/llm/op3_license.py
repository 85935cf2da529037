"""License scans by patience alignment with templates."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_batches

#: Public license notices (fixed values): the texts that licences ask to be put into files, and common short forms.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software.""",
    "MIT-short": "Released under the MIT License.",
}
#: Share of a template's words that an alignment must cover.
COVERAGE = 0.8
#: What a word that an alignment passes over costs, where a matched word counts one.
GAP = 0.25
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (already rising in the first place) that rises in the second, by patience sorting."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(b), ends.append(i)
        else:
            tops[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: equal positions (i, j) of a and b, rising in both.

    Equal ends are matched; words that occur once in both parts are anchors, of which the longest rising chain
    stays; the gaps between anchors are aligned likewise. A gap without anchors is left.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            found.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            found.append((hi, high))
        if lo == hi or low == high:
            continue
        once: dict = {}
        for j in range(low, high):
            once[b[j]] = -1 if b[j] in once else j
        seen: dict = {}
        for i in range(lo, hi):
            if once.get(a[i], -1) >= 0:
                seen[a[i]] = -1 if a[i] in seen else i
        anchors = _rising(sorted((i, once[w]) for w, i in seen.items() if i >= 0))
        if not anchors:
            continue
        found += anchors
        p, q = lo, low
        for i, j in [*anchors, (hi, high)]:
            if p < i and q < j:
                todo.append((p, i, q, j))
            p, q = i + 1, j + 1
    return sorted(found)


def core(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretch of aligned pairs with the best score: one a pair, less GAP for each word passed over between two.

    Alignment pairs equal ends however far they lie off; a lone word beyond the notice isn't part of it.
    """
    best, at, score, first = 0.0, (0, 0), 0.0, 0
    for k, (i, j) in enumerate(pairs):
        if k:
            score -= GAP * (i - pairs[k - 1][0] - 1 + j - pairs[k - 1][1] - 1)
        if score <= 0:
            score, first = 0.0, k
        score += 1
        if score > best:
            best, at = score, (first, k + 1)
    return pairs[at[0] : at[1]]


def _most(spans: list[tuple]) -> list[tuple]:
    """Spans (.., start, end, matched) that don't overlap and match the most words in all, in the fewest; of equals the first ones."""
    spans = sorted(set(spans), key=lambda x: (x[4], x[3]))
    ends, best, back = [x[4] for x in spans], [(0, 0)], []
    for i, x in enumerate(spans):
        k = bisect_right(ends, x[3], 0, i)
        total = (best[k][0] + x[5], best[k][1] - (x[4] - x[3]))
        back.append(k if total > best[i] else -1)
        best.append(max(total, best[i]))
    out, i = [], len(spans)
    while i:
        if back[i - 1] >= 0:
            out.append(spans[i - 1])
        i = back[i - 1] if back[i - 1] >= 0 else i - 1
    return out


class Scanner:
    """All places of a text where a template is covered well enough; templates overlap only if they are equally good there."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage, self.templates = coverage, {name: tokens(t) for name, t in sorted(templates.items()) if tokens(t)}
        self.ids: dict[str, int] = {}
        for t in self.templates.values():
            for w in t:
                self.ids.setdefault(w, len(self.ids))
        self.member = {n: np.array([w in set(t) for w in self.ids] + [False]) for n, t in self.templates.items()}

    def __call__(self, text: str | None) -> list[tuple]:
        if not text:
            return []
        ws = tokens(text)
        ids = np.fromiter((self.ids.get(w, -1) for w in ws), np.int64, len(ws))
        hits = np.flatnonzero(ids >= 0)
        found = []
        for name, template in self.templates.items():
            m = len(template)
            need = int(np.ceil(self.coverage * m - 1e-9))
            own = hits[self.member[name][ids[hits]]]
            if len(own) < need:
                continue
            # A window starts at a word of the template and is longer than it, for insertions; a match of enough
            # words needs so many of the template's words there, and so many different ones.
            reach = 2 * m if m > 16 else m + m // 2 + 1
            # Where notices stand back to back a wide window holds two of each word, or pairs the start of one with the end of
            # the next: so every start is tried, with windows that end where the next notice may begin, and narrow ones.
            narrow = m + m // 4
            ends, differ, spans = np.searchsorted(own, own + reach), len(set(template)) - (m - need), []
            opens = own[ids[own] == self.ids[template[0]]]
            opens = opens[np.append(ids, -1)[opens + 1] == self.ids[template[min(1, m - 1)]]]
            for k in np.flatnonzero(ends - np.arange(len(own)) >= need).tolist():
                start = int(own[k])
                if len(set(ids[own[k : ends[k]]].tolist())) < differ:
                    continue
                after = np.searchsorted(opens, start + m // 2)
                cut = [int(opens[after]) - start] if after < len(opens) and opens[after] < start + reach else []
                for width in (*cut, reach, narrow, m):
                    part = core(align(ws[start : start + width], template))
                    if len(part) >= need:
                        spans.append((len(part) / m, m, name, start + part[0][0], start + part[-1][0] + 1, len(part)))
                        if part[-1][0] - part[0][0] < narrow:
                            break
            found += _most(spans)
        best, taken = [], []
        for share, m, name, a, b, n in sorted(found, key=lambda x: (-x[5], -x[0], x[3], x[2])):
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                best.append((name, a, b, n, m, share))
        return sorted(best, key=lambda x: (x[1], x[0]))


def _scan_rows(templates, coverage):
    def run(batches):
        scan = Scanner(templates, coverage)
        for batch in batches:
            rows = [(key, *x) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scan(text)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["id", "license", "start_word", "end_word", "matched_words", "template_words", "coverage"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, start_word, end_word, matched_words, template_words, coverage), a row for each license found.

    Words are runs of letters and digits, lower-cased. Spans count words of the whole text from 0, end
    excluded. Of one template's overlapping spans those stay that match most words in all, then the shortest. Of
    overlapping spans of several templates the one with most matched words stays, then the best covered, then the
    first, then by name. Null and empty texts give no rows; repeated rows and null ids are scanned as any
    other; an empty table gives no rows; extra columns are ignored. Scans are a task's own: nothing is shuffled.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_rows(dict(templates), coverage), "id long, license string, start_word long, end_word long, matched_words long, template_words long, coverage double").withColumnRenamed("id", id_col)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(read(spark, sf_dir, "documents", "doc_id", "text"))
