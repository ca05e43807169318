"""Licence scans: normalised text against templates by Dice coefficient over word bigrams.

A document's units are its lines, its blocks (runs of lines between blank ones), its whole text, and every run of words
that begins and ends with a bigram of a template, so that a notice is found amid other words and over line ends. Text is
normalised to lower case with everything but letters and digits as spaces. Two bigram sets of sizes a and b have a Dice
coefficient of at most 2 min(a, b) / (a + b), so only templates whose size is within [T / (2 - T), (2 - T) / T] times
the unit's can reach the threshold T; the rest are never compared. Runs of words are bounded by the same sizes, and looked
for only where the text shares T / (2 - T) of a template's bigrams. Templates are a fixed list and go to every task.

Defined results: null and empty texts, and texts without a match, have no licence and score 0; ties go to the template
first by name; a null doc_id stays null; repeated rows are scanned one by one; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    words = _OTHER.sub(b" ", text.lower()).split()
    return set(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: dict[str, str] | None = None, threshold: float = THRESHOLD):
        sets = sorted((len(b), name, b) for name, text in (templates or TEMPLATES).items() if (b := bigrams(text.encode())))
        self.threshold = threshold
        self.sizes, self.names, self.sets = ([x[i] for x in sets] for i in range(3))
        self.known = set().union(*self.sets)

    def best(self, unit: bytes, windows: bool = False) -> tuple[float, str] | None:
        """Highest coefficient at or over the threshold and its template; of the unit, or of any run of its words too."""
        words = _OTHER.sub(b" ", unit.lower()).split()
        ratio = (2 - self.threshold) / self.threshold
        pairs = list(zip(words, words[1:]))
        hit = self.known.intersection(pairs)
        # What is shared can't be less than half the threshold's share of the smallest fitting template.
        if not hit or 2 * len(hit) < self.threshold * self.sizes[0]:
            return None
        n = len(set(pairs))
        found = []
        for i in range(bisect_left(self.sizes, n / ratio - 1e-9), bisect_right(self.sizes, n * ratio + 1e-9)):
            score = 2 * len(hit & self.sets[i]) / (n + self.sizes[i])
            if score >= self.threshold:
                found.append((-score, self.names[i]))
        if windows:
            found += [(-self._window(pairs, i), self.names[i]) for i, own in enumerate(self.sets) if len(hit & own) * ratio >= self.sizes[i] - 1e-9]
            found = [x for x in found if -x[0] >= self.threshold]
        return (-min(found)[0], min(found)[1]) if found else None

    def _window(self, pairs: list[tuple[bytes, bytes]], i: int) -> float:
        """Highest coefficient of a run of the pairs with template i.

        Leaving out an end that the template lacks, or a first pair that comes again, never lowers it; so runs start at
        each of the template's pairs and end before that pair's next place, or when they hold too many pairs to match.
        """
        own, size = self.sets[i], self.sizes[i]
        most, top = size * (2 - self.threshold) / self.threshold + 1e-9, 0.0
        for start in (at for at, x in enumerate(pairs) if x in own):
            seen, shared = set(), 0
            for at in range(start, len(pairs)):
                x = pairs[at]
                if at > start and x == pairs[start]:
                    break
                if x in seen:
                    continue
                seen.add(x)
                if len(seen) > most:
                    break
                if x in own:
                    shared += 1
                    top = max(top, 2 * shared / (len(seen) + size))
        return top

    def scan(self, text: bytes) -> tuple[str | None, float, int]:
        """Best licence of any unit or run of words, its score, and the number of matching lines."""
        lines = [m for x in text.split(b"\n") if (m := self.best(x))]
        # Lines and blocks are runs of the text's words.
        found = [m] if (m := self.best(text, windows=True)) else []
        if not found:
            return None, 0.0, 0
        score, name = min((-s, n) for s, n in found)
        return name, -score, len(lines)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, score and n_lines (lines that match some template) of every document. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            found = [matcher.scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64())))], names=["doc_id", "license", "score", "n_lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, license string, score double, n_lines long")


def oracle_sql() -> str:
    """The scan of lines, blocks and whole texts as SQL; it has no other runs of words."""
    norm = lambda x: rf"list_filter(string_split(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    values = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items())
    return rf"""
WITH t AS (SELECT name, {pairs} AS b FROM (SELECT name, {norm("x")} AS w FROM (VALUES {values}) v(name, x))),
tb AS (SELECT name, len(b) AS m, unnest(b) AS g FROM t),
u AS (
  SELECT doc_id, 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents
  UNION ALL SELECT doc_id, 0, unnest(string_split_regex(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n')) FROM documents
  UNION ALL SELECT doc_id, 0, text FROM documents
),
n AS (SELECT row_number() OVER () AS u, doc_id, line, {pairs} AS b FROM (SELECT doc_id, line, {norm("x")} AS w FROM u WHERE x IS NOT NULL)),
s AS (
  SELECT a.u, any_value(a.doc_id) AS doc_id, any_value(a.line) AS line, name, 2.0::DOUBLE * count(*) / (any_value(n) + any_value(m)) AS dice
  FROM (SELECT u, doc_id, line, len(b) AS n, unnest(b) AS g FROM n) a JOIN tb ON a.g = tb.g GROUP BY a.u, name
),
f AS (SELECT * FROM s WHERE dice >= {THRESHOLD}),
best AS (SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS score, count(DISTINCT CASE WHEN line = 1 THEN u END) AS n_lines FROM f GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_lines, 0)::BIGINT AS n_lines FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id
"""
