"""License scan: spans of normalised text against licence templates by the Dice coefficient of their word bigrams.

Spans of a text are its lines, its paragraphs (runs of non-blank lines, where of several lines) and the whole (where of several
paragraphs). A span is normalised (ASCII lower case, words only, copyright lines left out of paragraphs and wholes); spans whose number of
words is too small for every template are passed over before any bigram is looked at; then each template whose own size is out of bounds for the span's distinct bigrams
is pruned, since ``2 * min / (a + b)`` bounds the coefficient of sets of a and b bigrams.

Defined results: null, empty and wordless texts have no span; equal coefficients go to the template of least id; repeated spans count each; a
template of one word matches spans of that word alone; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, slices, texts

THRESHOLD = 0.8

#: Public licence notices, by identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(span: bytes) -> list[bytes]:
    return span.translate(_WORDS).split()


def bigrams(w: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct word bigrams; a single word stands for itself."""
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def spans(text: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """First line, number of lines, and words of each span."""
    lines = text.split(b"\n")
    parsed = [words(x) for x in lines]
    blocks: list[list[int]] = []
    for i, w in enumerate(parsed):
        if w:
            yield i, 1, w
        if not lines[i].strip():
            blocks.append([])
        elif blocks:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    blocks = [b for b in blocks if b]

    def joined(rows: Iterable[int]) -> list[bytes]:
        return [x for i in rows if parsed[i][:1] != [b"copyright"] for x in parsed[i]]

    for b in blocks:
        if len(b) > 1:
            yield b[0], len(b), joined(b)
    if len(blocks) > 1:
        yield 0, len(lines), joined(i for b in blocks for i in b)


class Scanner:
    """Templates in the order of their numbers of distinct bigrams, so that those a span can match at all are one run."""

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        pairs = [(name, bigrams(words(text.encode()))) for name, text in templates]
        self.templates = sorted(((name, grams) for name, grams in pairs if grams), key=lambda t: len(t[1]))
        self.sizes = [len(grams) for _, grams in self.templates]
        self.of: dict[tuple[bytes, ...], list[int]] = {}
        for k, (_, grams) in enumerate(self.templates):
            for g in grams:
                self.of.setdefault(g, []).append(k)

    def candidates(self, n: int) -> tuple[int, int]:
        """The run of templates whose size a set of ``n`` bigrams may match: twice the lesser of two sizes, by their sum, bounds the coefficient."""
        least, most = n * self.threshold / (2 - self.threshold), n * (2 - self.threshold) / self.threshold
        return bisect_left(self.sizes, least - 1e-9), bisect_right(self.sizes, most + 1e-9)

    def match(self, w: list[bytes]) -> tuple[str, float] | None:
        most = max(1, len(w) - 1)  # distinct bigrams are no more than this, and a span with fewer has only smaller candidates
        if not self.sizes or self.candidates(most)[1] == 0:
            return None
        grams = bigrams(w)
        low, high = self.candidates(len(grams))
        if low == high:
            return None
        common = Counter(k for g in grams if g in self.of for k in self.of[g] if low <= k < high)
        scored = [(-2 * c / (len(grams) + self.sizes[k]), self.templates[k][0]) for k, c in common.items()]
        best = min(scored, default=None)
        return (best[1], -best[0]) if best and -best[0] >= self.threshold else None

    def scan(self, text: bytes) -> list[tuple[int, int, str, float]]:
        """First line, number of lines, licence and coefficient of each matching span."""
        return [(first, n, *found) for first, n, w in spans(text) if (found := self.match(w))]


FOUND = pa.list_(pa.struct([("line", pa.int64()), ("lines", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, license, dice, n_matches, matches)`` of every row: its best match, and all matching spans."""
    id_type, templates = docs.schema[id_col].dataType.simpleString(), tuple(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in slices(batches, "t"):
            found = [[dict(zip(("line", "lines", "license", "dice"), m, strict=True)) for m in scanner.scan(t)] for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([column(batch, "i"), pa.array(found, FOUND)], ["i", "matches"])

    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {id_type}, matches array<struct<line:long,lines:long,license:string,dice:double>>")
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return out.select(F.col("i").alias(id_col), best["license"].alias("license"), F.coalesce(-best["d"], F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches"), "matches")


def oracle_sql(templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """Best match and number of matches over ``documents`` with unique ids, in DuckDB SQL."""

    def clean(x: str) -> str:
        return rf"regexp_extract_all(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"

    rows = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(templates))
    grams = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) ELSE list_distinct(w) END"
    return rf"""
WITH tpl(k, name, text) AS (VALUES {rows}),
tg AS (SELECT k, name, unnest({grams}) AS g FROM (SELECT k, name, {clean('text')} AS w FROM tpl)),
tn AS (SELECT k, name, count(*) AS n FROM tg GROUP BY k, name),
l AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, i, {clean('x')} AS w, regexp_matches(x, '[^\x09-\x0D ]') AS full_ FROM l),
b AS (SELECT *, count(*) FILTER (WHERE NOT full_) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM p),
para AS (SELECT doc_id, blk, count(*) AS n, flatten(list(CASE WHEN w[1] = 'copyright' THEN [] ELSE w END ORDER BY i)) AS w FROM b WHERE full_ GROUP BY doc_id, blk),
whole AS (SELECT doc_id, count(DISTINCT blk) AS n, flatten(list(CASE WHEN w[1] = 'copyright' THEN [] ELSE w END ORDER BY i)) AS w FROM b WHERE full_ GROUP BY doc_id),
spans AS (SELECT doc_id, w FROM p UNION ALL SELECT doc_id, w FROM para WHERE n > 1 UNION ALL SELECT doc_id, w FROM whole WHERE n > 1),
s AS (SELECT row_number() OVER () AS r, doc_id, {grams} AS g FROM spans WHERE len(w) > 0),
c AS (SELECT r, k, count(*) AS c FROM (SELECT r, unnest(g) AS g FROM s WHERE len(g) <= (SELECT max(n) FROM tn) * {(2 - threshold) / threshold}) JOIN tg USING (g) GROUP BY r, k),
m AS (SELECT r, doc_id, name, 2 * c / (len(g) + n) AS dice FROM c JOIN s USING (r) JOIN tn USING (k)),
best AS (SELECT r, doc_id, min(struct_pack(d := -dice, name := name)) AS x FROM m WHERE dice >= {threshold} GROUP BY r, doc_id),
d AS (SELECT doc_id, count(*) AS n, min(x) AS x FROM best GROUP BY doc_id)
SELECT doc_id, x.name AS license, coalesce(-x.d, 0.0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_matches FROM documents LEFT JOIN d USING (doc_id)
"""
