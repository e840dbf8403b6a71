"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The vectors live on the templates' words; their document frequencies are counted over all texts; words outside the templates weigh on a
unit's length like a word of middling frequency. Units of a text are its lines, its blocks (lines between blank ones), the whole text,
and in it windows of a template's own length, placed where a word of the text falls on the same anchor of the template. A unit whose
cosine to a template is ``threshold`` or more is a notice of that license. Only units with an anchor word are compared: a template's anchors are its
heaviest words, as many as it takes for the rest to fall short of the threshold, so no other unit can reach it.

Templates are headers (notices, grants, SPDX lines) and licence texts (whole ones, or how long ones open). A text with a notice of a
licence text, or of which notices make half or more, is a license file and stands for its directory; other notices are headers and stand
for their text alone. A text without notice inherits from the nearest directory above it, its own included, that has a license file: the
distinct directories are joined to their ancestors, the texts only to their own directory. Of several notices the best stands, on equal
cosine the first template's; of several license files in a directory the best, then the one with the lowest path.

Rows: one per input row. Null text: empty, no notice. Null path: no directory, nothing is inherited. Repeated rows stay repeated; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import map_batches, schema_of, stored

WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")

# Short notices and grants of common licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
)

_AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_TWO_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD_CLAUSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# Licence texts, long ones by how they open.
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"{_TWO_CLAUSES} {_AS_IS_BSD}"),
    ("BSD-3-Clause", f"{_TWO_CLAUSES} {_THIRD_CLAUSE} {_AS_IS_BSD}"),
    ("ISC", 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.'),
)


def spdx_lines(names: set[str]) -> tuple[tuple[str, str], ...]:
    forms = ((n, n + end) for n in sorted(names - {"proprietary"}) for end in (("", "-only", "-or-later") if "GPL" in n else ("",)))
    return tuple((n, f"SPDX-License-Identifier: {form}") for n, form in forms)


HEADERS = TEMPLATES + spdx_lines({n for n, _ in TEMPLATES + TEXTS})


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    name: str
    vector: dict[str, float]
    places: dict[str, tuple[int, ...]]  # of the anchors
    size: int
    text: bool  # of a licence, rather than a header


@dataclass(frozen=True)
class Scanner:
    idf: dict[str, float]
    other: float
    templates: tuple[Template, ...]
    anchors: frozenset
    threshold: float

    def unit(self, words: list[str]) -> dict[str, float]:
        """The unit's vector of length one, on the templates' words."""
        tf = Counter(w for w in words if w in self.idf)
        vector = {w: n * self.idf[w] for w, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()) + (len(words) - tf.total()) * self.other**2)
        return {w: v / norm for w, v in vector.items()} if norm else {}

    def windows(self, words: list[str], t: Template) -> set[int]:
        """Where a window of the template's size may start; of long templates' only every eighth of their size."""
        step = max(1, t.size // 8)
        last = max(0, len(words) - t.size)
        starts = {min(max(p - q, 0), last) for p, w in enumerate(words) for q in t.places.get(w, ())}
        return {x // step * step if x < last else last for x in starts}

    def notices(self, text: str) -> tuple[str | None, float, bool]:
        """Best license, its cosine, and whether the text is a license file."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return None, 0.0, False
        lines = [words_of(x) for x in low.split("\n")]
        words = [w for x in lines for w in x]
        if self.anchors.isdisjoint(words):
            return None, 0.0, False
        units, at, block = {(0, len(words))}, 0, 0
        for own in [*lines, []]:
            if own:
                units.add((at, at + len(own)))
            elif at > block:
                units.add((block, at))
            at += len(own)
            block = block if own else at
        best, marked, of_text = (0.0, 0, None), bytearray(len(words)), False

        def compare(a: int, b: int, numbers) -> None:
            nonlocal best, of_text
            own = words[a:b]
            if self.anchors.isdisjoint(own):
                return
            vector = self.unit(own)
            for k in numbers:
                t = self.templates[k]
                cosine = sum(v * t.vector.get(w, 0.0) for w, v in vector.items())
                if cosine >= self.threshold:
                    marked[a:b] = b"\x01" * (b - a)
                    of_text |= t.text
                    best = max(best, (cosine, -k, t.name), key=lambda x: x[:2])

        for a, b in sorted(units):
            compare(a, b, range(len(self.templates)))
        for k, t in enumerate(self.templates):
            for a in sorted(self.windows(words, t)):
                compare(a, a + t.size, (k,))
        return best[2], best[0], of_text or 2 * sum(marked) >= len(words) and best[2] is not None


def scanner(counts: dict[str, int], n: int, threshold: float = 0.8, headers: tuple[tuple[str, str], ...] = HEADERS, texts: tuple[tuple[str, str], ...] = TEXTS) -> Scanner:
    both = headers + texts
    vocabulary = sorted({w for _, t in both for w in words_of(t)})
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 0.1 for w in vocabulary}
    made, anchors = [], set()
    for i, (name, text) in enumerate(both):
        words = words_of(text)
        vector = {w: c * idf[w] for w, c in Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vector = {w: v / norm for w, v in vector.items()}
        rest, own = 1.0, []
        for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 - 1e-9:
                break
            own.append(w)
            rest -= v * v
        anchors.update(own)
        made.append(Template(name, vector, {w: tuple(q for q, x in enumerate(words) if x == w) for w in own}, len(words), i >= len(headers)))
    middling = sorted(idf.values())[len(idf) // 2]
    return Scanner(idf, middling, tuple(made), frozenset(anchors), threshold)


def document_frequencies(texts: DataFrame, templates: tuple[tuple[str, str], ...] = HEADERS + TEXTS) -> tuple[dict[str, int], int]:
    """In how many texts each template word occurs, and the number of texts; each task sends one row per template word."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))

    def run(batches: Iterator[list[list]]):
        counts: Counter = Counter()
        for (column,) in batches:
            for t in column:
                counts.update(vocabulary.intersection(words_of(t)))
            counts[""] += len(column)
        yield [list(counts), list(counts.values())]

    rows = map_batches(texts, run, schema_of("word string, n long")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan(df: DataFrame, id_col: str, path: F.Column, text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``id``, ``path``, ``license``, ``score``, ``found`` (header, file, inherited or null), ``directory`` (that it is inherited from)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), path.alias("path"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counts, n = document_frequencies(rows.select("text"))
    known = scanner(counts, n, threshold)

    def run(batches: Iterator[list[list]]):
        for ids, paths, texts in batches:
            found = [known.notices(t) for t in texts]
            yield [ids, paths, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    kind = df.schema[id_col].dataType.simpleString()
    own = stored(map_batches(rows, run, schema_of(f"id {kind}, path string, license string, score double, file boolean")), "notices")
    own = own.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    files = own.filter("file and license is not null and path is not null")
    top = files.groupBy("dir").agg(F.max("score").alias("score"))
    files = files.join(top, ["dir", "score"]).groupBy("dir").agg(F.min(F.struct("path", "license", "score")).alias("f")).select(F.col("dir").alias("directory"), F.col("f.license").alias("dir_license"), F.col("f.score").alias("dir_score"))
    parts = F.split("dir", "/")
    above = own.filter("path is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("directory"))
    nearest = above.distinct().join(files, "directory").groupBy("dir").agg(F.max_by(F.struct("directory", "dir_license", "dir_score"), F.length("directory")).alias("f")).select("dir", "f.*")
    out = own.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "id",
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(mine & F.col("file"), "file").when(mine, "header").when(F.col("dir_license").isNotNull(), "inherited").alias("found"),
        F.when(~mine, F.col("directory")).alias("directory"),
    )
