"""Licences of documents: cosine to templates, then the nearest directory above.

Passages around licence words are compared with templates, notices and whole licences, as
sparse TF-IDF vectors. Document frequencies of the templates' words come from the whole
corpus; other words (names, years, code) have the weight of a word that all documents have. A
document that is little but a licence is a licence file; it speaks for its directory and those
below, and a document without a licence of its own takes that of the nearest directory above.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm._store import materialise, sized
from treeloom.llm._words import words

#: Least cosine of a passage, and the share of a text's words that its passages hold if it is a licence file.
COSINE, FILE_SHARE = 0.6, 0.6
#: Lines from a licence word on that make up a header.
LINES = 12
#: Words of a passage from which windows of so many words around each licence word are compared as well, the passage itself
#: only up to WHOLE words.
WINDOWS, LONG, WHOLE = (12, 48, 192), 256, 1024

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_MIT = f"MIT License Copyright (c) {_GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: The usual notices of public licences, and the whole of the short ones.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        _GRANT,
        _MIT,
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": ("Released under the 3-clause BSD License.", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_END}", f"{_BSD_HEAD} {_BSD_THIRD}", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Released under the 2-clause BSD License.", f"{_BSD_HEAD} {_BSD_END}", _BSD_HEAD, "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_TRIGGER = re.compile(r"(?i)licen[cs]e|permission|redistribut|copyright|public domain|free software|spdx|\bcc0?[ -]?(?:by|1)|creative commons")
_WORD = re.compile(r"[0-9a-z]+")
_SENTENCE = re.compile(r"(?<=[^0-9v][.!?])\s+(?=[A-Z])")


def terms(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


VOCABULARY = sorted({w for x in TEMPLATES.values() for t in x for w in terms(t)})


class Matcher:
    """Cosines to the templates, with the document frequencies of the templates' words."""

    def __init__(self, df: dict[str, int], n: int):
        self.at = {w: i for i, w in enumerate(VOCABULARY)}
        self.idf = np.array([np.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY])
        # by name: of templates that are equally near the last one counts
        pairs = sorted((name, text) for name, variants in TEMPLATES.items() for text in variants)
        self.names = [name for name, _ in pairs]
        self.templates = np.stack([self._vector(terms(text))[0] for _, text in pairs])
        self.templates /= np.sqrt((self.templates**2).sum(axis=1, keepdims=True))

    def _vector(self, counts: Counter) -> tuple[np.ndarray, float]:
        """Weights of the templates' words, and the squares of those of all others."""
        out, other = np.zeros(len(self.idf)), 0.0
        for w, c in counts.items():
            i = self.at.get(w, -1)
            if i < 0:
                other += (1 + np.log(c)) ** 2
            else:
                out[i] = (1 + np.log(c)) * self.idf[i]
        return out, other

    def best(self, passage: str) -> tuple[float, str]:
        vector, other = self._vector(terms(passage))
        length = float(np.sqrt(vector @ vector + other)) or 1.0
        cosine = np.round(self.templates @ vector / length, 12)
        i = len(cosine) - 1 - int(np.argmax(cosine[::-1]))
        return float(cosine[i]), self.names[i]

    def licence(self, text: str | None) -> tuple[str | None, float, bool]:
        """Licence, cosine, and whether the text is a licence file. Ties go to the name that sorts last."""
        if not text or not _TRIGGER.search(text):
            return None, 0.0, False
        n_words = sum(1 for _ in _WORD.finditer(text.lower()))
        found: list[tuple[float, str]] = []
        seen: dict[str, tuple[float, str]] = {}
        held: list[tuple[int, int]] = []
        for a, b in passages(text, n_words):
            passage = text[a:b]
            if passage not in seen:
                seen[passage] = self.best(passage)
            if seen[passage][0] >= COSINE:
                found.append(seen[passage])
                held.append((a, b))
        if not found:
            return None, 0.0, False
        score, name = max(found)
        count, upto = 0, 0
        for a, b in sorted(held):
            count += sum(1 for _ in _WORD.finditer(text[max(a, upto) : b].lower())) if b > upto else 0
            upto = max(upto, b)
        return name, min(1.0, round(score, 9)), count >= FILE_SHARE * n_words


def passages(text: str, n_words: int) -> Iterator[tuple[int, int]]:
    """Places of what is compared: a short text as a whole, sentences with licence words, LINES lines from one on, and
    windows to both sides of each licence word of those that are long."""
    if n_words <= WHOLE:
        yield 0, len(text)
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+|(?<=\n)(?=\n)", text)]
    upto = 0
    for k, (a, b) in enumerate(lines):
        if not _TRIGGER.search(text, a, b):
            continue
        at = a
        for end in [m.span() for m in _SENTENCE.finditer(text, a, b)] + [(b, b)]:
            if _TRIGGER.search(text, at, end[0]):
                yield from _windows(text, at, end[0])
            at = end[1]
        if k >= upto:
            upto = min(len(lines), k + LINES)
            yield from _windows(text, a, lines[upto - 1][1])


def _windows(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    words_ = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b].lower())]
    if len(words_) <= WHOLE:
        yield a, b
    if len(words_) <= LONG:
        return
    starts = [s for s, _ in words_]
    for size in WINDOWS:
        done = -1
        for m in _TRIGGER.finditer(text, a, b):
            at = max(0, bisect_left(starts, m.start() + 1) - 1)
            if at < done:
                continue
            done = at + max(1, size // 4)
            for first in (at - size + 1, at - size // 2, at - size // 8, at):
                first = max(0, first)
                yield words_[first][0], words_[min(len(words_), first + size) - 1][1]


def frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each word of the templates, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = next(iter(words(pa.array([" ".join(VOCABULARY)]))))
        order = np.argsort(own.hash)
        known = own.hash[order]
        df, n = np.zeros(len(VOCABULARY), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for b in words(batch.column(0)):
                at = np.minimum(np.searchsorted(known, b.hash), len(known) - 1)
                hit = known[at] == b.hash
                both = np.unique(b.row[hit] * len(known) + order[at[hit]])
                df += np.bincount(both % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array([*VOCABULARY, ""]), pa.array([*df.tolist(), n])], names=["word", "df"])

    got = {r["word"]: r["df"] for r in docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    return {w: n for w, n in got.items() if w}, got.get("", 0)


def scan(docs: DataFrame, text: str = "text", path: str = "path", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with licence, score, how (header, file, inherited or none).

    Null and empty texts have none of their own and may inherit; of a long passage windows to both sides of every licence
    word are compared, wherever it stands. A licence file is a text of which matching passages hold FILE_SHARE of the words,
    or one named licence or copying that has a licence. Of licence files in one directory the one with the larger cosine
    counts, ties to the name last in order. A null path has no directory and inherits nothing. Repeated
    rows get the same result each; input columns named as those added are replaced; an empty table gives none.
    """
    added = ("licence", "score", "how")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    df, n = frequencies(docs, text)
    named = F.coalesce(F.col(path).rlike(r"(?i)(^|/)(un)?(licen[cs]e|copying)([.-][^/]*)?$"), F.lit(False))
    rows = docs.select(*keep, F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1).alias("__dir"), F.col(text).alias("__text"), named.alias("__named"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(df, n)
        for batch in batches:
            found = [matcher.licence(t) for t in batch.column("__text").to_pylist()]
            kept = batch.drop_columns(["__text", "__named"])
            whole = [x[2] or x[0] is not None and n for x, n in zip(found, batch.column("__named").to_pylist(), strict=True)]
            arrays = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*kept.schema.names, "licence", "score", "__file"])

    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("__text", "__named")]).add("licence", "string").add("score", "double").add("__file", "boolean")
    own, _ = materialise(rows.mapInArrow(find, schema))  # read twice below
    files = own.where("__file").groupBy(F.col("__dir").alias("above")).agg(F.max(F.struct("score", "licence")).alias("best"))
    dirs = rows.select("__dir").where("__dir is not null").distinct()
    parts = F.split("__dir", "/")
    above = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("a")).select("__dir", "a.*")
    near = above.join(files, "above").groupBy("__dir").agg(F.max_by("best", "depth").alias("__near"))
    near = sized(materialise(near)[0], F.length("__dir") + 64)  # a directory may hold a third of all rows
    out = own.join(near, "__dir", "left")
    inherits = F.col("licence").isNull() & F.col("__near").isNotNull()
    return out.select(
        *keep,
        F.when(inherits, F.col("__near.licence")).otherwise(F.col("licence")).alias("licence"),
        F.when(inherits, F.col("__near.score")).otherwise(F.col("score")).alias("score"),
        F.when(F.col("__file"), "file").when(F.col("licence").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("how"),
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return scan(docs, keep=["doc_id"])
