"""Licence scans: TF-IDF cosine to templates, then inheritance from directories.

The passages of a file that can hold a licence are its lines and sentences with a
licence term, and windows of words: wherever a text has one of a template's
``ANCHORS``, a window of the template's length is laid so that the two anchors
meet.  A licence is thus found in any line, however long, and over any number of lines.  Each passage is a sparse TF-IDF
vector of words and word pairs; its licence is that of the template of greatest
cosine, if that reaches ``THRESHOLD``.  Document frequencies count in how many
files each term of a template occurs, over all files; a term that is in no template has
the weight of one that no file has.

A file that is a licence file (by its name, or since the passage is most of
its text) rules its directory.  A file without a licence of its own takes that of its
nearest ancestor directory that has one: the distinct directories, not
the files, are expanded to their ancestors and joined with the ruled ones.

Defined results: null and empty texts have no licence of their own; a text of any length is scanned whole; a file with
a null path inherits nothing; ties go to the licence that sorts first, in a
directory to the file of greatest cosine and then smallest path; repeated rows have equal results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

THRESHOLD = 0.55
#: Notices by SPDX identifier, short and long forms.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
MAY_HAVE = re.compile(r"licen[sc]|copyright|spdx|redistribut|permission is hereby|public domain|free software|unencumbered|\bcc0?\b", re.I)
#: Words of a template by which it is laid over a text; each template has one.
ANCHORS = re.compile(r"licen[sc]|copyright|spdx|redistribut|unencumbered|cc0")
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms(words: list[str]) -> Counter[str]:
    """How often each word and each pair of words that touch occurs."""
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


class Scanner:
    """Templates as sparse unit vectors, with an inverted list of each term."""

    def __init__(self, df: dict[str, int], n: int, templates: dict[str, list[str]] | None = None):
        self.df, self.n = df, n
        self.names: list[str] = []
        self.lists: dict[str, list[tuple[int, float]]] = {}
        #: Of each anchor: where it stands in a template, and the template's length.
        self.anchors: dict[str, set[tuple[int, int]]] = {}
        for name, texts in sorted((templates or TEMPLATES).items()):
            for text in texts:
                words = words_of(text)
                weights = self.weights(terms(words))
                norm = math.sqrt(sum(x * x for x in weights.values()))
                for i, w in enumerate(words):
                    if ANCHORS.search(w):
                        self.anchors.setdefault(w, set()).add((i, len(words)))
                for t, x in weights.items():
                    self.lists.setdefault(t, []).append((len(self.names), x / norm))
                self.names.append(name)

    def weights(self, counts: Counter[str]) -> dict[str, float]:
        rare = math.log1p(self.n) + 1
        return {t: (1 + math.log(c)) * (math.log((1 + self.n) / (1 + d)) + 1 if (d := self.df.get(t)) is not None else rare) for t, c in counts.items()}

    def best(self, words: list[str]) -> tuple[str | None, float]:
        weights = self.weights(terms(words))
        norm = math.sqrt(sum(x * x for x in weights.values()))
        sums: dict[int, float] = {}
        for t, x in weights.items():
            for i, y in self.lists.get(t, ()):
                sums[i] = sums.get(i, 0.0) + x * y
        if not sums:
            return None, 0.0
        i = min(sums, key=lambda k: (-round(sums[k], 9), self.names[k]))
        return self.names[i], min(1.0, sums[i] / norm)

    def __call__(self, text: str | None) -> tuple[str | None, float, float]:
        """(licence, cosine, share of the text's words in its passage)."""
        found: tuple[str | None, float, float] = (None, 0.0, 0.0)
        if not text or not MAY_HAVE.search(text):
            return found
        words = words_of(text)
        for passage in self.passages(text, words):
            name, cosine = self.best(passage)
            if name and cosine >= THRESHOLD and cosine > found[1] + 1e-9:
                found = (name, cosine, len(passage) / len(words))
        return found

    def passages(self, text: str, words: list[str]) -> Iterator[list[str]]:
        """Words of lines and sentences with a licence term, and windows of templates' lengths that meet at anchors."""
        for line in text.split("\n"):
            if MAY_HAVE.search(line):
                for sentence in re.split(r"(?<=[.!?;])\s+(?=[A-Z])", line):
                    if MAY_HAVE.search(sentence):
                        yield words_of(sentence)
        windows = {(max(0, at - i), max(0, at - i + size)) for at, w in enumerate(words) if w in self.anchors for i, size in self.anchors[w]}
        for low, high in sorted(windows):
            yield words[low:high]


def frequencies(files: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many files each template term occurs, over all files, and the number of files."""
    vocabulary = {t for texts in TEMPLATES.values() for x in texts for t in terms(words_of(x))}
    words = sorted({w for t in vocabulary for w in t.split()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        known = set(words)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                # Terms of the vocabulary: words, and pairs of them that touch.
                own = [w if w in known else None for w in words_of(text or "")]
                found = {w for w in own if w in vocabulary}
                found |= {p for a, b in zip(own, own[1:]) if a and b and (p := f"{a} {b}") in vocabulary}
                counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    rows = files.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most the templates' terms
    return {t: 0 for t in vocabulary} | {r["term"]: r["n"] for r in rows}, files.count()


def detect(files: DataFrame, scanner: Scanner, keep: tuple[str, ...] = ("path",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, license, cosine and share of each file by its own text."""
    frame = files.select(*keep, F.col(text_col).alias("__text"))
    schema = files.select(*keep).schema.add("license", "string").add("cosine", "double").add("share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                name, cosine, share = zip(*map(scanner, batch.columns[-1].to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())], schema.names)

    return frame.mapInArrow(run, schema)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, path, license, cosine, inherited_license, inherited_from and final_license."""
    frame = files.select(*keep, F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    found = stored(detect(frame, Scanner(*frequencies(frame)), (*keep, "path")), "licenses").withColumn("dir", directory(F.col("path")))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    ruling = found.filter(F.col("license").isNotNull() & (name.rlike(LICENSE_NAME) | (F.col("share") >= 0.5)) & F.col("dir").isNotNull())
    # One row for each ruled directory, by partial maxima.
    rules = ruling.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("best")).select("dir", F.col("best.license").alias("license"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = found.select("dir").filter("dir is not null").distinct().select("dir", F.posexplode(ups).alias("up", "ancestor"))
    nearest = (
        above.join(rules.withColumnRenamed("dir", "ancestor"), "ancestor")
        .groupBy("dir").agg(F.min(F.struct("up", "ancestor", "license")).alias("n"))
        .select("dir", F.col("n.license").alias("inherited_license"), F.col("n.ancestor").alias("inherited_from"))
    )
    out = found.join(nearest, "dir", "left")
    return out.select(*keep, "path", "license", "cosine", "inherited_license", "inherited_from", F.coalesce("license", "inherited_license").alias("final_license"))
