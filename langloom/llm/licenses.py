"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Every line of a whole text that has a licence word is a notice (of a long line, the words around it). Terms are
words and pairs of words; a term's weight is its count times its idf over the templates. The best template at
``LEAST`` cosine or more names the licence; so does a passage of a template's length inside the line at ``BLOCK_LEAST``,
and an SPDX line by its first identifier. "All rights reserved" counts where no notice names another licence.

Licence files are compared whole to the whole texts in ``license_texts`` and to ``TEXTS`` (counts there by their
logarithm): a file that is one by its name from ``FILE_LEAST`` on, any other text that has a licence's words from ``WHOLE_LEAST``
on. A licence text of many lines inside a longer one is compared to ``TEXTS`` (short licences, the openings of long ones)
across its lines, from ``BLOCK_LEAST`` on. The better of the two wins, and both win over single lines.

A file without one takes that of the nearest ancestor directory with a licence file. Directories are made
distinct before their ancestors are listed, and both joins are on whole paths; an ancestor of very many directories is
joined in several parts.

Null and empty texts have no notice; a file with a null path has no directory and inherits nothing. Ties between
templates go to the first, between a directory's licence files to the first path. Repeated rows get equal results.
Kept columns may have any names (see ``common``). A very long text is compared whole as counts of its terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.llm.common import Workspace, beside, map_texts, numbered, quoted, table

LEAST, BLOCK_LEAST, AROUND, REACH = 0.5, 0.75, 15, 400
FILE_LEAST, WHOLE_LEAST = 0.6, 0.85
FOLDERS_A_COPY, BROADCAST_ROWS = 10_000, 100_000
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. distributed on an AS IS basis, without warranties or conditions of any kind"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "dedicated to the public domain under the CC0 1.0 Universal license"),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Confidential and proprietary."),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
)
BLOCK = re.compile(r"redistributions?\s+(?:and|of|in)|permission\s+(?:is\s+(?:hereby\s+)?granted|is\s+hereby|to\s+use)|apache\s+license|general\s+public\s+license|mozilla\s+public|boost\s+software|documentation\s+license|artistic\s+license|cc0|unencumbered", re.I)
TRIGGER = re.compile(r"licen[sc]e|copyright|rights\s+reserved|spdx|permission\s+is\s+hereby|redistribut|public\s+domain", re.I)
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SPDX = re.compile(r"spdx-license-identifier:[\s(]*([a-z0-9][a-z0-9.+-]*)", re.I)
FILE_NAME = re.compile(r"(?:^|/)(?:licen[sc]e|copying|copyright|notice|unlicense)[^/]*$", re.I)


def terms(text: str) -> Counter:
    words = TOKEN.findall(text.lower())
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


class Matcher:
    """Templates as sparse unit vectors, by term."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        counts = [terms(t) for _, t in templates]
        found = Counter(k for c in counts for k in c)
        self.idf = {k: 1 + math.log((1 + len(counts)) / (1 + n)) for k, n in found.items()}
        self.unknown = 1 + math.log(1 + len(counts))
        self.names = [n for n, _ in templates]
        self.lengths = [len(TOKEN.findall(t.lower())) for _, t in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[k]) ** 2 for k, n in c.items()))
            for k, n in c.items():
                self.postings.setdefault(k, []).append((i, n * self.idf[k] / norm))

    def inside(self, words: list[str]) -> tuple[str | None, float]:
        """The best template and its cosine to a passage of the template's own length within ``words``."""
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        gains: dict[int, list[float]] = {}
        for at, k in [*enumerate(words), *enumerate(pairs)]:
            for i, w in self.postings.get(k, ()):
                gains.setdefault(i, [0.0] * len(words))[at] += self.idf[k] * w
        best: tuple[str | None, float] = (None, 0.0)
        for i in sorted(gains):
            n = min(self.lengths[i], len(words))
            sums = [0.0, *accumulate(gains[i])]
            a = max(range(len(words) - n + 1), key=lambda j: sums[j + n] - sums[j])  # a pair that leaves the passage counts here, not below
            c = Counter(words[a : a + n]) + Counter(pairs[a : a + n - 1])
            norm = math.sqrt(sum((m * self.idf.get(k, self.unknown)) ** 2 for k, m in c.items()))
            cos = min(1.0, sum(m * self.idf[k] * w for k, m in c.items() for t, w in self.postings.get(k, ()) if t == i) / norm)
            if cos > best[1]:
                best = (self.names[i], cos)
        return best

    @lru_cache(maxsize=100_000)
    def passage(self, text: str) -> tuple[str | None, float]:
        return self.inside(TOKEN.findall(text.lower()))

    @lru_cache(maxsize=100_000)  # notices repeat word for word
    def best(self, text: str) -> tuple[str | None, float]:
        c, score = terms(text), [0.0] * len(self.names)
        norm = math.sqrt(sum((n * self.idf.get(k, self.unknown)) ** 2 for k, n in c.items()))
        for k, n in c.items():
            for i, w in self.postings.get(k, ()):
                score[i] += n * self.idf[k] * w
        if not norm:
            return None, 0.0
        i = max(range(len(score)), key=lambda j: (score[j], -j))
        cos = min(1.0, score[i] / norm)
        return (self.names[i] if cos >= LEAST else None), cos


class Whole:
    """Whole texts as sparse unit vectors, by term; counts by their logarithm, as a long text has every common word."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        counts = [terms(t) for _, t in texts]
        found = Counter(k for c in counts for k in c)
        self.idf = {k: 1 + math.log((1 + len(counts)) / (1 + n)) for k, n in found.items()}
        self.unknown = 1 + math.log(1 + len(counts))
        self.names = [n for n, _ in texts]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum(self.weight(k, n) ** 2 for k, n in c.items()))
            for k, n in c.items():
                self.postings.setdefault(k, []).append((i, self.weight(k, n) / norm))

    def weight(self, term: str, n: int) -> float:
        return (1 + math.log(n)) * self.idf.get(term, self.unknown)

    def best(self, text: str) -> tuple[str | None, float]:
        c, score, squares = terms(text), [0.0] * len(self.names), 0.0
        for k, n in c.items():
            w = self.weight(k, n)
            squares += w * w
            for i, v in self.postings.get(k, ()):
                score[i] += w * v
        if not squares:
            return None, 0.0
        i = max(range(len(score)), key=lambda j: (score[j], -j))
        return self.names[i], min(1.0, score[i] / math.sqrt(squares))


def license_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the whole licences that come with the package; read on the driver."""
    return tuple((p.stem, p.read_text(encoding="utf-8", errors="replace")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def notices(text: str) -> list[tuple[int, int]]:
    """[start, end) of each passage that may be a notice."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        words = [w.span() for w in re.finditer(r"\S+", text[a:b])] if b - a < 100_000 else [w.span() for w in re.finditer(r"\S+", text[max(a, m.start() - 2000) : min(b, m.end() + 2000)])]
        base = a if b - a < 100_000 else max(a, m.start() - 2000)
        if len(words) > 2 * AROUND + 10 or b - a >= 100_000:
            k = max(i for i, w in enumerate(words) if base + w[0] <= m.start())
            cut = words[max(0, k - AROUND) : k + AROUND + 1]
            a, b = base + cut[0][0], base + cut[-1][1]
        out.append((a, b))
    return out


def judge(text: str, a: int, b: int, matcher: Matcher) -> tuple[str | None, float]:
    """The licence of the notice at [a, b): by an SPDX identifier, the whole notice, or a passage in or around it on its line."""
    named = SPDX.search(text, a, b)
    if named:
        name = re.sub(r"(?i)-only$|-or-later$|\+$", "", named[1].rstrip(".-"))
        return next((n for n, _ in (*TEMPLATES, *TEXTS) if n.lower() == name.lower()), name), 1.0
    whole = matcher.best(text[a:b])
    if whole[1] > 0.999:
        return whole
    left, right = text.rfind("\n", max(0, a - REACH), a) + 1 or max(0, a - REACH), text.find("\n", b, b + REACH)
    part = matcher.passage(text[left : right if right >= 0 else b + REACH])
    return part if part[1] >= BLOCK_LEAST and part[1] > whole[1] else whole


def block(text: str, matcher: Matcher) -> tuple[str | None, float]:
    """The licence text that ``text`` holds, over any number of lines; (None, cosine) below ``BLOCK_LEAST``."""
    best, done = (None, 0.0), -1
    for m in BLOCK.finditer(text):
        if m.start() < done:
            continue
        done = m.start() + 4000  # each stretch reaches a longest licence beyond the triggers that it stands for
        found = matcher.inside(TOKEN.findall(text[max(0, m.start() - 4000) : done + 4000].lower()))
        best = max(best, found, key=lambda x: x[1])
    return best if best[1] >= BLOCK_LEAST else (None, best[1])


@lru_cache(maxsize=4)
def _matcher(templates: tuple[tuple[str, str], ...]) -> Matcher:
    return Matcher(templates)


@lru_cache(maxsize=1)
def _whole(texts: tuple[tuple[str, str], ...]) -> Whole:
    return Whole(texts)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType())])


def named_license(path):
    """Whether a file is a licence file by its name."""
    return F.coalesce(path.rlike(FILE_NAME.pattern.replace("(?:^|/)", "(?i)(?:^|/)")), F.lit(False))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text", keep: list[str] | None = None, path_col: str | None = None) -> DataFrame:
    """``keep`` columns plus own_license, own_score and notices (code points); own is the licence text it holds, else the best of the notices.

    ``path_col``: where the names of files are, if there is one ("path" is, if the table has it).
    """
    fields = [T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType(), False), T.StructField("notices", T.ArrayType(SPAN), False)]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("score", pa.float64())]))
    path_col = path_col or ("path" if "path" in files.columns else None)
    also = F.lit(False) if path_col is None else named_license(F.col(quoted(path_col)))
    sent = files.sparkSession.sparkContext.broadcast((*TEXTS, *license_texts()))  # those of the package

    def start():
        matcher, parts, whole = _matcher(templates), _matcher(TEXTS), _whole(sent.value)

        def judged(text: str, is_file: bool) -> tuple[str | None, float, list]:
            found = [{"start": a, "end": b, "license": n, "score": s} for a, b in notices(text) for n, s in [judge(text, a, b, matcher)]]
            held = BLOCK.search(text)
            name, score = whole.best(text) if is_file or held else (None, 0.0)
            inside, least = block(text, parts) if held else (None, 0.0), FILE_LEAST if is_file else WHOLE_LEAST
            if score >= least and not (inside[0] and inside[1] > score):
                return name, score, found
            if inside[0]:
                return *inside, found
            best = max((x for x in found if x["license"]), key=lambda x: (x["license"] != "Proprietary", x["score"], -x["start"]), default=None)
            return best and best["license"], best["score"] if best else 0.0, found

        def work(texts: pa.Array, is_file: pa.Array) -> list[pa.Array]:
            rows = [judged(t or "", f) for t, f in zip(texts.to_pylist(), is_file.to_pylist(), strict=True)]
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), span))]

        return work

    return map_texts(files, text_col, [c for c in files.columns if c != text_col] if keep is None else keep, fields, start, also)


def parent(path):
    """The directory of a path; '' is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(scanned: DataFrame, path_col: str = "path", is_file=None) -> DataFrame:
    """Adds license, inherited_from (the licence file's path) and depth (directories up; null if own or none).

    ``is_file``: which rows are licence files of their directory; by name if none is given.
    """
    work = Workspace(scanned.sparkSession, "licenses")
    file = named_license(F.col(quoted(path_col))) if is_file is None else F.coalesce(is_file, F.lit(False))
    frame, own = numbered(scanned.withColumn("__file", file), {"path": path_col, "own_license": "own_license", "file": "__file"})
    marked = work.keep(frame.withColumn("dir", parent(F.col("path"))), "scanned")
    sources = marked.where("file AND own_license IS NOT NULL AND path IS NOT NULL").groupBy(F.col("dir").alias("up")).agg(F.min_by("own_license", "path").alias("license"), F.min("path").alias("from"))
    made = ["license", "inherited_from", "depth"]
    return climb(work, marked, sources).select(*[c.alias(n) for c, n in zip(own[:-1], beside(scanned.columns, made), strict=True)], *made)


def climb(work: Workspace, marked: DataFrame, sources: DataFrame) -> DataFrame:
    """``marked`` (dir, own_license and more) with license, inherited_from and depth by each directory's nearest ancestor in ``sources`` (up, license, from)."""
    sources = work.keep(sources, "sources")
    folders = marked.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("up"), F.lit(0).alias("depth")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("up"), k.alias("depth")))
    )
    lines = work.keep(folders.select("dir", F.inline(ups).alias("up", "depth")), "lines")
    # the root is above every directory: the source of an ancestor of many is copied, one copy for FOLDERS_A_COPY of them
    hot = work.keep(lines.groupBy("up").count().where(F.col("count") > FOLDERS_A_COPY).select("up", F.ceil(F.col("count") / FOLDERS_A_COPY).cast("int").alias("copies")), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    copies = F.coalesce("copies", F.lit(1))
    asked = lines.join(hot, "up", "left").select("dir", "up", "depth", F.pmod(F.xxhash64("dir"), copies).cast("int").alias("copy"))
    given = sources.join(hot, "up", "left").select("up", "license", "from", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    near = asked.join(given, ["up", "copy"]).groupBy("dir").agg(F.min(F.struct("depth", "license", "from")).alias("near"))
    near = work.keep(near.withColumnRenamed("dir", "near_dir"), "near")
    own = F.col("own_license").isNotNull()
    joined = marked.join(near, F.col("dir") == F.col("near_dir"), "left").drop("near_dir")
    made = {"license": F.coalesce("own_license", F.col("near")["license"]), "inherited_from": F.when(~own, F.col("near")["from"]), "depth": F.when(~own, F.col("near")["depth"])}
    return joined.withColumns(made).drop("near")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of ``documents``, laid out as source/lang/<thousand of doc_id>/doc_id.

    The table has no licence files: the first document with a notice stands in for that of its directory, and
    the first of a source for that of the source's directory.
    """
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"))
    paths = docs.select("doc_id", "text", F.coalesce("source", F.lit("-")).alias("top"), F.concat(folder, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("path"))
    work = Workspace(spark, "op2")
    marked = work.keep(scan(paths, keep=["doc_id", "top", "path"]).withColumn("n_notices", F.size("notices").cast("long")).drop("notices").withColumn("dir", parent(F.col("path"))), "scanned")
    have = marked.where("own_license IS NOT NULL AND path IS NOT NULL")
    source = lambda by: have.groupBy(F.col(by).alias("up")).agg(F.min_by("own_license", "path").alias("license"), F.min("path").alias("from"))
    return climb(work, marked, source("dir").union(source("top"))).select("doc_id", "own_license", "own_score", "n_notices", "license", "inherited_from", F.col("depth").cast("long").alias("depth"))
