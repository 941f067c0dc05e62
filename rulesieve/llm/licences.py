"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.  DataFrame operations only.

Every text is cut into passages at line ends and after full stops.  A passage's terms, weighted by count times idf, are
compared with each template's by cosine; idf is taken over the templates, a term that none has counts as rarest.  Terms are
rows (passage, term, weight), so a passage is only compared with templates that share a term.  What is gathered in one row are
a passage's different terms, never more than the row of its text holds.  A passage that denies a licence has no statement.

Besides passages the longer pieces of a text are compared: the whole text, runs of comment lines, paragraphs (parted by lines
without a letter or digit), runs of up to RUN paragraphs that begin and end with an anchored one, and the sentences of
paragraphs whose lines are joined.  There are two sets of templates, each with an idf of its own: TEMPLATES, the statements,
and the headers, grants and whole texts of licences (HEADERS and the files of licence_texts).

Pieces are looked at if they hold one of the anchor terms.  That drops nothing: the anchors are chosen so that a piece
without any has a cosine below LEAST with every template (the weight of a template's other terms bounds it).

A file keeps the licence of its best piece, of either set.  Licence files (by base name) also license their directory, and a file without
a licence of its own takes that of its nearest ancestor directory.  Directories, not files, are joined with their
ancestors, and files with their directories by a salted key, so that one directory may hold a third of all files.

Defined results: a null text counts as empty; a null path is a file in no directory; ties go to the first template by name,
and between licence files of one directory to the better score, then the smaller path; repeated rows each get their
result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up

LEAST = 0.75
#: Paragraphs that are compared as one piece, at most.
RUN = 6
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"

#: Usual one-sentence statements of licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Use of this source code is governed by the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Identifiers in SPDX lines, where they aren't the licence's name.
_SPDX = {n: [f"{n}-only", f"{n}-or-later"] for n in ("AGPL-3.0", "GFDL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")}
for _name in sorted({*TEMPLATES, *_SPDX}):
    TEMPLATES[_name] = [*TEMPLATES.get(_name, ()), *[f"SPDX-License-Identifier: {x}" for x in (_name, *_SPDX.get(_name, ()))]]
#: An SPDX line's tag and identifier make one term.
_TAG, _TAGGED = r"spdx-license-identifier:[ \t]*", "spdx-license-identifier."
#: A passage that says so of a licence isn't its statement.
NEGATED = r"(?i)(?:(?:^|[^A-Za-z])(?:not|never|no longer)|n['’]t)[ \t]+(?:[A-Za-z]+[ \t]+){0,2}(?:licen[sc]ed|released|dedicated|governed|covered|subject)(?:[^A-Za-z]|$)"
_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_LGPL = _GPL.replace("program", "library")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_END = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Standard headers and grants, and whole licences that are short.  Longer ones are files of licence_texts.
HEADERS = {
    "AGPL-3.0": [_GPL.format("Affero ", "3")],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_NAMES + _BSD_END, _BSD_NAMES],
    "GFDL-1.2": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
    "GPL-1.0": [_GPL.format("", "1")],
    "GPL-2.0": [_GPL.format("", "2")],
    "GPL-3.0": [_GPL.format("", "3")],
    "ISC": [_ISC, _ISC + _ISC_END],
    "LGPL-2.0": [_LGPL.format("Library ", "2")],
    "LGPL-2.1": [_LGPL.format("Lesser ", "2.1")],
    "LGPL-3.0": [_LGPL.format("Lesser ", "3")],
    "MIT": [_MIT, _MIT + _MIT_END],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: What section 13 of the AGPL has in the place of the GPL's.
_AGPL_13 = (
    "Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely "
    "through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, "
    "through some standard or customary means of facilitating copying of software. "
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Words that count for nothing.
STOP = tuple("a an and any be by can for found in into is it may not of or that the this to under use with you".split())
#: A term that is an everyday word in some language and so makes a poor anchor.
_POOR = "mit"


@functools.cache
def long_templates() -> dict[str, list[str]]:
    """HEADERS and the whole texts of licence_texts; that of the AGPL is made of the GPL's."""
    out = {name: list(texts) for name, texts in HEADERS.items()}
    whole = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    whole["AGPL-3.0"] = re.sub(r"(?i)gnu\s+general\s+public", "GNU Affero General Public", whole["GPL-3.0"]) + _AGPL_13
    for name, text in whole.items():
        out.setdefault(name, []).append(text)
    return out


def _statements(templates: dict[str, list[str]] | None = None) -> list[tuple[str, int, dict[str, int]]]:
    """Licence, number of the statement and its terms' counts; of TEMPLATES, or of others."""
    out = []
    for name, texts in sorted((templates or TEMPLATES).items()):
        for k, text in enumerate(texts):
            terms = [t for t in re.findall(_TERM, re.sub(_TAG, _TAGGED, text.lower())) if t not in STOP]
            out.append((name, k, {t: terms.count(t) for t in terms}))
    return out


def weights(templates: dict[str, list[str]] | None = None) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """Rows (licence, statement, term, weight of a vector of length 1), idf by term, and the idf of unknown terms."""
    own = _statements(templates)
    n = len(own)
    idf = {t: math.log((1 + n) / (1 + sum(t in terms for _, _, terms in own))) + 1 for _, _, terms in own for t in terms}
    rows = []
    for name, k, terms in own:
        length = math.sqrt(sum((c * idf[t]) ** 2 for t, c in terms.items()))
        rows += [(name, k, t, c * idf[t] / length) for t, c in sorted(terms.items())]
    return rows, idf, math.log(1 + n) + 1


@functools.cache
def long_anchors(least: float = LEAST) -> list[str]:
    """As anchors(), for the long templates: the term that most of the templates still need first, long words before others."""
    rows, _, _ = weights(long_templates())
    left: dict[tuple[str, int], dict[str, float]] = {}
    for name, k, t, w in rows:
        left.setdefault((name, k), {})[t] = w * w
    chosen: set[str] = set()
    while left := {key: own for key, own in left.items() if sum(own.values()) >= least * least}:
        gain: dict[str, float] = {}
        for own in left.values():
            for t, w in own.items():
                gain[t] = gain.get(t, 0.0) + w
        best = max(gain, key=lambda t: (len(t) > 5, gain[t], t))
        chosen.add(best)
        for own in left.values():
            own.pop(best, None)
    return sorted(chosen)


def anchors(least: float = LEAST) -> list[str]:
    """Terms of which every passage that can reach the cosine holds one: a statement's other terms weigh less than least."""
    rows, _, _ = weights()
    chosen: set[str] = set()
    for name, k, _ in _statements():
        own = {t: w for n, j, t, w in rows if (n, j) == (name, k)}
        for t in sorted(own, key=lambda t: (t == _POOR, -sum(t == r[2] for r in rows), t)):
            if math.sqrt(sum(w * w for u, w in own.items() if u not in chosen)) < least:
                break
            chosen.add(t)
    return sorted(chosen)


def _choice(terms: list[str]) -> str:
    """A pattern for any of the terms, begun alike ones only once, so that a place is tried a letter at a time."""
    if terms == [""]:
        return ""
    parts = [re.escape(first) + _choice(sorted(t[1:] for t in terms if t[:1] == first)) for first in sorted({t[0] for t in terms if t})]
    own = parts[0] if len(parts) == 1 and "" not in terms else "(?:" + "|".join(parts) + ")"
    return own + ("?" if "" in terms else "")


def _anchored(terms: list[str]) -> str:
    """A pattern that text with one of the terms has; an SPDX line counts whatever it names."""
    tag = _TAGGED[:-1]
    return rf"(?i)(?<![a-z0-9])(?:{tag}:|{_choice(sorted(t for t in terms if not t.startswith(tag)))}(?![a-z0-9]))"


def passages(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "([.!?])[ \\t\\r\\n]+", "$1\n"), "\n")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once also where use takes it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column, anchored: Column) -> Column:
    """All pieces of a text that hold an anchor, passages first; each once."""
    held = F.transform(F.split(text, r"\n[^\p{L}\p{N}]*\n"), lambda p: F.struct(p.alias("p"), F.rlike(p, anchored).alias("a")))
    none = F.array().cast("array<string>")

    def runs(own: Column) -> Column:
        def at(s: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(own) - i)), lambda k: F.get(own, i + k - 1)["a"])
            return F.when(s["a"], F.transform(ends, lambda k: F.array_join(F.transform(F.slice(own, i + 1, k), lambda x: x["p"]), "\n"))).otherwise(none)

        joined = F.transform(F.filter(own, lambda s: s["a"]), lambda s: passages(F.regexp_replace(s["p"], r"[ \t\r]*+\n[^\p{L}\p{N}\n]*+", " ")))
        return F.concat(F.flatten(F.transform(own, at)), F.flatten(joined))

    comments = F.split(F.regexp_replace(text, r"(?md)^(?![ \t]*+(?:/[/*]|\*|#|--|;|%|<!--|\.\.))[^\n]*+", ""), "\n\n")
    return F.array_distinct(F.filter(F.concat(passages(text), F.array(text), comments, _once(held, runs)), lambda p: F.rlike(p, anchored)))


def _cosines(terms: DataFrame) -> DataFrame:
    """doc_id, text_key, licence and c of the pieces that reach LEAST; terms: doc_id, text_key, passage, negated, term.

    The two sets of templates are gone through at once, each with its own idf; a denial has no statement.
    """
    spark, sets = terms.sparkSession, (weights(TEMPLATES), weights(long_templates()))
    idf = sorted({t for _, idf, _ in sets for t in idf})
    idfs = F.broadcast(spark.createDataFrame([(t, *(idf.get(t, unknown) for _, idf, unknown in sets)) for t in idf], "term string, i0 double, i1 double"))  # a fixed table
    table = F.broadcast(spark.createDataFrame([(k, *row) for k, (rows, _, _) in enumerate(sets) for row in rows], "set int, licence string, statement int, term string, weight double"))  # a fixed table
    key = ["doc_id", "text_key", "passage"]
    counts = terms.groupBy(*key, "term").agg(F.count("*").alias("tf"), F.max("negated").alias("negated"))
    weighted = counts.join(idfs, "term", "left")
    for k, (_, _, unknown) in enumerate(sets):
        weighted = weighted.withColumn(f"w{k}", F.col("tf") * F.coalesce(f"i{k}", F.lit(unknown)))
    lengths = [F.sqrt(F.sum(F.col(f"w{k}") * F.col(f"w{k}"))).alias(f"l{k}") for k in (0, 1)]
    length = weighted.groupBy(*key).agg(*lengths, F.max("negated").alias("negated"), F.collect_list(F.struct("term", "w0", "w1")).alias("terms"))
    near = length.select(*key, "l0", "l1", "negated", F.explode("terms").alias("t")).select(*key, "l0", "l1", "negated", "t.term", "t.w0", "t.w1").join(table, "term")
    of = lambda c: F.when(F.col("set") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    cosine = near.where("set = 1 OR NOT negated").groupBy(*key, "set", "licence", "statement").agg((F.sum(of("w") * F.col("weight")) / F.first(of("l"))).alias("c"))
    return cosine.where(F.col("c") >= LEAST).select("doc_id", "text_key", "licence", "c")


def own_licences(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, own_licence and own_score of the texts that hold a statement, a header or a licence; rows: doc_id, text_key, text."""
    anchored = F.lit(_anchored(sorted({*anchors(), *long_anchors()})))
    found = rows.where(F.rlike("text", anchored)).select("doc_id", "text_key", F.posexplode(pieces(F.col("text"), anchored)).alias("passage", "p"))
    found = found.withColumn("negated", F.rlike("p", F.lit(NEGATED)))
    # a term that a hyphen or dot joins to an anchor makes another term, so what the pattern lets through is a superset
    terms = found.select("doc_id", "text_key", "passage", "negated", F.explode(F.regexp_extract_all(F.regexp_replace(F.translate("p", _UPPER, _LOWER), _TAG, _TAGGED), F.lit(_TERM), F.lit(0))).alias("term")).where(~F.col("term").isin(*STOP))
    cosine = _cosines(terms)
    best = cosine.groupBy("doc_id", "text_key").agg(F.max(F.round("c", 6)).alias("own_score"), F.min(F.struct((-F.round("c", 6)).alias("c"), "licence")).alias("b"))
    return best.select("doc_id", "text_key", F.col("b.licence").alias("own_licence"), "own_score")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherited(files: DataFrame, is_licence_file: Column) -> DataFrame:
    """Adds licence, origin (own, inherited, none) and licensed_by (directory); files: path, own_licence, own_score, ..."""
    placed = files.withColumn("__rs_dir", directory(F.col("path")))
    own = placed.where(is_licence_file & F.col("own_licence").isNotNull() & F.col("path").isNotNull())
    licensed = own.groupBy("__rs_dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_licence").alias("l"))).alias("b"))
    licensed = licensed.select(F.col("__rs_dir").alias("__rs_up"), F.col("b.l").alias("licence"))
    dirs = placed.where(F.col("own_licence").isNull() & F.col("path").isNotNull()).select("__rs_dir").distinct()
    parts = F.split("__rs_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    chain = dirs.select("__rs_dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "__rs_up"))
    nearest = chain.join(licensed, "__rs_up").groupBy("__rs_dir").agg(F.max(F.struct("depth", F.col("licence").alias("l"), F.col("__rs_up").alias("u"))).alias("b"))
    nearest = nearest.select(F.col("__rs_dir").alias("__rs_for"), F.col("b.l").alias("__rs_l"), F.col("b.u").alias("__rs_u"))
    placed = placed.withColumn("__rs_for", F.when(F.col("own_licence").isNull(), F.coalesce("__rs_dir", F.lit("")))).withColumn("__rs_by", F.xxhash64("path"))
    out = looked_up(placed.where("__rs_for IS NOT NULL"), nearest, ["__rs_for"], "__rs_by", "left")
    out = out.select(*files.columns, "__rs_l", "__rs_u").union(placed.where("__rs_for IS NULL").select(*files.columns, F.lit(None).cast("string"), F.lit(None).cast("string")))
    origin = F.when(F.col("own_licence").isNotNull(), "own").when(F.col("__rs_l").isNotNull(), "inherited").otherwise("none")
    return out.select(*files.columns, F.coalesce("own_licence", "__rs_l").alias("licence"), origin.alias("origin"), F.col("__rs_u").alias("licensed_by"))


def scan(files: DataFrame, licence_file: str = LICENCE_FILE) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence, origin, licensed_by of every file; files: doc_id, path, text."""
    rows = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    own = own_licences(rows.select("doc_id", "text_key", "text")).withColumnsRenamed({"doc_id": "__rs_id", "text_key": "__rs_key"})
    found = rows.select("doc_id", "path", "text_key").join(own, F.col("doc_id").eqNullSafe(F.col("__rs_id")) & (F.col("text_key") == F.col("__rs_key")), "left")
    found = found.select("doc_id", "path", "own_licence", "own_score")
    return inherited(found, F.rlike("path", F.lit(licence_file)))


def query(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/thousand/last digit; of ids that 10 divides, the licence files of its thousands, of those that 100 divides, of its sources."""
    at = lambda name, *up: F.concat_ws("/", "source", *up, name)
    doc, thousand = F.col("doc_id").cast("string"), F.expr("doc_id div 1000").cast("string")
    licence = F.concat(F.lit("LICENSE."), doc)
    path = F.when(F.col("doc_id") % 100 == 0, at(licence)).when(F.col("doc_id") % 10 == 0, at(licence, thousand)).otherwise(at(F.concat(doc, F.lit(".txt")), thousand, (F.col("doc_id") % 10).cast("string")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def sql() -> str:
    """The same rows from single passages and statements; the nearest of all ancestors that have a licence."""
    weight, idf, unknown = weights()
    rows = ",\n".join(f"('{a}', {b}, '{c}', {d!r})" for a, b, c, d in weight)
    idfs = ",\n".join(f"('{a}', {b!r})" for a, b in sorted(idf.items()))
    return rf"""
WITH weight(licence, statement, term, weight) AS (VALUES {rows}),
idf(term, idf) AS (VALUES {idfs}),
f AS (
  SELECT doc_id, concat_ws('/', source, CASE WHEN doc_id % 100 = 0 THEN 'LICENSE.' || doc_id WHEN doc_id % 10 = 0 THEN (doc_id // 1000) || '/LICENSE.' || doc_id ELSE (doc_id // 1000) || '/' || (doc_id % 10) || '/' || doc_id || '.txt' END) AS path,
    doc_id % 10 = 0 AS is_licence_file, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))) AS p FROM f WHERE text ILIKE '%licens%' OR text ILIKE '%public%' OR text ILIKE '%permission%' OR text ILIKE '%unencumbered%' OR text ILIKE '%governed%'),
k AS (SELECT doc_id, row_number() OVER () AS k, p FROM p WHERE (p ILIKE '%licens%' OR p ILIKE '%public%' OR p ILIKE '%permission%' OR p ILIKE '%unencumbered%' OR p ILIKE '%governed%') AND NOT regexp_matches(p, '{NEGATED.replace("'", "''")}')),
t AS (SELECT * FROM (SELECT doc_id, k, unnest(regexp_extract_all(regexp_replace(translate(p, '{_UPPER}', '{_LOWER}'), '{_TAG}', '{_TAGGED}', 'g'), '{_TERM}')) AS term FROM k) WHERE term NOT IN {STOP!r}),
w AS (SELECT doc_id, k, t.term, count(*) * coalesce(any_value(idf.idf), {unknown!r}) AS w FROM t LEFT JOIN idf ON idf.term = t.term GROUP BY ALL),
l AS (SELECT doc_id, k, sqrt(sum(w * w)) AS length FROM w GROUP BY ALL),
c AS (SELECT w.doc_id, licence, round(sum(w * weight) / any_value(length), 6) AS c, sum(w * weight) / any_value(length) AS raw FROM w JOIN weight ON weight.term = w.term JOIN l ON l.doc_id = w.doc_id AND l.k = w.k GROUP BY w.doc_id, w.k, licence, statement),
o AS (SELECT doc_id, max(c) AS own_score, first(licence ORDER BY c DESC, licence) AS own_licence FROM c WHERE raw >= {LEAST} GROUP BY doc_id),
g AS (SELECT f.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, is_licence_file, own_licence, own_score FROM f LEFT JOIN o ON o.doc_id = f.doc_id),
d AS (SELECT dir, first(own_licence ORDER BY own_score DESC, path) AS licence FROM g WHERE is_licence_file AND own_licence IS NOT NULL GROUP BY dir),
n AS (SELECT x.dir, arg_max(d.licence, length(d.dir)) AS licence, arg_max(d.dir, length(d.dir)) AS up FROM (SELECT DISTINCT dir FROM g) x JOIN d ON x.dir = d.dir OR starts_with(x.dir, d.dir || '/') GROUP BY x.dir)
SELECT g.doc_id, g.path, g.own_licence, g.own_score, coalesce(g.own_licence, n.licence) AS licence,
  CASE WHEN g.own_licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN g.own_licence IS NULL THEN n.up END AS licensed_by
FROM g LEFT JOIN n ON n.dir = g.dir
"""
