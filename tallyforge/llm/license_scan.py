"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Templates are notices, file headers and licence texts. Comment marks at the beginnings of lines are stripped. Documents are
compared by units: each line that has one of the templates' marks, windows of ``WINDOWS`` lines from where such lines or their
paragraph begin, and of files named as licences also the whole text. A mark is a term that a unit needs for a cosine of ``COSINE`` with some template: the other terms
of that template together weigh too little. Units and templates are sparse rows (unit, term, weight) joined by term; equal
units are compared once. Inverse document frequencies count all documents. A file's own licence is what its
SPDX tag says, or else that of a unit: of those with a cosine of ``SURE`` or more the one with the largest template (a text that
goes on is told from one that ends), else the one with the highest cosine, if that is near enough. A directory's is the one that most files directly in
it have themselves (the first by name if tied). A file without one of its own takes that of the nearest
directory above it that has one: its ancestors are listed and joined to directories by path.

DataFrame expressions only; what is broadcast are the templates' terms, a fixed number.

Defined results: a null text is empty; rows that repeat an id share the best of their units; a row with a null path
inherits nothing; null ids are one file; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.quality import let
from tallyforge.llm.staging import Workspace, text_of

COSINE, SURE = 0.6, 0.9
WINDOWS = (1, 2, 4, 8, 16, 32)  #: lines of a unit
SPDX = r"SPDX-License-Identifier:\s*\(?\s*([A-Za-z0-9.+-]+)"
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|;+|--+|%+|<!--)?[ \t]*"
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT = _GRANT + """ (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD2 = _REDISTRIBUTION + " provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_NO_WARRANTY = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
_PREAMBLE = "GNU {0}GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: Notices, headers and openings of common licences, by SPDX name (fixed values).
TEMPLATES = [
    ("AGPL-3.0-or-later", _FREE.format("program", ":", "Affero ", ",", "3")),
    ("AGPL-3.0", _PREAMBLE.format("AFFERO ", "3, 19 November 2007", "2007")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", _BSD2 + " " + _DISCLAIMER),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License. " + _REDISTRIBUTION + "."),
    ("BSD-3-Clause", _BSD2 + " " + _THIRD),
    ("BSD-3-Clause", _BSD2 + " " + _THIRD + " " + _DISCLAIMER),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _PREAMBLE.format("", "2, June 1991", "1989, 1991")),
    ("GPL-2.0-or-later", _FREE.format("program", ";", "", ";", "2")),
    ("GPL-2.0-or-later", _FREE.format("program", ";", "", ";", "2") + _NO_WARRANTY.format("program", "")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", _PREAMBLE.format("", "3, 29 June 2007", "2007")),
    ("GPL-3.0-or-later", _FREE.format("program", ":", "", ",", "3")),
    ("GPL-3.0-or-later", _FREE.format("program", ":", "", ",", "3") + _NO_WARRANTY.format("program", "")),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("LGPL-2.1-or-later", _FREE.format("library", ";", "Lesser ", ";", "2.1")),
    ("LGPL-2.1-or-later", _FREE.format("library", ";", "Lesser ", ";", "2.1") + _NO_WARRANTY.format("library", "Lesser ")),
    ("LGPL-2.1", _PREAMBLE.format("LESSER ", "2.1, February 1999", "1991, 1999")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _PREAMBLE.format("LESSER ", "3, 29 June 2007", "2007")),
    ("LGPL-3.0-or-later", _FREE.format("library", ":", "Lesser ", ",", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", _GRANT + "."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def term_counts(text: str) -> Counter:
    """The same of a template."""
    return Counter(t for t in re.split("[^a-z0-9]+", text.lower()) if t)


def rarity(df: int, n: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def template_weights(df: dict[str, int], n: int) -> list[dict[str, float]]:
    return [{t: c * rarity(df.get(t, 0), n) for t, c in term_counts(text).items()} for _, text in TEMPLATES]


def marks(weights: list[dict[str, float]], df: dict[str, int]) -> list[str]:
    """Terms of which a unit has at least one if its cosine with some template is ``COSINE`` or more: by Cauchy and Schwarz, the
    terms that it shares with the template hold ``COSINE`` squared of the template's squared norm, so the others can't be all it
    shares. Any terms will do whose complement holds less; those with the fewest documents for their weight are taken first,
    so that few lines of ordinary text have one."""
    out = set()
    for w in weights:
        left = sum(x * x for x in w.values())
        least = COSINE * COSINE * left
        for t in sorted(w, key=lambda t: (df.get(t, 0) / (w[t] * w[t]), t)):
            if left < least:
                break
            out.add(t)
            left -= w[t] * w[t]
    return sorted(out)


def document_counts(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Of the templates' terms, the documents that have each; and the number of documents."""
    vocabulary = sorted({t for _, text in TEMPLATES for t in term_counts(text)})
    known = F.array(*map(F.lit, vocabulary))
    rows = texts.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(F.col("text")), known))).alias("term"))
    found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return found, found.pop("", 0)


def unit_key(unit: str = "unit") -> Column:
    """128 bits that stand for a unit's text where its terms are rows."""
    return F.unhex(F.md5(F.encode(unit, "UTF-8")))


def match_units(units: DataFrame, df: dict[str, int], n: int) -> DataFrame:
    """(key, license, cosine, size): the best template of each of the ``units`` (key, unit; different ones), where it is near enough, and its norm."""
    spark = units.sparkSession
    rows = []
    for k, w in enumerate(template_weights(df, n)):
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(t, k, TEMPLATES[k][0], x / norm, norm) for t, x in w.items()]
    wanted = F.broadcast(spark.createDataFrame(rows, "term string, t int, license string, w double, size double"))
    idf = F.broadcast(spark.createDataFrame([(t, rarity(df.get(t, 0), n)) for t in {r[0] for r in rows}], "term string, idf double"))
    tf = units.select("key", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(idf, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(rarity(0, n)))).alias("x"))
    sizes = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(wanted, "term").groupBy("key", "t", "license", "size").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    near = dots.join(sizes, "key").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= COSINE)
    return near.groupBy("key").agg(F.max(F.struct("cosine", (-F.col("t")).alias("t"), "license", "size")).alias("m")).select("key", "m.license", "m.cosine", "m.size")


def unit_texts(text: Column, path: Column, mark: list[str]) -> Column:
    """The different units of a text: each marked line; the lines from the first of a run of marked lines on, and from the first after
    the blank line above such a run; and a licence file as a whole."""
    known = F.array(*map(F.lit, mark))

    def of_places(lines: Column, places: Column) -> Column:
        runs = F.filter(places, lambda k: ~F.array_contains(places, k - 1))
        blank = F.filter(F.transform(lines, lambda x, k: F.when(F.trim(x) == "", k)), lambda k: k.isNotNull())
        above = F.transform(runs, lambda k: F.coalesce(F.array_max(F.filter(blank, lambda b: b < k)) + 1, F.lit(0)))
        starts = F.array_distinct(F.concat(runs, F.filter(above, lambda b: ~F.array_contains(places, b))))
        window = lambda k, w: F.array_join(F.slice(lines, k + 1, F.lit(w)), " ")
        each = F.concat(F.transform(places, lambda k: window(k, WINDOWS[0])), F.flatten(F.transform(starts, lambda k: F.array(*[window(k, w) for w in WINDOWS[1:]]))))
        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(each, F.when(path.rlike(LICENSE_FILE) & (F.size(places) > 0), F.array(F.array_join(lines, " "))).otherwise(none)))

    marked = lambda lines: F.filter(F.transform(lines, lambda x, k: F.when(F.arrays_overlap(terms(x), known), k)), lambda k: k.isNotNull())
    # a text without any mark has no units, and most have none: one look at its terms spares the lines
    units = let(F.split(F.regexp_replace(text, COMMENT, ""), "\n"), lambda lines: let(marked(lines), lambda places: of_places(lines, places)))
    return F.when(F.arrays_overlap(terms(text), known), units).otherwise(F.array().cast("array<string>"))


def scan(files: DataFrame, path: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, n_notice_units, own_license, license (own or inherited) and inherited_from (a directory)."""
    with Workspace(files.sparkSession, "licenses") as work:
        texts = files.select(F.col(id_column).cast("long").alias("id"), path.alias("path"), text_of(text_column).alias("text"))
        df, n = document_counts(texts)
        tag = F.nullif(F.regexp_extract("text", SPDX, 1), F.lit(""))
        mark = marks(template_weights(df, n), df)
        rows = work.staged(texts.select("id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), tag.alias("tag"), unit_texts(F.col("text"), F.coalesce("path", F.lit("")), mark).alias("units")), "files")
        units = rows.select("id", F.posexplode("units").alias("at", "unit")).withColumn("key", unit_key())
        best = work.staged(match_units(units.select("key", "unit").dropDuplicates(["key"]), df, n), "units")
        told = units.drop("unit").join(best, "key").select("id", F.when(F.col("cosine") >= SURE, F.col("size")).otherwise(0.0).alias("sure"), "cosine", "at", "license")
        told = told.union(rows.filter("tag IS NOT NULL").select("id", F.lit(float("inf")), F.lit(1.0), F.lit(-1), "tag"))
        own = told.groupBy("id").agg(F.max(F.struct("sure", "cosine", (-F.col("at")).alias("at"), "license")).alias("m")).select(F.col("id").alias("own_id"), F.col("m.license").alias("own_license"))
        known = work.keep(work.staged(rows.select("id", "dir", F.size("units").cast("long").alias("n_notice_units")).join(own, F.col("id").eqNullSafe(F.col("own_id")), "left").drop("own_id"), "own"))
        votes = known.filter("own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
        dirs = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("m")).select("dir", F.col("m.own_license").alias("license"))
        parts = F.split("dir", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        asking = known.filter("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct()
        nearest = asking.select("dir", F.posexplode(above).alias("depth", "up")).join(dirs.withColumnRenamed("dir", "up"), "up")
        given = nearest.groupBy("dir").agg(F.max(F.struct("depth", "up", "license")).alias("m")).select("dir", F.col("m.up").alias("from_dir"), F.col("m.license").alias("from_license"))
        out = known.join(given, "dir", "left")
        free = F.col("own_license").isNull()
        return out.select(F.col("id").alias(id_column), "n_notice_units", "own_license", F.coalesce("own_license", "from_license").alias("license"), F.when(free, F.col("from_dir")).alias("inherited_from"))


def document_path() -> Column:
    """A path for a document: under its source, a directory for each digit of its id but the last; 712 is in /src/7/1."""
    digits = F.filter(F.split(F.col("doc_id").cast("string"), ""), lambda c: c != "")
    return F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.when(F.size(digits) > 1, F.array_join(F.slice(digits, 1, F.size(digits) - 1), "/")), F.col("doc_id").cast("string"))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs, document_path())
