"""Operator 6 (native): licence scan by canonical digest lookup.

A text's canonical form has no case, no punctuation, no copyright lines and one spelling for equivalent words;
two texts of one licence then agree word for word, and an entire text is looked up by the digest of its
canonical form. What is looked up is the whole document and each of its paragraphs and lines, so that a
licence that stands in other text is found too.

Scale: JVM expressions alone, one scan. The known digests are a fixed table of this package, so broadcasting
them is safe at any input. A row's units stay in its task; they are combined there before the one shuffle,
which carries a digest and a few names a document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence notices and short licences, as their stewards publish them (spdx.org names).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Spellings that mean the same in a licence (after the matching guidelines of the SPDX list).
SAME = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
        ("favour", "favor"), ("non infringement", "noninfringement"), ("noncommercial", "non commercial"), ("sharealike", "share alike"),
        ("copyright owner", "copyright holder"), ("https", "http"), ("version", "v"))
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"
# A licence names itself or its terms: a line or paragraph without any of these cannot have a known digest.
TELLING = ("licen", "permission", "free software", "waived", "public domain")


def canonical(text: Column) -> Column:
    """Lower case; lines that state a copyright left out; everything but letters and digits one space; one
    spelling for equivalent words. Words stand between spaces of their own until all spellings are replaced."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in SAME:
        t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical_sql(expr: str) -> str:
    """The same in DuckDB SQL."""
    t = f"regexp_replace(lower({expr}), '{COPYRIGHT_LINE}', ' ', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for a, b in SAME:
        t = f"replace({t}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({t}, '  ', ' '))"


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of the known texts, one row per digest: a fixed, small table."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, text_digest (of the whole canonical text), license (of the whole text, else
    null), licenses (the licences found as whole text, paragraph or line: distinct, sorted, comma-joined; empty
    if none), n_matches (matching units).

    Units are the whole text, its lines if there are several, and its paragraphs of several lines if there are
    several paragraphs. A null or empty text has the digest of the empty text and no licence. Repeated rows get
    equal results; an empty table gives an empty result. Other columns are not read."""
    known = F.broadcast(known if known is not None else known_digests(docs.sparkSession))
    tells = lambda c: reduce(or_, [c.contains(w) for w in TELLING])
    none = F.array().cast("array<string>")
    lines, blocks = F.split("text", "\n"), F.split("text", r"\n[ \t]*\n")
    parts = F.concat(F.when(F.size(lines) > 1, lines).otherwise(none),
                     F.when(F.size(blocks) > 1, F.filter(blocks, lambda b: b.contains("\n"))).otherwise(none))
    parts = F.when(tells(F.lower("text")), F.filter(parts, lambda u: tells(F.lower(u)))).otherwise(none)
    unit = lambda u, whole: F.struct(F.sha2(canonical(u), 256).alias("digest"), F.lit(whole).alias("whole"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = rows.select("row", "id", F.explode(F.concat(F.array(unit(F.col("text"), True)), F.transform(parts, lambda u: unit(u, False)))).alias("u"))
    met = units.select("row", "id", "u.digest", "u.whole").join(known, "digest", "left")
    whole = lambda c: F.max(F.when(F.col("whole"), F.col(c)))
    return (met.groupBy("row").agg(F.first("id").alias("doc_id"), whole("digest").alias("text_digest"), whole("license").alias("license"),
                                   F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count("license").alias("n_matches"))
            .drop("row"))
