"""Licence notices and texts within documents, by the Dice coefficient over word pairs, with DataFrame functions only."""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.llm.common import documents

MIN_DICE = 0.8
#: Longest windows that are looked at from a pair of a template on, in sizes of the template; beyond the last none reaches 0.8.
FRAMES = (1.0, 1.25, 1.5)
EDGE = 0.314159  # of a pair, off the longest window, so that no window ends on the very edge

# Notices and short licences in use, with the identifiers of the common licence list.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def pairs_of(text: str) -> list[tuple[str, str]]:
    """Distinct neighbouring words of a template, normalised as texts are: letters and digits in lower case."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(zip(words, words[1:])))


def bounds(size: int, min_dice: float) -> tuple[int, int]:
    """Fewest and most pairs of a segment that can reach the coefficient with a template of ``size`` pairs."""
    ratio = min_dice / (2 - min_dice)
    return ceil(size * ratio - 1e-9), floor(size / ratio + 1e-9)


def reach(frame: float, largest: int) -> float:
    """How far, in sizes of the template, the last pair of a window may lie behind its first."""
    return frame - EDGE / largest


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, licence, dice, notices): licences whose notices or texts a document holds, with the best coefficient and
    their number, wherever they stand: in a line or paragraph of their own, within a sentence, wrapped, or end to end.

    Windows of a text's word pairs are compared with the templates. A window starts and ends at a pair of the template,
    as the best ones do; from each such pair on the longest windows of FRAMES times the template's size are taken. Dice is
    twice the number of shared distinct pairs over the template's size and the window's, a pair of the template counted
    once. The coefficient asked for bounds the window's size, and so how many pairs it must share; a text that shares
    fewer with a template is not looked at for it. Windows that overlap are one notice, so one that
    is repeated end to end counts once. Pairs are compared by 64-bit
    hashes. Null and empty texts hold none; rows with a null doc_id count together under null, as do rows that repeat a
    doc_id. The templates are a parameter; their number, not the texts', sets what is sent.
    """
    spark = docs.sparkSession
    known = [(n, name, pairs_of(text)) for n, (name, text) in enumerate(templates)]
    rows = [(n, name, len(p), *bounds(len(p), min_dice), a, b) for n, name, p in known for a, b in p]
    table = spark.createDataFrame(rows, "template int, licence string, size int, low int, high int, a string, b string")
    table = table.select("template", "licence", "size", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("pair"))
    held: dict[int, list[int]] = {}
    for r in table.collect():  # the templates' pairs
        held.setdefault(r.template, []).append(r.pair)
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    need = {n: ceil(min_dice * (low + size) / 2 - 1e-9) for n, _, size, low, *_ in rows}
    largest = max((r[2] for r in rows), default=1)
    fits = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("hits", longs(held[n]))) >= k, F.lit(n)) for n, k in need.items()]).cast("array<int>"))

    plain = F.lower(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[^\\p{L}\\p{N}]+", " "))
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w)).alias("w"))
    df = df.select("doc_id", F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("w", i + 1))).alias("p"))
    # The number of the row also holds the filters above the pairs, which they would otherwise work out again.
    df = df.select("doc_id", "p", F.array_intersect("p", longs(sorted({x for xs in held.values() for x in xs}))).alias("hits"), F.monotonically_increasing_id().alias("text"))
    df = df.where(F.size("hits") >= min(need.values(), default=1)).select("doc_id", "text", "p", fits.alias("fits")).where(F.size("fits") > 0)
    df = df.select("doc_id", "text", "fits", F.posexplode("p").alias("at", "pair"))
    met = df.join(table, "pair").where(F.array_contains("fits", F.col("template")))
    met = met.select("doc_id", "text", "template", "licence", "size", "at", "pair", (F.col("at") / F.col("size")).alias("x"))
    best, end = F.lit(0.0), F.lit(-1)
    for n, frame in enumerate(FRAMES):
        ahead = f"OVER (PARTITION BY text, template ORDER BY x RANGE BETWEEN CURRENT ROW AND {reach(frame, largest)!r}D FOLLOWING)"
        met = met.withColumns({f"set{n}": F.expr(f"size(collect_set(pair) {ahead})"), f"end{n}": F.expr(f"max(at) {ahead}"), f"all{n}": F.expr(f"count(pair) {ahead}")})
        dice = 2.0 * F.col(f"set{n}") / (F.col("size") + (F.col(f"end{n}") - F.col("at") + 1) - (F.col(f"all{n}") - F.col(f"set{n}")))
        best, end = F.greatest(best, dice), F.greatest(end, F.when(dice >= min_dice, F.col(f"end{n}")).otherwise(-1))
    good = met.select("doc_id", "text", "licence", "at", best.alias("dice"), end.alias("end")).where(F.col("dice") >= min_dice)
    line = Window.partitionBy("text", "licence").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("at") > F.max("end").over(line), F.lit(True)).cast("bigint")
    return good.withColumn("fresh", fresh).groupBy("doc_id", "licence").agg(F.round(F.max("dice"), 6).alias("dice"), F.sum("fresh").alias("notices"))


def op9_licence_dice(spark: SparkSession, sf: str) -> DataFrame:
    return scan(documents(spark, sf))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = [(n, name, pairs_of(text)) for n, (name, text) in enumerate(TEMPLATES)]
    values = ", ".join(f"({n}, {quote(name)}, {quote(f'{a} {b}')})" for n, name, pairs in known for a, b in pairs)
    largest = max(len(pairs) for _, _, pairs in known)
    frames = ", ".join(f"({frame}, {reach(frame, largest)!r}::DOUBLE)" for frame in FRAMES)
    return rf"""
WITH template(template, licence, pair) AS (VALUES {values}), sized AS (
  SELECT *, count(*) OVER (PARTITION BY template) AS size FROM template
), plain AS (
  SELECT row_number() OVER () AS text, doc_id, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents
), pair AS (
  SELECT text, doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS pair FROM plain, unnest(range(1, len(w))) AS t(i)
), hit AS (
  SELECT text, doc_id, template, licence, size, pos, pair, pos::DOUBLE / size AS x FROM pair JOIN sized USING (pair)
), able AS (
  SELECT text, template FROM hit GROUP BY text, template, size HAVING count(DISTINCT pair) >= 0.5e0 * size
), near AS (
  SELECT hit.* FROM hit SEMI JOIN able USING (text, template)
), win AS (
  SELECT a.text, a.doc_id, a.licence, a.template, a.pos, f.width, max(b.pos) AS last, 2.0::DOUBLE * count(DISTINCT b.pair) / (a.size + (max(b.pos) - a.pos + 1) - (count(*) - count(DISTINCT b.pair))) AS dice
  FROM near a JOIN near b USING (text, template), (VALUES {frames}) f(width, reach)
  WHERE b.x BETWEEN a.x AND a.x + f.reach GROUP BY a.text, a.doc_id, a.licence, a.template, a.size, a.pos, f.width
), good AS (
  SELECT text, doc_id, licence, pos, template, max(dice) AS dice, max(last) AS last FROM win WHERE dice >= {MIN_DICE} GROUP BY ALL
), marked AS (
  SELECT *, coalesce(pos > max(last) OVER (PARTITION BY text, licence ORDER BY pos, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM good
)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) FILTER (WHERE fresh) AS notices FROM marked GROUP BY doc_id, licence
"""


QUERIES = {"op9_licence_dice": (op9_licence_dice, _sql())}
