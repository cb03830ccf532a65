"""License scans by the Dice coefficient over word bigrams (operator 8), with DataFrame functions only.

Every line, and every paragraph of several lines, of a whole text is normalised (lower case, punctuation to blanks,
"licence" to "license") and its distinct word bigrams are compared with those of licence templates. With a and b
bigrams the coefficient is at most 2 min(a, b) / (a + b), so a template is only compared with units whose number of
bigrams lies between its bounds, and most units meet no template at all. In what these units leave of the text, every
run of words is compared that starts and ends with a bigram of the template and has no more bigrams than its upper
bound, so that notices inside lines, paragraphs and comments are found too (a run that starts or ends with other
bigrams never has a larger coefficient than the one inside it). Texts without any of the words that a match must have
are not cut at all. Whole short licences are templates of several paragraphs; of the long ones (Apache, GPL, MPL, EPL, CC)
the headings and notices are known, not their thousands of words. The templates are a constant of the plan; scanning is row by row inside the JVM and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Names in SPDX tags and the licence that they tell: fixed values.
TAGS = {x: x for x in ("MIT", "Apache-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "Unlicense", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Zlib", "0BSD")} | {
    f"{x}{more}": x for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for more in ("", "-only", "-or-later")}
#: Paragraphs that several licences are made of, as they are published: fixed values.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission.")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution.")
#: name, text: notices, headings of long licences and whole short licences, as they are published: fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_NOTICE),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", _BSD_GRANT),  # which of them is told by what follows
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                "https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
    # a tag of one word needs all of a shorter template
    *((name, f"{'SPDX-' if '-' in tag else ''}License-Identifier: {tag}") for tag, name in TAGS.items()),
)


def normal(text: str) -> list[str]:
    """The words of a text as they are compared; ``_words`` does the same in Spark."""
    kept = "".join(c if c.isalnum() and c.isascii() or ord(c) >= 128 else " " for c in text.lower())
    return ["license" if w == "licence" else "licensed" if w == "licenced" else w for w in kept.split(" ") if w]


def bigrams(words: list[str]) -> set[str]:
    """The distinct pairs of neighbouring words."""
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bounds(n: int, least: float) -> tuple[int, int]:
    """The numbers of bigrams that a unit may have to reach ``least`` with a template of n."""
    low = next(k for k in range(n + 1) if 2 * min(k, n) / (k + n) >= least) if n else 0
    return low, int(n * (2 - least) / least + 1e-9)


def cues(known: list[tuple[str, list[str], int, int]]) -> list[str]:
    """Words of which every match has at least one: a template may lack n - low of its bigrams, and more than these hold such a word."""
    chosen: list[str] = []
    need = {k: (set(grams), len(grams) - low + 1) for k, (_, grams, low, _) in enumerate(known)}
    while need:
        # short words stand in every text; the one that serves the most templates goes first
        gain: dict[str, int] = {}
        for grams, _ in need.values():
            for w in {w for g in grams for w in g.split(" ")}:
                gain[w] = gain.get(w, 0) + 1
        best = max(gain, key=lambda w: (len(w) > 5, gain[w], len(w), w))
        chosen.append(best)
        for k, (grams, n) in list(need.items()):
            left = {g for g in grams if best not in g.split(" ")}
            n -= len(grams) - len(left)
            need[k] = (left, n)
            if n <= 0:
                del need[k]
    return sorted({"licen" if w.startswith("licens") else w for w in chosen})


def _words(unit: str) -> str:
    return f"filter(split(regexp_replace(regexp_replace(lower({unit}), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', ' '), '\\\\blicence', 'license'), ' '), w -> w <> '')"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id and licenses (array of license, dice, unit: the line or paragraph, or the normalised words of a run inside
    one or across some) of every row of ``docs`` (doc_id, text).

    For each unit the best template counts, the last by name of equals; of runs that overlap, the best. A null or empty text has no licences. Repeated
    rows stay repeated, doc_id may be null, an empty table gives an empty result."""
    known = []
    for name, text in templates:
        own = sorted(bigrams(normal(text)))
        low, high = bounds(len(own), least)
        known.append((name, own, low, high))
    smallest, largest = min(k[2] for k in known), max(k[3] for k in known)

    def quote(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    constant = "array(" + ", ".join(f"named_struct('name', {quote(n)}, 'grams', array({', '.join(map(quote, g))}), 'low', {lo}, 'high', {hi})" for n, g, lo, hi in known) + ")"
    every = f"array({', '.join(map(quote, sorted({g for k in known for g in k[1]})))})"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cued = F.expr(" or ".join(f"contains(lower_, {quote(w)})" for w in cues(known)))
    rows = docs.select("doc_id", text.alias("text_")).withColumn("lower_", F.lower("text_"))
    rows = rows.select("doc_id", F.when(cued, F.col("text_")).otherwise(F.lit("")).alias("text_"))
    lines, blocks = F.split("text_", "\\R"), F.filter(F.split("text_", "\\R[\\x20\\t]*\\R"), lambda b: b.rlike("\\R"))
    rows = rows.select("doc_id", "text_", F.filter(F.concat(lines, blocks), lambda u: F.length(u) > 0).alias("units"))
    # a unit's length in words bounds its bigrams before any are made
    long = f"filter(transform(units, u -> named_struct('unit', u, 'words', {_words('u')})), u -> size(u.words) > {smallest})"
    rows = rows.select("doc_id", "text_", F.expr(long).alias("units"))
    pairs = "array_distinct(transform(sequence(1, size(u.words) - 1), i -> concat(u.words[i - 1], ' ', u.words[i])))"
    rows = rows.select("doc_id", "text_", F.expr(f"filter(transform(units, u -> named_struct('unit', u.unit, 'grams', {pairs})), u -> size(u.grams) between {smallest} and {largest})").alias("units"))
    near = (
        f"array_max(transform(filter({constant}, t -> size(u.grams) between t.low and t.high), "
        "t -> named_struct('dice', 2 * size(array_intersect(u.grams, t.grams)) / (size(u.grams) + size(t.grams)), 'name', t.name)))"
    )
    rows = rows.select("doc_id", "text_", F.expr(f"transform(units, u -> named_struct('best', {near}, 'unit', u.unit))").alias("units"))
    rows = rows.select("doc_id", "text_", F.filter("units", lambda u: u["best"]["dice"] >= least).alias("hits"))
    # the rest of the text, without the units told and without the words that mark comments
    rest = "aggregate(array_sort(hits, (a, b) -> length(b.unit) - length(a.unit)), text_, (t, u) -> replace(t, u.unit, ' '))"
    rows = rows.withColumn("words_", F.expr(_words(f"regexp_replace({rest}, '(?mi)^[\\\\x20\\\\t]*(dnl|rem)\\\\b', ' ')")))
    rows = rows.withColumn("grams_", F.expr("if(size(words_) > 1, transform(sequence(1, size(words_) - 1), i -> concat(words_[i - 1], ' ', words_[i])), slice(words_, 1, 0))"))
    rows = rows.withColumn("known_", F.expr(f"array_intersect(grams_, {every})"))
    rows = rows.withColumn("templates_", F.expr(f"filter({constant}, t -> size(array_intersect(known_, t.grams)) >= t.low)"))
    placed = "filter(transform(grams_, (g, i) -> named_struct('g', g, 'i', i)), x -> array_contains(known_, x.g))"
    rows = rows.withColumn("placed_", F.expr(f"if(size(templates_) > 0, {placed}, slice({placed}, 1, 0))"))
    run = "transform(array(array_distinct(slice(grams_, a.i + 1, z.i - a.i + 1))), g -> 2 * size(array_intersect(g, t.grams)) / (size(g) + size(t.grams)))[0]"
    runs = (
        "flatten(transform(templates_, t -> transform(array(filter(placed_, x -> array_contains(t.grams, x.g))), m -> transform(m, (a, k) -> "
        f"array_max(transform(filter(slice(m, k + t.low, t.high - t.low + 1), z -> z.i - a.i < t.high), z -> named_struct('dice', {run}, 'name', t.name, 'start', a.i, 'end', z.i + 1)))))[0]))"
    )
    rows = rows.withColumn("runs_", F.expr(f"sort_array(filter({runs}, r -> r.dice >= {least}D), false)"))
    rows = rows.withColumn("runs_", F.expr("aggregate(runs_, slice(runs_, 1, 0), (kept, r) -> if(exists(kept, x -> x.start <= r.`end` and r.start <= x.`end`), kept, concat(kept, array(r))))"))
    units = F.transform("hits", lambda u: F.struct(u["best"]["name"].alias("license"), u["best"]["dice"].alias("dice"), u["unit"].alias("unit")))
    inside = F.expr("transform(runs_, r -> named_struct('license', r.name, 'dice', r.dice, 'unit', array_join(slice(words_, r.start + 1, r.`end` - r.start + 1), ' ')))")
    return rows.select("doc_id", F.concat(units, inside).alias("licenses"))


def told(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses (distinct), licenses (names, sorted, comma-joined) and best (the largest coefficient, 0 if none)."""
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    best: Column = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["dice"])), F.lit(0.0))
    return scan(docs).select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.concat_ws(",", names).alias("licenses"), F.round(best, 6).alias("best"))
