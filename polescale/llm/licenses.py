"""Licence scan, in DataFrame functions only: TF-IDF cosine to templates, then inheritance along directories.

Units of a file are its lines, its paragraphs (between blank lines) and its
whole text. A unit is a sparse TF-IDF vector over its words (letters and
digits, lower-cased); inverse document frequencies come from the templates,
words outside them weigh as the rarest. A unit is a template's if its
cosine is at least ``threshold``; a file takes the template of its best
unit, ties to the first in order of name.

Most texts have no unit that reaches the threshold. For each template its
heaviest words (single letters and common words last) are kept as cues until
the rest of its vector is shorter than the threshold; by Cauchy and Schwarz a
text without any cue has no such unit, and one with common cues only has none
unless its words hold enough of some template's vector. Units of other texts
are scored in their row: dot products with all templates first, then, unless a
bound of the norm already says no, the norm. This drops no match, and nothing
is shuffled before the directories are joined.

A licence file (base name LICENSE, LICENCE, COPYING or NOTICE, or a whole text
that is a template) licenses its directory. A file without an own header
takes the licence of its nearest ancestor directory that has one. Ancestors
are joined once for each directory, not for each file.

Defined results: null text has no licence of its own; null path inherits
nothing and has no directory. Of several licence files in a directory the
best score counts, ties to the first name. Repeated rows get the same
result each. An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm.common import Workspace, documents_of

THRESHOLD = 0.6

# Templates by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal public domain dedication."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Whole licence texts, and the notices that long licences ask for in files.
TEMPLATES += [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
# Words of the templates that most texts have; cues last, as they tell least. Their weights are those of all words.
COMMON = {"a", "all", "and", "any", "are", "as", "be", "by", "can", "do", "for", "found", "has", "have", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "under", "use", "with", "work", "you"}
FILES = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
SPLIT = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def model(templates: list[tuple[str, str]], threshold: float) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]], list[str]]:
    """Inverse document frequencies, that of other words, (template, name, word, weight) rows with unit norms, and the cues."""
    bags = [Counter(_words(t)) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows, cues = [], set()
    for k, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        v = {w: n * idf[w] for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda y: (y[0] in COMMON, len(y[0]) == 1, -y[1], y[0])):
            rows.append((k, name, w, x / norm))
            if rest >= (threshold * 0.999) ** 2:
                cues.add(w)
                rest -= (x / norm) ** 2
    return idf, math.log(1 + len(bags)) + 1, rows, sorted(cues)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SPLIT), lambda w: w != "")


def bounds(idf: dict[str, float], rows: list[tuple[int, str, str, float]], rare: set[str], threshold: float) -> Callable[[Column], Column]:
    """Whether the words of a text without a rare cue may hold a unit that reaches the threshold."""
    known = sorted(set(idf) - rare)
    weights = {k: {w: x for j, _, w, x in rows if j == k and w not in rare} for k, *_ in rows}
    weights = {k: v for k, v in weights.items() if sum(x * x for x in v.values()) >= (threshold * 0.999) ** 2}

    def present(words: Column) -> Column:
        share = lambda here, v: reduce(lambda a, b: a + b, [F.when(F.array_contains(here, w), x * x).otherwise(0.0) for w, x in v.items()])
        enough = lambda here: reduce(lambda a, b: a | b, [share(here, v) >= (threshold * 0.999) ** 2 for v in weights.values()])
        return F.element_at(F.transform(F.array(F.array_intersect(words, F.array(*map(F.lit, known)))), enough), 1)

    return present if weights else (lambda words: F.lit(False))


def scores(idf: dict[str, float], other: float, rows: list[tuple[int, str, str, float]], threshold: float) -> Callable[[Column], Column]:
    """Of a unit's words: ``array<struct<low, licence>>`` of the templates whose cosine reaches the threshold, ``low`` its negative.

    The dot product is linear in the term frequencies, so it is a sum over the words as they stand; the norm takes one pass
    over the sorted words, in which the (n + 1)-th word of a run adds (2 n + 1) times its squared weight. So a unit is
    scored in its row, and nothing is shuffled.
    """
    last = max(k for k, *_ in rows)
    names = {k: name for k, name, *_ in rows}
    vectors: dict[str, list[float]] = {}
    for k, _, w, x in rows:
        vectors.setdefault(w, [0.0] * (last + 1))[k] = idf[w] * x
    literal = lambda d, f: F.create_map(*[F.lit(x) if i % 2 == 0 else f(x) for kv in sorted(d.items()) for i, x in enumerate(kv)])
    squares, dots_of = literal({w: x * x for w, x in idf.items()}, F.lit), literal(vectors, lambda v: F.array(*map(F.lit, v)))
    known, zeros = sorted(vectors), F.array(*[F.lit(0.0)] * (last + 1))

    def length(words: Column) -> Column:
        def step(a: Column, w: Column) -> Column:
            n = F.when(a["w"] == w, a["n"]).otherwise(0)
            return F.struct(w.alias("w"), (n + 1).alias("n"), (a["s"] + (2 * n + 1) * F.coalesce(F.try_element_at(squares, w), F.lit(other * other))).alias("s"))

        none = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
        return F.aggregate(F.array_sort(words), none, step, lambda a: F.sqrt(a["s"]))

    def of(words: Column) -> Column:
        once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
        add = lambda own: F.aggregate(own, zeros, lambda a, w: F.zip_with(a, F.element_at(dots_of, w), lambda x, y: x + y))
        low = lambda d, n, k: -F.round(F.get(d, F.lit(k)) / n, 9)
        fit = lambda d: once(length(words), lambda n: F.filter(F.array(*[F.struct(low(d, n, k).alias("low"), F.lit(names[k]).alias("licence")) for k in range(last + 1)]), lambda m: m["low"] <= -threshold))
        none = F.array().cast("array<struct<low:double,licence:string>>")
        # a word that stands n times adds at least n times its squared weight to the norm's square: no need to sort most units
        least = lambda own: F.sqrt(F.lit(other * other) * (F.size(words) - F.size(own)) + F.lit(min(idf.values()) ** 2) * F.size(own))
        return once(F.filter(words, lambda w: w.isin(*known)), lambda own: F.when(F.size(own) == 0, none).otherwise(once(add(own), lambda d: F.when(F.array_max(d) >= threshold * 0.999 * least(own), fit(d)).otherwise(none))))

    return of


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``_uid, licence, score, whole`` of the files (_uid, _text) with a unit that may match, null where none does; ``whole`` if it is the whole text."""
    idf, other, rows, cues = model(templates, threshold)
    rare = [w for w in cues if w not in COMMON]
    cue = F.array(*map(F.lit, rare)).cast("array<string>")
    present = bounds(idf, rows, set(rare), threshold)
    # the words of a text are cut once, and its cues looked up among them
    found = files.select("_uid", "_text").where(F.element_at(F.transform(F.array(_words_of(F.col("_text"))), lambda w: F.arrays_overlap(w, cue) | present(w)), 1))
    parts = F.array_distinct(F.concat(F.split("_text", "\n"), F.split("_text", r"\n[ \t\r]*\n"), F.array("_text")))
    matches = scores(idf, other, rows, threshold)
    fits = F.flatten(F.transform(parts, lambda x: F.transform(F.element_at(F.transform(F.array(_words_of(x)), matches), 1), lambda m: F.struct(m["low"].alias("low"), m["licence"].alias("licence"), (x != F.col("_text")).alias("part")))))
    best = found.select("_uid", F.array_min(fits).alias("b"))  # a filter here would score every unit twice
    return best.select("_uid", F.col("b.licence").alias("licence"), (-F.col("b.low")).alias("score"), (~F.col("b.part")).alias("whole"))


def scan(spark: SparkSession, files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, licence, score, origin, inherited_from`` for each row of ``files`` (doc_id, path, text)."""
    ws = Workspace(spark, "licences")
    base = documents_of(ws, files, F.col("path").cast("string").alias("_path"))
    own = ws.save(own_licences(base, templates, threshold), "own").where("licence is not null")
    names = base.select("_uid", "_id", "_path", directory(F.col("_path")).alias("_dir"))
    j = ws.save(names.join(own, "_uid", "left"), "named")

    grants = j.where(F.col("licence").isNotNull() & F.col("_path").isNotNull() & (F.col("whole") | F.element_at(F.split("_path", "/"), -1).rlike(FILES)))
    grants = grants.groupBy(F.col("_dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("g"))
    # every ancestor of every directory, nearest first
    dirs = j.where("licence is null and _dir is not null").select("_dir").distinct()
    steps = F.split("_dir", "/")
    up = dirs.select("_dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).select("_dir", "depth", F.concat_ws("/", F.slice(steps, 1, F.col("depth"))).alias("above"))
    near = up.join(grants, "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "g")).alias("n"))
    near = near.select(F.col("_dir").alias("_d"), F.col("n.above").alias("_above"), F.col("n.g.licence").alias("_licence"), (-F.col("n.g.low")).alias("_score"))
    near = ws.save(near, "nearest")  # so that the join stands alone and a hot directory can be split
    out = j.join(near, F.col("licence").isNull() & (F.col("_dir") == F.col("_d")), "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("_licence").isNotNull(), "inherited")
    return out.select(F.col("_id").alias("doc_id"), F.col("_path").alias("path"), F.coalesce("licence", "_licence").alias("licence"), F.coalesce("score", "_score").alias("score"), origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("_above")).alias("inherited_from"))
