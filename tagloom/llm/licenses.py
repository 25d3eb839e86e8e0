"""Licence scans by sparse TF-IDF, in native Spark functions.

Lines of a document are compared to the lines of licence templates by the cosine
of their TF-IDF vectors; inverse document frequencies of the templates' words are
counted over all documents, any other word is as rare as a word can be.  A line
can only reach the threshold if words foreign to all templates are few, so that
exact bound prunes lines before any vector is built.

A notice wrapped over lines is found by windows: from every line on, as many words
as a template or standard header has, in one vector.  Whole texts of licences are
compared to whole documents.  A document or a window is only looked at for a template
if the template's words in it carry as much of its norm as the threshold needs, which
is an exact bound too.  A window that holds a line with a match of its own counts if it
scores higher or if such lines are less than half of it.  Lines with an SPDX tag or
that are a licence's title also match.

A document with a match carries that licence itself; whole texts speak before
windows, tags and titles, and these before single lines.  A document most of
whose words lie in matching lines is a licence file and speaks for its directory.
Every other document inherits from the nearest ancestor directory that has a
licence file: directories are resolved once, by joining each with its ancestors,
and documents join their directory.

Defined cases: a null text is empty and matches nothing; equal scores go to the
first template by name; of several licence files in a directory the one with the
best score, then the smallest path, speaks; a null path is the root directory;
rows with equal path and text share one result and all stay; a long text is cut into
lines, its windows are rows of their own; columns of any name pass through, but for those
that the scan adds; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import staged

#: Cosine from which a line matches, and the share of characters that makes a licence file.
THRESHOLD, FILE_SHARE = 0.75, 0.5

# Notices and grants by which public licences are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_APACHE = TEMPLATES[1][1] + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"

# Standard headers and short licences, which are wrapped over lines.
HEADERS = (
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", TEMPLATES[4][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    *[(name, _GNU.format(*of)) for name, *of in (
        ("GPL-2.0", "program", "General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"))],
    *[(name, (_GNU + _GNU_REST).format(*of)) for name, *of in (
        ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"),
        ("AGPL-3.0", "program", "Affero General Public License", "3"))],
    ("MPL-2.0", TEMPLATES[10][1] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_AS_IS),
    ("ISC", TEMPLATES[13][1][:-1] + ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", TEMPLATES[18][1] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

# Lines that are nothing but a licence's title.
TITLES = {"mit license": "MIT", "the mit license": "MIT", "the mit license mit": "MIT", "isc license": "ISC", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause"}
_SPDX = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+()-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+()-]+)*)"

#: What speaks for a document first: whole texts; windows, tags and titles; single lines.
WHOLE, WINDOW, LINE = 0, 1, 2

# Any ASCII character but letters and digits separates words.
_BREAK = r"[\x00-/:-@\[-`{-\x7f]+"


def words_of(text: Column | str) -> Column:
    """Lower-case words; an empty one where a separator begins or ends the text."""
    return F.split(F.lower(text), _BREAK)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.lower()) if w]


def license_texts() -> list[tuple[str, str]]:
    """The whole texts; the Affero licence is the GPL's text under its own name."""
    folder = files("tagloom.llm") / "license_texts"  # also where the package is a zip file
    texts = {p.name.removesuffix(".txt"): p.read_text() for p in sorted(folder.iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}
    gpl = " ".join(texts["GPL-3.0"].split())
    return [*texts.items(), ("AGPL-3.0", re.sub(r"(?i)GNU General Public", "GNU Affero General Public", gpl))]


def _tf(n: int) -> float:
    return 1 + math.log(n)


def _listed(words: list[str]) -> Column:
    """A literal array of words, which hold no spaces."""
    return F.split(F.lit(" ".join(words)), " ")


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` with their lines, as number, characters and words."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda v, i: F.struct(i.alias("line"), F.length(v).alias("chars"), words_of(v).alias("words"), v.alias("value")))
    return docs.select("path", "place", lines.alias("lines"))


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each of the words; the empty word counts all."""
    found = F.array_intersect(words_of(F.coalesce("text", F.lit(""))), _listed(vocabulary))
    words = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("word"))
    return {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}  # as many rows as the vocabulary has words


def scanned(docs: DataFrame, vocabulary: list[str], templates: list[tuple], telling: list[str], threshold: float) -> DataFrame:
    """Per document the lines that can reach the threshold, ``near``, its tags and titles, and the templates that windows can reach, ``may``, with the worded lines.

    With k foreign words (each of the largest weight o) and m other word places,
    the squared share of a line's norm that any template sees is at most
    v / (v + k o^2), where v <= m c o^2 and c bounds (1 + ln n)^2 / n.
    """
    bound = (1 / threshold**2 - 1) * 4 / math.e
    known = F.array(*map(F.lit, ["", *vocabulary]))

    def can_match(line: Column) -> Column:
        foreign = F.size(F.array_except(line["words"], known))
        return foreign <= bound * (F.size(line["words"]) - foreign)

    def named(line: Column) -> Column:
        spdx = F.when(F.contains(line["value"], F.lit("SPDX-License-Identifier:")), F.nullif(F.regexp_extract(line["value"], _SPDX, 1), F.lit("")))
        titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
        return F.coalesce(spdx, F.when(F.size(line["words"]) < 8, titles[F.array_join(F.filter(line["words"], lambda w: w != ""), " ")]))

    worded = _cut(docs).withColumn("found", F.array_distinct(F.flatten("lines.words")))
    may = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("found", _listed(words))) >= need, F.lit(at)) for at, _, _, _, need, _, words in templates]))
    may = F.when(F.arrays_overlap("found", _listed(telling)), may).otherwise(F.array().cast("array<int>"))
    bare = lambda x: F.struct(x["line"], x["chars"], x["words"])
    tags = F.filter(F.transform("lines", lambda x: F.struct(x["line"], x["chars"], named(x).alias("license"))), lambda x: x["license"].isNotNull())
    full = F.transform("lines", lambda x: F.struct(x["line"], x["chars"], F.filter(x["words"], lambda w: w != "").alias("words")))
    rows = worded.select("path", "place", "lines", F.transform(F.filter("lines", can_match), bare).alias("near"), tags.alias("tags"), may.alias("may"))
    return rows.select("path", "place", "near", "tags", "may", F.when(F.size("may") > 0, F.filter(full, lambda x: F.size(x["words"]) > 0)).alias("lines"))


def _least_words(weights: dict[str, float], threshold: float) -> int:
    """How many of a template's words a text must hold at least to reach the threshold."""
    total, need = 0.0, 0
    for part in sorted((x * x for x in weights.values()), reverse=True):
        if total >= threshold**2 - 1e-9:
            break
        total, need = total + part, need + 1
    return need


def _telling(weights: dict[str, float], in_docs: dict[str, int], threshold: float) -> list[str]:
    """The rarest words of a template without all of which a text cannot reach the threshold."""
    total, words = 0.0, []
    for word in sorted(weights, key=lambda w: (in_docs.get(w, 0), w)):
        if total > 1 - threshold**2 + 1e-9:
            break
        total += weights[word] ** 2
        words.append(word)
    return words


def _seen(words: Column) -> Column:
    """The squared share of a template's norm that lies in its words among ``words``."""
    return F.aggregate(F.array_intersect(words, "known"), F.lit(0.0), lambda a, w: a + F.col("shares")[w])


def _near_starts(pairs: DataFrame, threshold: float) -> DataFrame:
    """Windows that may hold enough of a template's norm: path, place, at, start and end, as places among the worded lines.

    A line is a small row here: its place, its words' number and the share of the
    template's norm in its words.  A window has the lines that begin within as many
    words as the template has; their shares together bound the window's.
    """
    share = F.transform("lines", lambda x, i: F.struct((i + 1).alias("i"), F.size(x["words"]).alias("n"), _seen(x["words"]).alias("share")))
    key = ["path", "place", "at"]
    lines = pairs.select(*key, "size", F.inline(share))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("i")) - F.col("n")
    lines = lines.withColumn("pos", before / F.col("size"))  # in template lengths, since a frame's bounds are constants
    reach = Window.partitionBy(*key).orderBy("pos").rangeBetween(Window.currentRow, 1)
    bounded = lines.withColumns({"bound": F.sum("share").over(reach), "end": F.max("i").over(reach)})
    return bounded.where(F.col("bound") >= threshold**2 - 1e-9).select(*key, F.col("i").alias("start"), "end")


def _first_words(held: Column, size: Column) -> Column:
    """The lines that the first ``size`` words touch."""
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    reach = lambda a, x: F.when(a["words"] < size, F.struct((a["words"] + F.size(x["words"])).alias("words"), (a["lines"] + 1).alias("lines"))).otherwise(a)
    return F.slice(held, F.lit(1), F.aggregate(held, none, reach)["lines"])


def matched_windows(rows: DataFrame, templates: list[tuple], parts: DataFrame, weight: DataFrame, rarest: float, threshold: float) -> DataFrame:
    """Windows of ``rows`` that reach the threshold: path, place, at, start, license, rank, score and the lines they touch.

    A document's lines are carried once per template it may hold, and then as rows of
    their own: work and memory grow with the text, not with its square.
    """
    table = F.broadcast(rows.sparkSession.createDataFrame(templates, "at int, license string, rank int, size int, need int, shares map<string, double>, known array<string>"))
    docs = staged(rows.where(F.size("may") > 0).select("path", "place", "lines", "may").dropDuplicates(["path", "place"]), "window-docs")
    pairs = docs.select("path", "place", "lines", F.explode("may").alias("at")).join(table, "at")
    pairs = pairs.where(_seen(F.flatten("lines.words")) >= threshold**2 - 1e-9)
    key = ["path", "place", "at", "start"]
    whole = pairs.where(F.col("rank") == WHOLE).select("path", "place", "at", F.lit(1).alias("start"), F.col("lines").alias("part"), F.flatten("lines.words").alias("words"))

    starts = _near_starts(pairs.where(F.col("rank") != WHOLE), threshold)
    touched = starts.select(*key, F.explode(F.sequence("start", "end")).alias("i"))
    lines = docs.select(F.col("path").alias("_path"), F.col("place").alias("_place"), F.posexplode("lines").alias("_i", "x"))
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("place") == F.col("_place")) & (F.col("i") == F.col("_i") + 1)
    together = F.array_sort(F.collect_list(F.struct("i", "x")))  # of as many lines as the template has words, at most
    windows = touched.join(lines, same).groupBy(*key).agg(F.transform(together, lambda y: y["x"]).alias("part"))
    windows = windows.join(table, "at").withColumn("part", _first_words(F.col("part"), F.col("size")))
    windows = windows.where((F.size("part") > 1) | (F.col("at") >= len(TEMPLATES)))
    windows = windows.select(*key, "part", F.slice(F.flatten("part.words"), F.lit(1), F.col("size")).alias("words"))
    cut = windows.unionByName(whole).join(table, "at").where(_seen(F.col("words")) >= threshold**2 - 1e-9)
    held = F.transform("part", lambda x: F.struct(x["line"], x["chars"], F.size(x["words"]).alias("words")))
    windows = staged(cut.select(*key, "license", "rank", held.alias("held"), "words"), "windows")
    counts = windows.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").count()
    valued = counts.join(F.broadcast(weight), "word", "left").join(F.broadcast(parts), ["at", "word"], "left")  # the templates' words: fixed tables
    valued = valued.withColumn("value", (1 + F.log(F.col("count").cast("double"))) * F.coalesce("idf", F.lit(rarest)))
    score = F.round(F.sum(F.col("value") * F.coalesce("part", F.lit(0.0))) / F.sqrt(F.sum(F.col("value") * F.col("value"))), 9)
    scored = valued.groupBy(*key).agg(score.alias("score")).where(F.col("score") >= threshold)
    scored = scored.select(*[F.col(k).alias(f"_{k}") for k in key], "score")
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("place") == F.col("_place")) & (F.col("at") == F.col("_at")) & (F.col("start") == F.col("_start"))
    return windows.join(scored, same).select(*key, "license", "rank", "score", "held")


def _outside_lines(windows: DataFrame, single: DataFrame) -> DataFrame:
    """The lines of ``windows`` that tell more than the matches of single lines in them."""
    key = ["path", "place", "at", "start"]
    held = windows.select(*key, "license", "rank", "score", F.explode("held").alias("x")).select(*key, "license", "rank", "score", "x.*")
    own = single.select(F.col("path").alias("_path"), F.col("place").alias("_place"), F.col("line").alias("_line"), F.col("score").alias("_score"))
    both = held.join(own, F.col("path").eqNullSafe(F.col("_path")) & (F.col("place") == F.col("_place")) & (F.col("line") == F.col("_line")), "left")
    lines = F.collect_list(F.struct("line", "chars")).alias("lines")
    alone = F.sum(F.when(F.col("_score").isNotNull(), F.col("words")).otherwise(0)).alias("alone")
    whole = both.groupBy(*key, "license", "rank", "score").agg(lines, alone, F.sum("words").alias("words"), F.max("_score").alias("best"))
    more = (F.col("rank") == WHOLE) | F.col("best").isNull() | (F.col("score") > F.col("best")) | (2 * F.col("alone") < F.col("words"))
    return whole.where(more).select("path", "place", F.explode("lines").alias("x"), "license", "score", "rank").select("path", "place", "x.*", "license", "score", "rank")


def matched_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (path, place, text): path, place, line, chars, license, score and rank of each line that matches alone or in a window."""
    texts = license_texts()
    counted = [(name, Counter(template_words(text))) for name, text in (*TEMPLATES, *HEADERS, *texts)]
    n_lines, n_windows = len(TEMPLATES), len(TEMPLATES) + len(HEADERS)
    vocabulary = sorted({w for _, c in counted[:n_lines] for w in c})
    everything = sorted({w for _, c in counted for w in c})
    in_docs = document_counts(docs, everything)
    n = in_docs.get("", 0)
    idf = {w: math.log((1 + n) / (1 + in_docs.get(w, 0))) + 1 for w in everything}
    rarest = math.log(1 + n) + 1
    terms, templates, telling = [], [], set()
    for at, (name, count) in enumerate(counted):
        weights = {w: _tf(c) * idf[w] for w, c in count.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        weights = {w: x / norm for w, x in weights.items()}
        terms += [(at, name, w, x) for w, x in weights.items()]
        templates.append((at, name, WINDOW if at < n_windows else WHOLE, sum(count.values()), _least_words(weights, threshold), {w: x * x for w, x in weights.items()}, sorted(weights)))
        telling.update(_telling(weights, in_docs, threshold))
    rows = staged(scanned(docs, vocabulary, templates, sorted(telling), threshold), "scanned")
    spark = docs.sparkSession
    table = spark.createDataFrame([t for t in terms if t[0] < n_lines], "template int, license string, word string, part double")
    weight = spark.createDataFrame([(w, idf[w]) for w in vocabulary], "word string, idf double")
    at = ["path", "place", "line"]
    lines = rows.select("path", "place", F.explode("near").alias("near")).select("path", "place", "near.*").distinct()
    counts = lines.select(*at, "chars", F.explode("words").alias("word")).where("word <> ''").groupBy(*at, "chars", "word").count()
    valued = counts.join(F.broadcast(weight), "word", "left")  # the templates' words: a fixed table
    valued = valued.withColumn("value", (1 + F.log(F.col("count").cast("double"))) * F.coalesce("idf", F.lit(rarest)))
    valued = staged(valued, "values")
    norms = valued.groupBy(*at, "chars").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(F.broadcast(table), "word").groupBy(*at, "template", "license").agg(F.sum(F.col("value") * F.col("part")).alias("dot"))
    scored = dots.join(norms, at).select(*at, "chars", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("worse"), "license")).alias("best")
    single = scored.groupBy(*at, "chars").agg(best).select(*at, "chars", F.col("best")["license"].alias("license"), (-F.col("best")["worse"]).alias("score"))
    single = staged(single.withColumn("rank", F.lit(LINE)), "single")
    tags = rows.select("path", "place", F.explode("tags").alias("x")).select("path", "place", "x.line", "x.chars", "x.license", F.lit(1.0).alias("score"), F.lit(WINDOW).alias("rank")).distinct()
    parts = spark.createDataFrame([(t[0], *t[2:]) for t in terms], "at int, word string, part double")
    weights = spark.createDataFrame(list(idf.items()), "word string, idf double")
    windows = _outside_lines(matched_windows(rows, templates, parts, weights, rarest, threshold), single)
    every = single.unionByName(tags).unionByName(windows)
    first = F.min(F.struct("rank", (-F.col("score")).alias("worse"), "license")).alias("best")
    return every.groupBy(*at, "chars").agg(first).select(*at, "chars", F.col("best")["license"].alias("license"), (-F.col("best")["worse"]).alias("score"), F.col("best")["rank"].alias("rank"))


def directory_of(path: Column) -> Column:
    """The directory of a path; the root is the empty text."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def inherited(directories: DataFrame, files: DataFrame) -> DataFrame:
    """For each directory the licence of the nearest directory at or above it that has a licence file."""
    levels = F.sequence(F.lit(0), F.size(F.split("directory", "/")))
    above = directories.select("directory", F.explode(levels).alias("level"))
    above = above.withColumn("ancestor", F.expr("substring_index(directory, '/', level)")).distinct()
    best = F.min(F.struct((-F.col("score")).alias("worse"), "path", "license")).alias("best")
    speaking = files.groupBy(F.col("directory").alias("ancestor")).agg(best)
    nearest = F.max_by(F.struct("ancestor", "best"), "level").alias("nearest")
    found = above.join(speaking, "ancestor").groupBy("directory").agg(nearest)
    return found.select("directory", F.col("nearest.best.license").alias("inherited"), F.col("nearest.best.path").alias("inherited_from"))


def scan(docs: DataFrame, *, path: Column, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``license``, ``license_score``, ``license_by`` (header, file or directory) and ``license_from`` (a path).

    Columns of ``docs`` with these names are replaced.
    """
    added = ("license", "license_score", "license_by", "license_from")
    kept = [c for c in docs.columns if c != text and c not in added]
    keyed = docs.select(path.cast("string").alias("_path"), F.xxhash64(text).alias("_place"), F.col(text).alias("_text"), F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"))
    lines = staged(matched_lines(keyed.select(F.col("_path").alias("path"), F.col("_place").alias("place"), F.col("_text").alias("text")), threshold), "matched")
    own = lines.groupBy("path", "place").agg(F.sum("chars").alias("matched"), F.min(F.struct("rank", (-F.col("score")).alias("worse"), "line", "license")).alias("best"))
    own = own.select(
        F.col("path").alias("_own_path"),
        F.col("place").alias("_own_place"),
        F.col("matched").alias("_matched"),
        F.col("best")["license"].alias("_own"),
        (-F.col("best")["worse"]).alias("_score"),
    )
    sized = keyed.withColumns({"_chars": F.length("_text"), "_directory": directory_of(F.col("_path"))}).drop("_text")
    same = sized["_path"].eqNullSafe(own["_own_path"]) & (sized["_place"] == own["_own_place"])
    is_file = F.coalesce(F.col("_matched") >= FILE_SHARE * F.col("_chars"), F.lit(False))
    known = staged(sized.join(own, same, "left").withColumn("_file", is_file), "own")
    speaking = known.where("_file").select(
        F.col("_directory").alias("directory"), F.col("_path").alias("path"), F.col("_own").alias("license"), F.col("_score").alias("score")
    )
    above = inherited(known.select(F.col("_directory").alias("directory")).distinct(), speaking)
    above = above.select(*[F.col(c).alias(f"_{c}") for c in above.columns])
    by = F.when(F.col("_file"), "file").when(F.col("_own").isNotNull(), "header").when(F.col("_inherited").isNotNull(), "directory")
    return known.join(above, "_directory", "left").select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        F.coalesce("_own", "_inherited").alias("license"),
        F.col("_score").alias("license_score"),
        by.alias("license_by"),
        F.when(F.col("_own").isNotNull(), F.col("_path")).otherwise(F.col("_inherited_from")).alias("license_from"),
    )
