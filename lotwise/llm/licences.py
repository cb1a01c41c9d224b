"""License scans: sparse TF-IDF cosines of a file's lines, its blocks of lines and its whole text to templates, and
inheritance from the nearest ancestor directory with a licence file; DataFrame and SQL functions only.

A term counts (1 + ln occurrences) times its inverse document frequency over all files. The space has the templates'
vocabulary and one dimension for each other word, which counts as a word of no file does, with the largest frequency
weight. Templates are whole licences, the notices that stand at the head of files, and the short forms in which
others name a licence. A file's own licence is the best of its units. A file that is a licence text, or most of whose
words are of one unit that is, is a licence file of its directory; files without a licence of their own take that of
the nearest directory above them that has one, found by joining paths.

Only units with a cue are scored, which loses none: of each template the terms of least weight, as many as together
stay under ``least`` squared of its squared length, are no cues. By the Cauchy-Schwarz inequality a unit that shares
none but these has a cosine under ``least``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.shared import sent, written

# Public licence texts; the longer ones are in the folder licence_texts.
_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_GRANT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_2 = """
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_APACHE_GRANT = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""


def _gnu(program: str, name: str, version: str) -> tuple[str, str]:
    """The notice of the GNU licences: its first paragraph, and all of it."""
    grant = f"""
This {program} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."""
    rest = f"""
This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {program}. If not, see https://www.gnu.org/licenses/."""
    return grant, grant + rest


#: Licence: its short forms and notices. Whole texts of licences.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE_GRANT, _APACHE_GRANT + _APACHE_REST),
    "BSD-2-Clause": (_BSD_GRANT + _BSD_2 + _AS_IS,),
    "BSD-3-Clause": (_BSD_GRANT, _BSD_GRANT + _BSD_2 + _BSD_3 + _AS_IS),
    "CC-BY-4.0": ("Licensed under the Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("program", "General Public License", "3")),
    "ISC": (_ISC,),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("library", "Lesser General Public License", "3")),
    "MIT": ("Released under the MIT License.", _MIT_GRANT, _MIT_GRANT + _MIT_REST),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.",),
}
WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
#: What stands beside licences as well: it counts where no other licence is found.
RESERVED = "Proprietary"
#: The least cosine of a match, and the least share of a file's words in its matching unit for a licence file.
LEAST_COSINE, FILE_SHARE = 0.75, 0.5
TERM = "[a-z0-9]+(?:\\.[0-9]+)*"


@cache
def templates() -> dict[str, tuple[str, ...]]:
    """Licence: all its forms, the whole texts among them."""
    own = Path(__file__).with_name("licence_texts")
    return {k: (*NOTICES.get(k, ()), *([(own / f"{k}.txt").read_text()] if k in WHOLE else [])) for k in sorted({*NOTICES, *WHOLE})}


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def terms_of(low: Column) -> Column:
    """The words and version numbers of lower-case text."""
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _counted(df: DataFrame, terms: str, out: str) -> DataFrame:
    """Adds array<struct<term, n>> of each distinct term of an array and its occurrences, by sorting the array."""
    df = df.withColumn("_sorted", F.sort_array(terms))
    n = F.size("_sorted")
    new = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("_sorted", i) != F.element_at("_sorted", F.greatest(i - 1, F.lit(1)))))
    df = df.withColumn("_at", F.when(n > 0, new).otherwise(F.array().cast("array<int>")))
    runs = F.transform("_at", lambda p, j: F.struct(F.element_at("_sorted", p).alias("term"), (F.coalesce(F.get("_at", j + 1), n + 1) - p).alias("n")))
    return df.withColumn(out, runs).drop("_sorted", "_at")


def _damped(n: Column) -> Column:
    return 1 + F.log(n.cast("double"))


def weights(files: DataFrame, text: str, forms: Mapping[str, Sequence[str]]) -> tuple[DataFrame, float]:
    """((form, licence, term, idf, tw), the frequency weight of a word of no file): idf over all files, tw of unit length in each form."""
    spark = files.sparkSession
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, v in sorted(forms.items()) for t in v)]
    listed = F.array(*[F.struct(F.lit(i).alias("form"), F.lit(k).alias("licence"), F.lit(t).alias("t")) for i, k, t in rows])
    if not rows:
        listed = listed.cast("array<struct<form:int,licence:string,t:string>>")
    t = spark.range(1).select(F.explode(listed).alias("x")).select("x.form", "x.licence", F.explode_outer(terms_of(F.lower("x.t"))).alias("term"))
    t = written(t.groupBy("form", "licence", "term").agg(F.count("*").alias("n")), "licence-terms")
    # Outer, as of others the optimizer also asks whether they are empty, by doing the work twice.
    found = files.select(F.explode_outer(F.array_distinct(terms_of(lowered(F.col(text))))).alias("term"))
    df = found.join(F.broadcast(t.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))  # terms of templates only
    n = files.count()
    idf = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    t = t.join(df, "term", "left").select("form", "licence", "term", idf.alias("idf"), (_damped(F.col("n")) * idf).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("form")))
    t = t.select("form", "licence", "term", "idf", (F.col("w") / length).alias("tw"))
    return written(t, "licence-weights"), F.log(F.lit(n + 1.0)) + 1


def cues(weighted: DataFrame, least: float) -> list[str]:
    """The terms of which a unit of cosine ``least`` or more to any form has at least one."""
    square = F.col("tw") * F.col("tw")
    upto = F.sum(square).over(Window.partitionBy("form").orderBy("tw", "term").rowsBetween(Window.unboundedPreceding, 0))
    # As many as there are words in the templates at most.
    return sorted(r[0] for r in weighted.withColumn("upto", upto).filter(F.col("upto") >= least * least - 1e-9).select("term").distinct().collect())


def units_of(files: DataFrame, text: str, path: str, cue: Sequence[str]) -> DataFrame:
    """(uid, path, whole, share, terms) of every line, block of lines and whole text that has a cue.

    share: the unit's words of the file's. Blocks are parted by blank lines. A narrow pass: uid is the same when it is
    made again.
    """
    has = lambda terms: F.arrays_overlap(terms, F.array(*map(F.lit, cue)))
    m = files.select(F.col(path).alias("path"), lowered(F.col(text)).alias("low")).withColumn("words", terms_of(F.col("low"))).filter(has("words"))
    parts = F.array_except(F.concat(F.split("low", "\\r?\\n(?:[ \\t]*\\r?\\n)+"), F.split("low", "[\\r\\n]+")), F.array("low"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("low").alias("unit")))
    m = m.select("path", F.size("words").alias("total"), F.explode_outer(F.concat(whole, F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))).alias("u"))
    m = m.select("path", "total", "u.whole", terms_of(F.col("u.unit")).alias("terms")).filter(has("terms"))
    return m.select(F.monotonically_increasing_id().alias("uid"), "path", "whole", (F.size("terms") / F.col("total")).alias("share"), "terms")


def cosines(units: DataFrame, weighted: DataFrame, most: Column) -> DataFrame:
    """(uid, path, whole, share, licence, cosine): the best form of each unit, by cosine, then by name.

    The forms' weights are one broadcast table with a column a form. Words meet it where they are and are added up
    there: only one row of sums a unit is shuffled.
    """
    forms = [tuple(r) for r in weighted.select("form", "licence").distinct().orderBy("form").collect()]
    table = weighted.groupBy("term").agg(F.first("idf").alias("idf"), *[F.sum(F.when(F.col("form") == i, F.col("tw")).otherwise(0.0)).alias(f"t{i}") for i, _ in forms])
    words = _counted(units, "terms", "x").select("uid", "path", "whole", "share", F.explode_outer("x").alias("x")).select("uid", "path", "whole", "share", "x.term", "x.n")
    w = (_damped(F.col("n")) * F.coalesce("idf", most)).alias("w")
    words = words.join(F.broadcast(table), "term", "left").select("uid", "path", "whole", "share", w, *[f"t{i}" for i, _ in forms])
    sums = words.groupBy("uid", "path", "whole", "share").agg(F.sum(F.col("w") * F.col("w")).alias("square"), *[F.sum(F.col("w") * F.col(f"t{i}")).alias(f"d{i}") for i, _ in forms])
    best = F.array_max(F.array(*[F.struct(F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.sqrt("square"), 9).alias("cosine"), F.lit(k).alias("licence")) for i, k in forms]))
    return sums.withColumn("best", best).select("uid", "path", "whole", "share", "best.licence", "best.cosine")


def _directory(path: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(path), F.lit("")), "/?[^/]*$", "")


def scan(files: DataFrame, text: str = "text", path: str = "path", forms: Mapping[str, Sequence[str]] | None = None, least: float = LEAST_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """(path, licence, origin, cosine, licence_dir) of every file; origin is 'own', 'inherited' or 'none'.

    Parts of a path are separated by '/'; a null path is one file of the root, apart from ''. Rows of one path are
    one file: each gets the best licence of any of them. The best licence, of a file and of several licence files of a
    directory, is the one with the largest cosine, then the last name; 'all rights reserved' comes after any other. Texts that are null or empty have no licence of their own and count
    as files in document frequencies. Inheritance joins distinct directories, not files, with the directories above.
    """
    weighted, most = weights(files, text, templates() if forms is None else forms)
    known = cues(weighted, least)
    if not known:
        return files.select(F.col(path), F.lit(None).cast("string").alias("licence"), F.lit("none").alias("origin"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("string").alias("licence_dir"))
    found = cosines(units_of(files, text, path, known), weighted, most).filter(F.col("cosine") >= least)
    as_file = (F.col("whole") | (F.col("share") >= file_share)).cast("int")
    rated = F.struct((F.col("licence") != RESERVED).alias("granted"), "cosine", "licence")
    own = found.groupBy("path").agg(F.max(rated).alias("x"), F.max(F.when(as_file == 1, rated)).alias("f"))
    own = written(own.select(F.col("path").alias("own_path"), "x.licence", "x.cosine", F.col("f").alias("as_file")), "licences")
    at = own.filter("as_file is not null").groupBy(_directory("own_path").alias("licence_dir")).agg(F.max("as_file").alias("x")).select("licence_dir", F.col("x.licence").alias("dir_licence"), F.col("x.cosine").alias("dir_cosine"))
    rows = files.select(F.col(path).alias("path"), _directory(path).alias("dir"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = rows.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "licence_dir")).join(at, "licence_dir")
    nearest = up.groupBy("dir").agg(F.max_by(F.struct("licence_dir", "dir_licence", "dir_cosine"), "depth").alias("near")).select("dir", "near.*")
    # Depth 0 and a path of one part both name the root once; max_by takes either.
    rows = rows.join(sent(own.drop("as_file")), F.col("path").eqNullSafe(F.col("own_path")), "left").join(sent(written(nearest, "nearest")), "dir", "left")
    mine = F.col("licence").isNotNull()
    return rows.select(
        F.col("path").alias(path),
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(mine, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("cosine", "dir_cosine").alias("cosine"),
        F.when(~mine, F.col("licence_dir")).alias("licence_dir"),
    )


def file_path() -> Column:
    """Documents as files: source/lang/hundred/doc_id; what is null is 'none'."""
    part = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    return F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 100)), part(F.col("doc_id")))


def op9_licence_tfidf(spark, sf_dir: str) -> DataFrame:
    """A row a document; rows of one id, language and source are one file, and a null id stays null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(file_path().alias("path"), "text")
    return scan(docs).select(F.element_at(F.split("path", "/"), -1).try_cast("long").alias("doc_id"), "path", "licence", "origin", "cosine", "licence_dir")
