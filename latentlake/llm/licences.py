"""Operator 6: licence scans by sentence rules, in DataFrame functions alone.

Texts are cut into sentences (at line ends, and at ``.!?;:`` before white space) and normalised: lower case, every run of other characters than
a-z and 0-9 is one space. Normalised sentences are joined to known licence sentences, which gives identifiers; a rule is an ordered list of
identifiers. A known sentence may also be wrapped: the pieces of several lines in a row, with or without comment signs, are it if their words
are; it cannot run on beyond ``.!?;:``. Of a rule's sentences in a document, neighbours in text order must be the rule's
sentences in its order, at most ``GAP`` pieces with words apart from the end of one to the start of the next. A match inside a longer one of the same
licence, or of one that extends it, is left out.

Only texts with a marker word are cut; each known sentence contains one. The sentence table is a constant of the library.

Defined cases: null and empty texts match nothing; rows with one doc_id and text count once; a null doc_id is kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, read, typed

GAP = 3
#: The same cuts as at ``[.!?;:]+[ \t\r\n]+|[\r\n]+``, but a piece keeps its punctuation.
SENTENCE_END = r"(?<=[.!?;:])[ \t\r\n]+|[\r\n]+"
MARKERS = ("licen", "copyright", "warrant", "permission", "redistribut", "liab", "free software")

# fixed values: names under which licences are cited, by SPDX identifier
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Zlib": ("zlib License",),
}
CC_PARTS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CITED = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Published under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.", "Available under {}.")

# fixed values: the wording of common notices
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software:",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
}
#: Notices that the SQL does not have.
MORE_NOTICES = {
    "BSD-3-Clause": [
        *NOTICES["BSD-2-Clause"],
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
}
#: Licences the notices of which begin with another's.
EXTENDS = {"BSD-3-Clause": "BSD-2-Clause"}


def plain(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in sentence)).strip()


def rules(notices: dict[str, list[str]] = NOTICES | MORE_NOTICES) -> list[tuple[str, str, list[str]]]:
    """(rule, licence, normalised sentences in order)."""
    cited = {k: list(v) for k, v in NAMES.items()}
    for part in CC_PARTS:
        for v in CC_VERSIONS:
            cited[f"CC-{part}-{v}"] = [f"CC {part} {v}", f"Creative Commons {part} {v}"]
    cited["CC0-1.0"] = ["CC0 1.0", "CC0 1.0 Universal"]
    out, seen = [], set()
    for licence, names in cited.items():
        lines = {plain(t.format(f"{the}{name}")) for t in CITED for name in names for the in ("", "the ")} | {plain(f"SPDX-License-Identifier: {licence}"), plain(f"License: {licence}")}
        for line in sorted(lines - seen):
            seen.add(line)
            out.append((f"{licence}/cited/{line}", licence, [line]))
    out += [(f"{licence}/notice", licence, [plain(s) for s in sentences]) for licence, sentences in notices.items()]
    return out


def markers() -> list[str]:
    """Words of which each first sentence of a rule contains one."""
    rest = [s for _, _, sentences in rules() for s in sentences[:1] if not any(m in s for m in MARKERS)]
    return list(dict.fromkeys([*MARKERS, *(max(s.split(), key=len) for s in rest)]))


def _steps(found: list[tuple[str, str, list[str]]]) -> list[tuple[str, str, str, int, int]]:
    return [(s, rule, licence, i, len(sentences)) for rule, licence, sentences in found for i, s in enumerate(sentences)]


def _sentences(rows: DataFrame, known: DataFrame, longest: int, most: int) -> DataFrame:
    """(doc_id, of, place, last, nth, nth_last, sentence) of every known sentence: the first and the last piece that hold it, among all pieces and among those with words."""
    plain_words = lambda x: F.substring(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), 1, longest + 2)
    pieces = rows.select("doc_id", "of", F.split("text", SENTENCE_END).alias("raw"))
    pieces = pieces.select("doc_id", "of", F.transform("raw", lambda x, i: F.struct(plain_words(x).alias("piece"), i.alias("place"), x.rlike("[.!?;:]$").alias("ends"))).alias("raw"))
    pieces = pieces.select("doc_id", "of", F.filter("raw", lambda x: x["piece"] != "").alias("p"))

    def tail(x, i):
        """Of a line that does not end a sentence: its words and those of the lines after it, one line end between lines, and their places."""
        run = F.slice("p", i + 1, _lines(F.slice("p", i + 1, most)))
        return F.when(~x["ends"], F.struct(F.substring(F.array_join(run["piece"], "\n"), 1, longest + 1).alias("tail"), run["place"].alias("places")))

    pieces = pieces.select("doc_id", "of", F.posexplode(F.transform("p", lambda x, i: F.struct(x["piece"].alias("piece"), x["place"].alias("place"), tail(x, i).alias("run")))).alias("nth", "p"))
    pieces = pieces.select("doc_id", "of", "nth", "p.piece", "p.place", "p.run.tail", "p.run.places")
    words = F.split("sentence", " ")
    begins = known.select(
        F.col("sentence").alias("whole"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("begin"),
    )
    joined = pieces.join(F.broadcast(begins), F.col("piece") == F.col("begin"))
    n = F.length("whole")
    wrapped = F.col("tail").isNotNull() & (F.translate(F.substring("tail", F.lit(1), n), "\n", " ") == F.col("whole")) & F.substring("tail", n + 1, F.lit(1)).isin("", "\n")
    one = F.col("piece") == F.col("whole")
    lines = F.when(one, 0).otherwise(F.length(F.regexp_replace(F.substring("tail", F.lit(1), n), "[^\n]", "")))
    found = joined.where(one | wrapped).withColumn("lines", lines)
    last = F.when(F.col("lines") == 0, F.col("place")).otherwise(F.get("places", F.col("lines")))
    return found.select("doc_id", "of", "place", last.alias("last"), "nth", (F.col("nth") + F.col("lines")).alias("nth_last"), F.col("whole").alias("sentence"))


def _lines(pieces: Column) -> Column:
    """Lines up to the first that ends a sentence."""
    first = F.array_position(pieces["ends"], F.lit(True)).cast("int")
    return F.when(first > 0, first).otherwise(F.size(pieces))


def licence_matches(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """(doc_id, licence, rule, first_sentence, last_sentence) of every match in ``docs`` (doc_id, text); sentences count from 0."""
    known = _steps(rules())
    steps = docs.sparkSession.createDataFrame(known, "sentence string, rule string, licence string, step int, steps int")
    rows = typed(docs, doc_id="long", text="string")
    lower = F.lower("text")
    marked = F.lit(False)
    for m in markers():
        marked = marked | F.contains(lower, F.lit(m))
    rows = rows.where(marked).select("doc_id", "text", F.xxhash64("text").alias("of"))
    sentences = _sentences(rows, steps.select("sentence").distinct(), max(len(x[0]) for x in known), max(len(x[0].split()) for x in known))
    hits = sentences.join(F.broadcast(steps), "sentence").dropDuplicates(["doc_id", "of", "rule", "place", "step"])
    order = Window.partitionBy("doc_id", "of", "rule").orderBy("place")
    far = (F.col("nth") - F.lag("nth_last").over(order) > gap).cast("int")
    chained = hits.withColumns({"number": F.row_number().over(order), "cut": F.coalesce(far, F.lit(0))}).withColumn("cuts", F.sum("cut").over(order))
    found = (
        chained.groupBy("doc_id", "of", "rule", "licence", "steps", (F.col("number") - F.col("step")).alias("chain"), "cuts")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_sentence"), F.max("last").alias("last_sentence"))
        .where(F.col("n") == F.col("steps"))
    )
    extended = F.lit(None).cast("string")
    for licence, part in EXTENDS.items():
        extended = F.when(F.col("licence") == licence, part).otherwise(extended)
    long = found.where("steps > 1").withColumn("l", F.explode(F.array_compact(F.array("licence", extended)))).select(F.col("doc_id").alias("d"), F.col("of").alias("o"), "l", F.col("steps").alias("s"), F.col("first_sentence").alias("a"), F.col("last_sentence").alias("b"))
    inside = (
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")) & (F.col("licence") == F.col("l"))
        & (F.col("s") > F.col("steps")) & (F.col("a") <= F.col("first_sentence")) & (F.col("b") >= F.col("last_sentence"))
    )
    return found.join(long, inside, "left_anti").select("doc_id", "licence", "rule", "first_sentence", "last_sentence")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quoted(s)}, {quoted(r)}, {quoted(x)}, {i}, {n})" for s, r, x, i, n in _steps(rules(NOTICES)))
    return f"""
    WITH steps(sentence, rule, licence, step, steps) AS (VALUES {values}),
    parts AS (
      SELECT DISTINCT doc_id, text, regexp_split_to_array(text, '[.!?;:]+[ \\t\\r\\n]+|[\\r\\n]+') AS s FROM documents
    ),
    cut AS (SELECT doc_id, text, unnest(s) AS raw, generate_subscripts(s, 1) - 1 AS place FROM parts),
    hits AS (
      SELECT doc_id, text, place, rule, licence, step, steps FROM cut
      JOIN steps ON sentence = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))
    ),
    ranked AS (
      SELECT *, row_number() OVER w AS nth, CASE WHEN place - lag(place) OVER w > {GAP} THEN 1 ELSE 0 END AS cut
      FROM hits WINDOW w AS (PARTITION BY doc_id, text, rule ORDER BY place)
    ),
    chained AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, text, rule ORDER BY place) AS cuts FROM ranked),
    found AS (
      SELECT doc_id, text, rule, licence, steps, min(place) AS first_sentence, max(place) AS last_sentence
      FROM chained GROUP BY doc_id, text, rule, licence, steps, nth - step, cuts HAVING count(*) = steps
    )
    SELECT doc_id, licence, rule, CAST(first_sentence AS INTEGER) AS first_sentence, CAST(last_sentence AS INTEGER) AS last_sentence
    FROM found f WHERE NOT EXISTS (
      SELECT 1 FROM found g WHERE g.doc_id IS NOT DISTINCT FROM f.doc_id AND g.text = f.text AND g.licence = f.licence
        AND g.steps > f.steps AND g.first_sentence <= f.first_sentence AND g.last_sentence >= f.last_sentence
    )
    """


@query("op6_licence_scan", _sql())
def op6(spark, sf):
    return licence_matches(read(spark, sf, "documents"))
