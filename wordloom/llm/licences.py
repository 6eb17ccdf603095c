"""Licence scan by canonical digest lookup.

A text becomes its canonical form: A-Z in lower case, copyright lines and a title dropped, punctuation
to spaces, equivalent spellings to one of them. The SHA-256 of the form is joined to the digests of
known licences, for whole texts and for single lines, where notices stand.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and customary notices.
KNOWN_LICENCES: dict[str, list[str]] = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# SHA-256 of the canonical forms of published licence texts, whole.
PUBLISHED_DIGESTS: dict[str, str] = {
    "Apache-2.0": "59c5c0c961f9e12781a624dab402e5d06931dc04529b068489fdb15fe330f0e2",
    "Artistic-1.0-Perl": "68b9dd49ed1b1348e977ccc2468570a603d8075ede45354e352319821ca5469a",
    "BSD-3-Clause": "481fcd9d007056b7809322c536d09d5f021334ccf6c013607eb2ed218774d076",
    "CC0-1.0": "5caa6b96e2c9f66e9ca02d726096312a8662a9c4fea6446ff24fee66902e58dc",
    "GFDL-1.2": "e9d37f1af9e55d1b29718ff0dd4e2583340a45ba56c062b54ac2bffa6b9184ac",
    "GFDL-1.3": "6fbbb28d155387ad69422adfd39ef7b89fc749edfdf997c7dd351c6158bd2298",
    "GPL-1.0": "369f57bee7b7b48d1dba46146a41780f056529a15e980c4d6843f83a58fcc2da",
    "GPL-2.0": "f75a1d6b2af9538af59deeb4d742cc70c58d0b8d134778479f26ecbd851b392f",
    "GPL-3.0": "1762992c0f76994ca6cd4de78ffa1345f8e322e1a230f87cf23660dac7bf8314",
    "LGPL-2.0": "4921f4e1e5e73369d202e5c7683c965b4d275ba35f23c50d389e92705d9cc84e",
    "LGPL-2.1": "a65b75d251fb56c535ec7079440f5d167ec95725dd20f1d16677176defe487a3",
    "LGPL-3.0": "572947626844a56d29ace510237040204d4085696621f319533ca366aa897913",
    "MPL-1.1": "c82025ba8cfd426ed63ef8ac3ca725370923a0896aab6940821e727fd8e13318",
    "MPL-2.0": "81d77b1d77de764ed772965a190a4d3b865a7caf68e77db4e707c01076bb6785",
}

# Fixed values: (spelling, canonical spelling), after the equivalent words of the SPDX matching guidelines.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("labour", "labor"),
    ("programme", "program"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("noncommercial", "non-commercial"),
    ("copyright-owner", "copyright-holder"),
    ("percent", "per-cent"),
]

#: Running text in which a line may begin with the word; any other word after it begins a holder's name.
_RUNNING = (
    r"(?:notices?|holders?|owners?|ownership|laws?|licen[cs]e[ds]?|licen[cs]ors?|statements?|acts?|treat(?:y|ies)|protection|interests?|infringements?"
    r"|claims?|disclaimers?|information|rights?|grants?|terms?|status|lines?|permissions?|materials?|works?|and|or|in|is|it|on|of|to|for|as|at|that"
    r"|this|these|which|with|under|from|may|shall|must|will|can|are|was|were|has|have|not|if|unless|except|applies)\b"
)
_MARK = r"(?:\(c\)|©|&copy;)"
NOTICE = (
    r"^[ \t*#/;-]*(?:copyright[ \t:,.-]*(?:" + _MARK + r"|[0-9]{4})|copyright[ \t]+(?!" + _RUNNING + r")[^ \t\r\n,;.]|copyright:[ \t]*(?!" + _RUNNING + r")[^ \t\r\n]"
    r"|" + _MARK + r"[ \t:,.-]*(?:copyright\b|by\b|[0-9]{4})|©|all[ \t]+rights[ \t]+reserved[ \t:,.]*(?:\r?$|copyright\b|" + _MARK + r"|[0-9]{4}))"
)
#: The name of a licence on the first line, with text after it.
TITLE = r"\A[\s*#/;=-]*(?:the[ \t]+)?(?:mit|expat|isc)[ \t]+licen[cs]e(?:[ \t]*\([a-z0-9/ ]*\))?[ \t:*#/;=-]*\r?\n(?=\s*\S)"
#: Copyright lines as the SQL has them: it also drops lines of running text that begin with the word, and knows no titles.
COPYRIGHT = r"^[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[ :,.0-9©(-]"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—©]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty. Spellings are looked for at once, and only texts that have one go through them."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    low = F.regexp_replace(low, "(?md)" + NOTICE + r"[^\n]*", " ")
    low = F.regexp_replace(low, TITLE, " ")
    low = F.concat(F.lit(" "), F.regexp_replace(low, PUNCTUATION, "  "), F.lit(" "))
    spelt = low
    for word, to in _pairs():
        spelt = F.replace(spelt, F.lit(word), F.lit(to))
    return F.trim(F.when(low.rlike(" (?:" + "|".join(a.strip() for a, _ in _pairs()) + ") "), spelt).otherwise(low))


def canonical_text(text: str) -> str:
    """As canonical, for a known text."""
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    low = re.sub(NOTICE + r"[^\n]*", " ", low, flags=re.M)
    low = re.sub(TITLE, " ", low)
    low = " " + re.sub(PUNCTUATION, "  ", low) + " "
    for a, b in _pairs():
        low = low.replace(a, b)
    return low.strip(" ")


def _pairs() -> list[tuple[str, str]]:
    """Spellings as they stand after punctuation: words between single spaces of their own."""
    return [(f" {a.replace('-', '  ')} ", f" {b.replace('-', '  ')} ") for a, b in SPELLINGS]


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence) of the known texts, each in the same canonical form, and of the published texts of which only digests are kept."""
    found = {d: name for name, d in PUBLISHED_DIGESTS.items()}
    for name, texts in KNOWN_LICENCES.items():
        for text in texts:
            found.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return sorted(found.items())


def line_words() -> list[str]:
    """A word for each known text, of which no spelling is known: a line that is the text has it in any case."""
    spelt = {w for pair in SPELLINGS for x in pair for w in x.split("-")}
    one = {max((w for w in canonical_text(t).split() if w not in spelt), key=lambda w: (len(w), w)) for texts in KNOWN_LICENCES.values() for t in texts if "\n" not in t}
    return sorted(one)


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, digest, licence, n_notices, notices) for every row of docs (doc_id, text).

    digest: of the whole text's canonical form (null text: as empty); licence: the known one with that
    digest, else null; n_notices: lines that are a known text of one line; notices: their licences, each
    once, sorted, comma-joined, '' without any. known: (digest, licence) rows, a fixed list of a few dozen
    entries, with which every line is looked up; without it, the lines that have a word of some known text, as all others can't be one.
    Other columns are ignored; rows given twice come out twice; null ids stay null; no rows, none out.
    """
    own = known is None
    known = known_digests() if own else known
    table = docs.sparkSession.createDataFrame(known, "known_digest string, licence string")
    names = F.create_map(*(F.lit(x) for pair in known for x in pair)) if known else F.create_map().cast("map<string,string>")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    if own:
        lines = F.filter(lines, lambda x: x.rlike("(?i)" + "|".join(line_words())))
    hits = F.filter(F.transform(lines, lambda x: F.element_at(names, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    scanned = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), hits.alias("hits"))
    return scanned.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left").select(
        "doc_id",
        "digest",
        "licence",
        F.size("hits").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"),
    )


def licences_sql() -> str:
    """DuckDB SQL of scan_licences over documents."""

    def form(x: str) -> str:
        low = f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}')"
        low = f"regexp_replace({low}, '(?m){COPYRIGHT}[^\\n]*', ' ', 'g')"
        low = f"' ' || regexp_replace({low}, '{PUNCTUATION}', '  ', 'g') || ' '"
        for a, b in _pairs():
            low = f"replace({low}, '{a}', '{b}')"
        return f"trim({low}, ' ')"

    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"""
WITH known(known_digest, licence) AS (VALUES {values}),
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM rows),
hits AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM lines JOIN known ON sha256({form('line')}) = known_digest GROUP BY r
),
whole AS (SELECT r, doc_id, sha256({form('text')}) AS digest FROM rows)
SELECT doc_id, digest, licence, coalesce(n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON digest = known_digest LEFT JOIN hits USING (r)
"""
