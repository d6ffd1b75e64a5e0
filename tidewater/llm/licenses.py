"""Licence scan by canonical digests, in DataFrame functions.

A text is brought to a canonical form: lines that claim a copyright go, letters
become small, whatever isn't a letter or digit becomes a single blank, and
spelling variants become one.  The SHA-256 of that form is joined with the digests of
known licences, so a document is a licence if its entire text is one, whatever
its layout, year or holder.  Single lines are matched with known notices the
same way.

Defined cases: a null or blank text has the digest of the empty form and is no
licence; texts of any length are digested whole; repeated rows are looked up
each; a known text listed twice counts once (the first name in order); an empty
table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, written

#: Spellings that licences use for one another, as they look
#: when punctuation is gone.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("copyright holder", "copyright owner"), ("non commercial", "noncommercial"),
             ("whilst", "while"), ("wilful", "willful"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"),
             ("redistributions", "redistribution"), ("https ", "http "), ("per cent", "percent")]
COPYRIGHT = r"^[^\n]{0,20}(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}|by[ \t])[^\n]*$"

#: Texts of short public licences and the usual notices.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null becomes empty."""
    c = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?imd){COPYRIGHT}", " "))
    c = F.btrim(F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license): one row per known canonical form."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, body string")
    return rows.where(F.length(canonical(F.col("body"))) > 0).groupBy(digest(F.col("body")).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, digest, license (of the entire text, null if none),
    notices (the licences of its lines that are known texts, in order of their
    names, comma-joined).

    ``known`` is counted: up to ``BROADCAST_ROWS`` rows are broadcast, so that
    no text moves; a larger table is joined by a shuffle of narrow rows.  Every
    line with a letter or digit is looked up the same way, whatever the size
    of ``known``; what is found is joined back by the digest of the raw text.
    """
    n = known.count()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("raw"))
    lines = rows.select("raw", F.explode(F.array_distinct(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))).alias("line"))
    lines = lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("raw", digest(F.col("line")).alias("digest"))
    hits = attach(lines, known, "digest", F.col("raw"), n).where(F.col("license").isNotNull())
    notices = written(hits.groupBy("raw").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")))
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), "raw")
    rows = attach(rows, notices, "raw", F.col("doc_id")).withColumn("notices", F.coalesce(F.col("notices"), F.lit("")))
    side = F.broadcast(known) if n <= BROADCAST_ROWS else known
    return rows.join(side, "digest", "left").select("doc_id", "digest", "license", "notices")


def _sql_canonical(text: str) -> str:
    c = f"replace(lower(regexp_replace({text}, '(?im){COPYRIGHT}', ' ', 'g')), '&', ' and ')"
    c = f"trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical('body')}) AS digest, min(license) AS license
  FROM (VALUES {', '.join(f"({_sql_text(n)}, {_sql_text(b)})" for n, b in KNOWN)}) AS k(license, body) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
hits AS (SELECT DISTINCT r, license FROM lines JOIN known ON known.digest = sha256({_sql_canonical('line')})),
found AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices FROM hits GROUP BY r)
SELECT doc_id, sha256({_sql_canonical('text')}) AS digest, license, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON known.digest = sha256({_sql_canonical('text')}) LEFT JOIN found USING (r)"""
