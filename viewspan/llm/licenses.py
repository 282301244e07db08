"""License scans: whole texts, made canonical, are looked up by digest among known licenses.

Canonical form: lower case, copyright lines out, equivalent spellings alike,
everything but ASCII letters and digits out. What is left is hashed and the
digest joined to those of the known texts; nothing is compared letter by
letter and a text is a license only as a whole. A document is looked up as a
whole, and each of its lines as a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# Spellings that count as the same once only letters and digits are left, replaced in this order.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("merchantib", "merchantab"), ("wilful", "willful"), ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("https", "http")]
COPYRIGHT = r"(?m)^[^\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©[ \t]*[0-9]{4}|copyright[ \t]*:|copyright[ \t]+the[ \t][^\n]*(?:authors|contributors|developers|team|project)|all rights reserved)[^\n]*$"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

# Texts of known licenses and the notices by which works name one (SPDX identifiers).
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_TWO}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_TWO}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_TWO}\n\n{_BSD_THREE}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_TWO}\n\n{_BSD_THREE}\n\n{_BSD_END}"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

# Digests of the canonical forms of long licenses, whole and without the appendix on how to apply them.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "cd620b9aae2e7601b490b900148cbea0"),
    ("Apache-2.0", "eb66ab19e5190d0ceb08453ce1057914"),
    ("Artistic-1.0-Perl", "766b40a2fe319df851013e536905567f"),
    ("CC0-1.0", "c50672af8a1a16bc61170ece7fa5bd88"),
    ("GFDL-1.2", "f1db095b3a93000795c037442c4cdd48"),
    ("GFDL-1.3", "8722e516050035a7498446fb54a6d55c"),
    ("GPL-1.0", "10bb1aa18fb14250a73c03a281aeb36c"),
    ("GPL-1.0", "f4ca50a48b386821515463a5eddaf68b"),
    ("GPL-2.0", "7ea39794234ea3bf7b1ee34efc918d6d"),
    ("GPL-2.0", "eac8c6bafb2895daf2bea3c7d070d9bb"),
    ("GPL-3.0", "9468bf70e47df99167460ac04f289e2a"),
    ("GPL-3.0", "b5df00737cf26130c7d5c1e07cc5bc9c"),
    ("LGPL-2.0", "ee7c5d7a67a20a03973884603b6c6478"),
    ("LGPL-2.0", "fad7325e032a8b0869ce8a8d363d11db"),
    ("LGPL-2.1", "20ceec9035c670cb28b3b49c3a1d8430"),
    ("LGPL-2.1", "3152aaf6623a3baffbf7334b03dc212c"),
    ("LGPL-3.0", "3dc77fe01fad042db24b945c344d4eed"),
    ("MPL-1.1", "da27ef54b820ad5badf25e1e8702064f"),
    ("MPL-2.0", "16460510b00814a71821aed7224f44d2"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    low = F.translate(text, _UPPER, _SMALL)
    marked = low.contains("(c)") | low.contains("©") | low.contains("copyright") | low.contains("rights reserved")
    out = F.regexp_replace(F.when(marked, F.regexp_replace(low, COPYRIGHT, "")).otherwise(low), "[^a-z0-9]+", "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, license)``, one row for each canonical text of ``known`` (the first name, by order of names, of equal texts); blank texts are left out. By default all of ``KNOWN`` and ``DIGESTS``."""
    texts = spark.createDataFrame(KNOWN if known is None else known, "license string, t string")
    rows = texts.where(canonical(F.col("t")) != "").select(digest(F.col("t")).alias("digest"), "license")
    if known is None:
        rows = rows.union(spark.createDataFrame(DIGESTS, "license string, digest string").select("digest", "license"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: id, ``text_digest``, ``text_license``, ``n_license_lines`` and ``line_licenses`` (distinct, ascending, comma-joined).

    ``text_license`` is that of the whole text, null without one; the digest is
    the md5 of the canonical text (null: of the empty one). A line counts if it
    is a known text by itself. Texts and lines without letters or digits match
    nothing. Digests are joined by hash; the known ones are few, but may be of any
    number, and only lines that match are grouped. Repeated rows are returned as
    often as they come, and null ids are kept.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    lines = own.select("id", "h", F.posexplode(F.split("t", "\n")).alias("at", "line")).where(F.length("line") > 0)
    hits = lines.select("id", "h", "at", digest(F.col("line")).alias("digest")).join(known, "digest")
    hits = hits.groupBy(F.col("id").alias("hit_id"), F.col("h").alias("hit_h")).agg(F.count_distinct("at").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"))
    found = own.select("id", "h", digest(F.col("t")).alias("text_digest"))
    found = found.join(known.withColumnsRenamed({"digest": "text_digest", "license": "text_license"}), "text_digest", "left")
    found = found.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    return found.select(F.col("id").alias(id_col), "text_digest", "text_license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def _sql_canonical(column: str) -> str:
    out = f"regexp_replace(regexp_replace(translate({column}, '{_UPPER}', '{_SMALL}'), '{COPYRIGHT}', '', 'g'), '[^a-z0-9]+', '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


_VALUES = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, t in KNOWN)
_DIGESTS = ", ".join(f"('{name}', '{d}')" for name, d in DIGESTS)
OP5_SQL = f"""
with known as (select digest, min(license) as license from (select md5({_sql_canonical("t")}) as digest, license from (values {_VALUES}) as k(license, t) union all select digest, license from (values {_DIGESTS}) as g(license, digest)) group by 1),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
hits as (select doc_id, count(*) as n, string_agg(distinct license, ',' order by license) as names from lines join known on md5({_sql_canonical("line")}) = digest group by doc_id)
select d.doc_id, md5({_sql_canonical("coalesce(text, '')")}) as text_digest, k.license as text_license, coalesce(h.n, 0)::bigint as n_license_lines, coalesce(h.names, '') as line_licenses
from documents d left join known k on k.digest = md5({_sql_canonical("coalesce(text, '')")}) left join hits h using (doc_id)
"""
