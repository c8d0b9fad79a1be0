"""License scan by canonical digest lookup, in DataFrame functions only.

A text is made canonical (lower case, copyright lines dropped, equivalent
spellings unified, everything but letters and digits one space) and its SHA-256
is looked up among the digests of known licences made canonical alike: once for
the whole text and once for each of its lines, which finds one-line notices.
The known table is fixed and small, so it is broadcast; lines whose canonical
length is that of no known notice are dropped before they are digested.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import Scratch

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Published licence texts and the notices that stand for them.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR),
    ("BSD-2-Clause", _BSD_TWO + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
)

#: A line that only says whose the work is; lower case, both dialects.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright[^a-z\n]|\(c\)[^a-z\n]*[0-9]{4}|all rights reserved)[^\n]*$"
#: Spellings that licences use for one another.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("https", "http"))
MARKS = r"[^a-z0-9\n]+"
BREAKS = r"\r\n?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ©", "abcdefghijklmnopqrstuvwxyz "


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks; each line is trimmed."""
    x = F.regexp_replace(F.translate(text, UPPER, LOWER), BREAKS, "\n")
    x = F.regexp_replace(x, "(?md)" + COPYRIGHT_LINE, "")  # lines end in \n alone
    x = F.regexp_replace(x, MARKS, " ")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical(lines: Column) -> Column:
    """One line of canonical lines."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def texts_of(folder: str | Path) -> tuple[tuple[str, str], ...]:
    """(name, text) of the whole licences in a folder of the driver, one a file named after its licence, for ``known``."""
    return tuple((p.stem if p.suffix == ".txt" else p.name, p.read_text("utf-8", "replace")) for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink())


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license, length) of the known texts; one row a digest."""
    rows = spark.createDataFrame(list(known), "license string, text string").withColumn("c", canonical(canonical_lines(F.col("text"))))
    return rows.select(F.sha2("c", 256).alias("digest"), "license", F.length("c").alias("length")).groupBy("digest").agg(F.min("license").alias("license"), F.min("length").alias("length"))


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(doc_id, digest, text_license, n_notices, notices) of every whole text.

    digest: SHA-256 of the canonical text (null is empty); text_license: the
    licence that the whole text is, or null; n_notices: its lines that are a
    known text; notices: their licences, distinct, sorted, comma-separated, or
    empty.  Repeated rows of one id with one text give equal rows.  ``known`` can
    be widened by the whole texts of a folder (``texts_of``).
    """
    spark = docs.sparkSession
    table = known_digests(spark, known)
    lengths = sorted({r["length"] for r in table.select("length").distinct().collect()})
    x = docs.select("doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    fits = F.filter(F.transform(F.split("lines", "\n"), lambda v: F.trim(v)), lambda v: F.length(v).isin(lengths))
    x = Scratch(spark, "licenses").save(x.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), fits.alias("fits")), "canonical")
    whole = x.join(table.select("digest", F.col("license").alias("text_license")), "digest", "left").select("doc_id", "digest", "text_license")
    lines = x.filter(F.size("fits") > 0).select("doc_id", F.col("digest").alias("of"), F.posexplode("fits")).withColumn("digest", F.sha2("col", 256))
    # a repeated row has the same positions, so it doesn't count twice
    found = lines.join(table, "digest").groupBy("doc_id", "of").agg(F.countDistinct("pos").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = whole.alias("w").join(found.alias("f"), F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.digest") == F.col("f.of")), "left")
    return out.select("w.doc_id", "w.digest", "text_license", F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The scan in DuckDB SQL; both dialects read the same patterns."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"

    def lines(col: str) -> str:
        x = f"regexp_replace(translate({col}, '{UPPER}', '{LOWER}'), {quote(BREAKS)}, chr(10), 'g')"
        x = f"regexp_replace(regexp_replace({x}, {quote('(?m)' + COPYRIGHT_LINE)}, '', 'g'), {quote(MARKS)}, ' ', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        return x

    one = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(a)}, {quote(t)})" for a, t in known)
    return f"""
WITH known AS (
  SELECT sha256({one(lines("text"))}) AS digest, min(license) AS license
  FROM (VALUES {values}) t(license, text) GROUP BY 1),
c AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
d AS (SELECT doc_id, sha256({one("lines")}) AS digest, string_split(lines, chr(10)) AS l FROM c),
u AS (SELECT DISTINCT doc_id, digest, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
f AS (
  SELECT u.doc_id, u.digest, count(DISTINCT pos) AS n, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices
  FROM u JOIN known k ON sha256(trim(u.line)) = k.digest GROUP BY 1, 2)
SELECT d.doc_id, d.digest, k.license AS text_license, coalesce(f.n, 0) AS n_notices, coalesce(f.notices, '') AS notices
FROM d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN f ON f.doc_id = d.doc_id AND f.digest = d.digest
"""
