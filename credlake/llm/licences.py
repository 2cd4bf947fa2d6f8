"""Operator 10 [native]: licence scan by canonical digest lookup.

A text is brought to a canonical form -- lower case, copyright lines out,
equivalent spellings made one, punctuation and spacing to single blanks --
and the SHA-256 of the whole form is hash-joined to the digests of known
licences.  The same digest lookup runs on each whole line that speaks of a
licence (on every line, if the catalogue holds a notice that does not), which
finds one-line notices inside a document.  The catalogue is a DataFrame that a
caller may replace; up to ``BROADCAST_DIGESTS`` counted digests are broadcast,
beyond that the lookup is a salted shuffle join.  The one given here has short
licences below and the long ones as files in ``licence_texts``.

Edge cases: null or empty text, and text with nothing left after the
normalisation, match no licence and have a null digest; a text of any length
is digested whole; repeated rows are scanned like any other; the result has
one row per input row, whatever extra columns the input carries.
"""
from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.llm.common import spread_join

BROADCAST_DIGESTS = 100_000  # about 100 bytes each

# ---- fixed values: equivalent spellings, first form replaced by the second ----
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("fulfil ", "fulfill "), ("favour", "favor"),
    ("organisation", "organization"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("http www", "https www"),
)
# ---- fixed values: how a copyright line starts, in canonical letters ----
COPYRIGHT_LINE = "^[^a-z0-9©]*((\\(c\\)|©|copr\\.?)|copyright[^a-z0-9]*(\\(c\\)|©|[0-9])|all rights reserved)"
# ---- fixed values: a line that may be a notice speaks of one of these ----
NOTICE_LINE = "licen[sc]e|gpl|cc by|cc0|public domain"

# ---- fixed values: known notices and licence texts ----
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZLIB = """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD2 = """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENCES = (
    ("MIT", "text", MIT), ("MIT", "text", MIT.split("\n\n", 1)[1]),
    ("ISC", "text", ISC), ("ISC", "text", ISC.split("\n\n", 1)[1]),
    ("Zlib", "text", ZLIB), ("Zlib", "text", ZLIB.split("\n\n", 1)[1]),
    ("BSD-2-Clause", "text", BSD2), ("BSD-2-Clause", "text", BSD2.split("\n\n", 1)[1]),
    ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
)
BSD3 = BSD2.replace("2-Clause", "3-Clause").replace("""

THIS SOFTWARE""", """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE""")
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MORE_TEXTS = (
    ("BSD-3-Clause", "text", BSD3), ("BSD-3-Clause", "text", BSD3.split("\n\n", 1)[1]),
    ("Unlicense", "text", UNLICENSE), ("Unlicense", "text", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", "text", UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
)
# ---- end of fixed values ----
#: where a long licence's terms end and advice on using it begins: documents hold it with or without the latter
TERMS_END = "END OF TERMS AND CONDITIONS"


def spelling(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_line(line: Column) -> Column:
    """Canonical form of text that holds no copyright line."""
    words = F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " ")
    return F.trim(spelling(words))


def canonical_text(text: Column) -> Column:
    """Canonical form of a whole text: its copyright lines go first."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda ln: ~F.lower(F.substring(ln, 1, 200)).rlike(COPYRIGHT_LINE))
    return canonical_line(F.concat_ws(" ", kept))


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form; null for nothing."""
    return F.when(form != "", F.sha2(form, 256))


def long_texts() -> list[tuple[str, str, str]]:
    """The licences in ``licence_texts``, whole and without what follows their terms."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            body, name = file.read_text(encoding="utf-8"), file.name.removesuffix(".txt")
            out.append((name, "text", body))
            if TERMS_END in body:
                terms = body.split(TERMS_END)[0]
                out += [(name, "text", terms), (name, "text", terms + TERMS_END)]
    return out


def known_licences(spark: SparkSession) -> DataFrame:
    """license_id, scope ('text' or 'notice') and body of the given catalogue."""
    return spark.createDataFrame([*LICENCES, *MORE_TEXTS, *long_texts()], "license_id string, scope string, body string")


def known_digests(known: DataFrame) -> DataFrame:
    """digest, scope, license_id of a catalogue; of licences with one canonical text, the least id."""
    form = F.when(F.col("scope") == "notice", canonical_line(F.col("body"))).otherwise(canonical_text(F.col("body")))
    return (known.select(digest(form).alias("digest"), "scope", "license_id").filter("digest is not null")
            .groupBy("digest", "scope").agg(F.min("license_id").alias("license_id")))


def with_digests(rows: DataFrame, digests: DataFrame, on: str) -> DataFrame:
    """Left join with a catalogue's digests: sent to all tasks where there are
    ``BROADCAST_DIGESTS`` at most, else by a shuffle with the rows' side salted
    (a digest, or null, may hold a third of all rows)."""
    if digests.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(digests), on, "left")
    return spread_join(rows, digests, [on], ["row_id"], "left")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (whole text) and notices (whole lines, sorted ids).

    ``known``: license_id, scope, body of the licences to find.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    digests = known_digests(known)
    whole = digests.filter("scope = 'text'").select("digest", "license_id")
    notices = digests.filter("scope = 'notice'").select(F.col("digest").alias("line"), F.col("license_id").alias("notice"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    if known.filter((F.col("scope") == "notice") & ~F.lower("body").rlike(NOTICE_LINE)).isEmpty():
        lines = F.filter(lines, lambda ln: F.lower(ln).rlike(NOTICE_LINE))
    forms = F.array_distinct(F.filter(F.transform(lines, lambda ln: digest(canonical_line(ln))), lambda d: d.isNotNull()))
    found = (docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), digest(canonical_text(text)).alias("digest"), forms.alias("lines"))
             .select("doc_id", "row_id", "digest", F.explode_outer("lines").alias("line"))
             .transform(with_digests, notices, "line")
             .groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"),
                                    F.array_sort(F.collect_set("notice")).alias("found")))
    return (found.transform(with_digests, whole, "digest")
            .select("doc_id", "digest", "license_id",
                    F.array_join("found", ",").alias("notices"), F.size("found").cast("long").alias("n_notices")))
