"""Licence scan by canonical digest: equal texts up to case, punctuation, copyright lines and equivalent spellings.

Texts become canonical (lower case; lines that claim copyright out; equivalent words one spelling; punctuation and white space
one space) and their SHA-256 joins known digests of whole licence texts and notices. The known side is the list below, the
texts in the folder ``licenses``, each also without its title and without what follows its terms, and the caller's own
texts or digests; it is broadcast only if the optimiser finds it small. Entire texts are digested, never parts picked by
size. Notices within a document are found by the digest of each of its lines, whatever it says. Built-in functions only.

Defined results: null text is empty text, which is no licence; every input row gives one row; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native import quoted

# Known licence texts and notices, and spellings that count as equal.
NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
KNOWN = (
    ("MIT", "MIT License\n\nCopyright (c) 2024 The Authors\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + NO_WARRANTY),
    ("ISC", "ISC License\n\nCopyright (c) 2024 The Authors\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2024, The Authors\n\n" + BSD_START + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2024, The Authors\n\n" + BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + BSD_END),
    ("Zlib", "zlib License\n\nCopyright (c) 2024 The Authors\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT notice", "Released under the MIT License."),
    ("MIT notice", "Licensed under the MIT License."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause notice", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0 notice", "Licensed under the Mozilla Public License, version 2.0."),
)
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("noncommercial", "non-commercial"), ("https://", "http://"))
CLAIM = r"(^|\n)[ \t*#/;-]*copyright[ \t:]*(\(c\)|©|[0-9]{4})[^\n]*"
JUNK = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def spelled(text: str) -> str:
    """SQL of the SQL expression ``text`` in lower case, without claims, equivalent words alike; lines stay lines."""
    x = f"regexp_replace(lower({text}), {quoted(CLAIM)}, '\\n')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def bare(text: str) -> str:
    """SQL of a spelled text with one space for punctuation and white space."""
    return f"trim(regexp_replace({text}, {quoted(JUNK)}, ' '))"


def canonical(text: str) -> str:
    """SQL of the canonical form of the SQL expression ``text``."""
    return bare(spelled(text))


@lru_cache(1)
def bundled() -> tuple[tuple[str, str], ...]:
    """Whole licence texts by SPDX identifier: those of ``KNOWN`` and the files of ``licenses``, with their variants."""
    texts = [(n, t) for n, t in KNOWN if "\n" in t] + [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    out = []
    for name, text in texts:
        terms = text.split("END OF TERMS AND CONDITIONS")
        forms = [text, *([terms[0], terms[0] + "END OF TERMS AND CONDITIONS"] if len(terms) > 1 else [])]
        for form in forms:
            title, _, rest = form.strip().partition("\n\n")
            out += [(name, form), *([(name, rest)] if len(title) < 120 else [])]
    return tuple(out)


def digests(texts: DataFrame) -> DataFrame:
    """license_id and digest of each text (license_id, body); equal canonical texts once."""
    return texts.selectExpr("license_id", f"sha2({canonical('body')}, 256) AS digest").dropDuplicates(["digest"])


def known(spark) -> DataFrame:
    """license_id and digest of each known text; equal canonical texts once."""
    return digests(spark.createDataFrame(KNOWN, "license_id string, body string"))


def listed_sizes(spark) -> tuple[int, int]:
    """The least and the largest length of the canonical forms of ``KNOWN``."""
    size = F.length(F.expr(canonical("body")))
    return tuple(spark.createDataFrame(KNOWN, "license_id string, body string").agg(F.min(size), F.max(size)).first())


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the entire text), n_notices, notices (of its lines): one row per input row.

    ``more`` has further texts (license_id, body) or digests of canonical texts (license_id, digest); a digest that
    several identifiers have gets the least one, ``KNOWN`` and the bundled texts before all others.
    """
    spark = docs.sparkSession
    listed = known(spark)
    rows = {r.digest: r.license_id for r in listed.collect()}  # as many as KNOWN
    table = "map(" + ", ".join(f"'{d}', {quoted(n)}" for d, n in sorted(rows.items())) + ")"
    text = f"coalesce(CAST({text_col} AS STRING), '')"
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(text).alias("text"))
    # claims and spellings never reach over lines, so one pass serves the whole text and its lines; a line longer or
    # shorter than all known notices is none of them
    sizes = listed_sizes(spark)
    found = found.select("doc_id", F.expr(spelled("text")).alias("text"))
    lines = f"filter(transform(split(text, '\\n'), x -> {bare('x')}), x -> length(x) BETWEEN {sizes[0]} AND {sizes[1]})"
    notices = f"array_sort(filter(transform({lines}, x -> element_at({table}, sha2(x, 256))), x -> x IS NOT NULL))"
    found = found.select("doc_id", F.expr(f"sha2({bare('text')}, 256)").alias("digest"), F.expr(notices).alias("own"))
    whole = listed.withColumn("k", F.lit(0)).unionByName(digests(spark.createDataFrame(bundled(), "license_id string, body string")).withColumn("k", F.lit(1)))
    if more is not None:
        own = more.select("license_id", "digest") if "digest" in more.columns else digests(more)
        whole = whole.unionByName(own.withColumn("k", F.lit(2)))
    # the empty text is no licence
    whole = whole.filter("digest <> sha2('', 256)").groupBy("digest").agg(F.min(F.struct("k", "license_id"))["license_id"].alias("license_id"))
    out = found.join(whole, "digest", "left")
    return out.select("doc_id", "digest", "license_id", F.size("own").cast("long").alias("n_notices"), F.array_join("own", ",").alias("notices"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return licenses(table(spark, sf_dir, "documents"))


def _duck(text: str) -> str:
    """The canonical form in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace(lower({text}), {q(CLAIM)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, {q(JUNK)}, ' ', 'g'))"


def oracle() -> str:
    rows = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN)
    return f"""
    WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({_duck("body")}) AS digest FROM (VALUES {rows}) v(license_id, body)) GROUP BY digest),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
    notices AS (SELECT rid, count(*) AS n, string_agg(license_id, ',' ORDER BY license_id) AS names FROM (SELECT rid, sha256({_duck("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY rid)
    SELECT doc_id, d.digest, k.license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(names, '') AS notices
    FROM (SELECT rid, doc_id, sha256({_duck("text")}) AS digest FROM docs) d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN notices USING (rid)"""
