"""Licence scans: canonical digests of entire texts, joined with those of known licences.

Canonical form: A-Z lower-cased; lines with a copyright notice dropped; equivalent spellings made one; everything that is
no letter or digit (ASCII and typographic marks) made one space; ends trimmed. Column expressions only. The digest is
SHA-256, so that the join needs no text, and a document of any length is one row of fixed size in the shuffle.

Known licences are texts with the titles that files put before them, and digests of longer ones, of which the module only
holds the digest (with and without the appendix on how to apply them). `read_texts` makes a table of a folder of your own.

Cases: null texts have a null digest and no licence; empty texts, and texts of nothing but marks and copyright lines,
have the digest of the empty text and no licence; very long texts are one expression's input and leave only a digest;
repeated rows each get a row; of licences with the same canonical text the first by name counts; columns of other names are
left behind; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A notice: `copyright` with a mark or a year, a mark with a year, or the reservation of rights, at the start of a line.
COPYRIGHT_LINES = r"\n[^\na-z0-9(©]*(?:(?:\(c\)|©)? ?copyright[ :]*(?:\(c\)|©|[0-9]|<|\[)|(?:\(c\)|©) ?[0-9]|all rights reserved)[^\n]*"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2010}-\x{2027}]+"
#: Spelling -> the one that stands for it. Applied in this order.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("noncommercial", "non-commercial"), ("organisation", "organization"), ("favour", "favor"),
    ("behaviour", "behavior"), ("modelled", "modeled"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("judgement", "judgment"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("per cent", "percent"), ("https://", "http://"), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("artefact", "artifact"),
]

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _one_line(text: str) -> str:
    return " ".join(text.split())


#: Public licence texts and the usual one-line notices. Pass a table of your own for more.
LICENSES = {k: _one_line(v) for k, v in {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS,
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer
to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}.items()}


def canonical(text: Column) -> Column:
    """Copyright lines are dropped only from texts of several lines: a licence on one line must keep its text."""
    t = F.translate(text, UPPER, LOWER)
    t = F.when(F.instr(t, "\n") > 0, F.regexp_replace(F.concat(F.lit("\n"), t), COPYRIGHT_LINES, "")).otherwise(t)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, MARKS, " "))


def canonical_sql(text: str) -> str:
    t = f"translate({text}, '{UPPER}', '{LOWER}')"
    t = f"CASE WHEN instr({t}, chr(10)) > 0 THEN regexp_replace(chr(10) || {t}, '{COPYRIGHT_LINES}', '', 'g') ELSE {t} END"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '{MARKS}', ' ', 'g'))"


#: Titles that files put before a licence's text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "Modified BSD License"),
    "Unlicense": ("The Unlicense",), "Zlib": ("zlib License", "The zlib/libpng License"),
}
TEXTS = sorted({(k, t) for k, text in LICENSES.items() for t in (text, *(f"{title} {text}" for title in TITLES.get(k, ())))})
#: SHA-256 of the canonical form of whole public licence texts.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "c98e40efc6862c9be30915c75f49d704d06c4295eeee2bf5d221d9a5191e6b8a"),
    ("GFDL-1.3", "3238bf8a488349f6890209ed66942daa5c08256ad83b888cf417fbafcf0ceeaf"),
    ("GPL-1.0", "6c07dfb5e6ddc39fe93ae803d39b67367c21b50207b645111c04cd08cb283d70"),
    ("GPL-1.0", "ecede0ce378cc2fefec4431f4cf508af5338dc8a3e44b5c5a3a7867070db5798"),
    ("GPL-2.0", "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f"),
    ("GPL-2.0", "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632"),
    ("GPL-3.0", "256e324e77319243c75592704bf48290df06b18d7b953dfef840c542afc0abe9"),
    ("GPL-3.0", "739d26f3b8a195fd4cf818c746f3df64eb6daf8c04bc6912159ebe538fde853b"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, text) of a folder of whole texts, named by their files."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.(?:txt|md))?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("license_id"), F.col("value").alias("text"))


def digests_of(texts: DataFrame) -> DataFrame:
    """(license_id, digest) of a table of texts; those with nothing in them have none."""
    form = texts.select("license_id", canonical(F.col("text")).alias("_form"))
    return form.filter(F.length("_form") > 0).select("license_id", F.sha2("_form", 256).alias("digest"))


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(license_id, digest) of the licences that come with the module, and of `more` texts (license_id, text)."""
    own = digests_of(spark.createDataFrame(TEXTS, "license_id string, text string")).union(spark.createDataFrame(DIGESTS, "license_id string, digest string"))
    return own.union(digests_of(more)) if more is not None else own


def scan(docs: DataFrame, licenses: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, canonical_chars, digest, license_id) of each row; `licenses` has (license_id, digest). Spark picks the join by
    the size of the known digests."""
    digests = licenses.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    # The form is a column of one pass, cut to its digest before the join.
    rows = docs.select(key, canonical(F.col("text")).alias("_form")).select(key, F.length("_form").cast("long").alias("canonical_chars"), F.sha2("_form", 256).alias("digest"))
    return rows.join(digests, "digest", "left").select(key, "canonical_chars", "digest", "license_id")


def _rows(values: list[tuple[str, str]]) -> str:
    return ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in values)


ORACLE = f"""
WITH all_known AS (SELECT sha256({canonical_sql('text')}) AS digest, license_id FROM (VALUES {_rows(TEXTS)}) AS l(license_id, text)
  UNION ALL SELECT digest, license_id FROM (VALUES {_rows(DIGESTS)}) AS d(license_id, digest)),
known AS (SELECT digest, min(license_id) AS license_id FROM all_known GROUP BY 1),
forms AS (SELECT doc_id, {canonical_sql('text')} AS form FROM documents)
SELECT doc_id, length(form) AS canonical_chars, sha256(form) AS digest, license_id
FROM forms LEFT JOIN known ON sha256(form) = digest
"""
