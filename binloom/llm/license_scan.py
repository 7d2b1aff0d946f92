"""License scans by canonical digest.

A text is made canonical: lower case, copyright lines and "all rights reserved" gone, equivalent
spellings made one, punctuation and white space reduced to single spaces. Its SHA-256 digest is then
joined with the digests of known licences, made in the same way. What is looked up is the entire text
of a document and the entire text of each of its lines, so that a notice on a line of its own is found
too; parts of a line never match.

The table of known texts has a fixed size, a few hundred rows, so each executor holds it whole and
documents are not shuffled.

Defined results: null and empty texts match nothing; a text of several canonical forms is impossible,
as the rules run in one order; repeated rows match alike; a known text that two licences share is
reported for both, and that is the only tie. Long texts are made canonical whole; an empty table gives
an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.shared import text_or_empty

# Spellings that count as the second one, applied in this order.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("honour", "honor"), ("judgement", "judgment"),
    ("whilst", "while"), ("wilful", "willful"), ("http://", "https://"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("version ", "v"), ("version-", "v"),
]
COPYRIGHT_LINES = r"(?m)^[^\n\pL\pN]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9])|\(c\) |©|all rights reserved)[^\n]*$"
NOT_WORDS = r"[^\pL\pN\n]+"

# SPDX identifiers and the names that notices give them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GPL version 2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GPL version 3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL version 3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPL version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
}
# How notices say it.
NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This program is licensed under the {}"]

# Entire licence texts.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""


def known_texts() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of entire licences, with and without a title, and of notices."""
    out = [(spdx, notice.format(name)) for spdx, names in NAMES.items() for name in names for notice in NOTICES]
    out += [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in NAMES]
    whole = [
        ("MIT", ["", "MIT License\n\n", "The MIT License (MIT)\n\n"], MIT_GRANT),
        ("ISC", ["", "ISC License\n\n"], ISC_GRANT),
        ("BSD-2-Clause", ["", "BSD 2-Clause License\n\n"], BSD_HEAD + BSD_ONE + BSD_TAIL),
        ("BSD-3-Clause", ["", "BSD 3-Clause License\n\n"], BSD_HEAD + BSD_ONE + BSD_THREE + BSD_TAIL),
        ("Unlicense", ["", "The Unlicense\n\n"], UNLICENSE),
    ]
    return out + [(spdx, title + text) for spdx, titles, text in whole for title in titles]


def canonical_lines(text: Column) -> Column:
    """Array of a text's lines in canonical form."""
    out = F.regexp_replace(F.lower(text_or_empty(text)), COPYRIGHT_LINES, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.transform(F.split(F.regexp_replace(out, NOT_WORDS, " "), "\n", -1), lambda x: F.trim(x))


def whole_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest, n_chars) of canonical known texts."""
    texts = spark.createDataFrame(known_texts() if known is None else known, "license string, text string")
    form = whole_text(canonical_lines(F.col("text")))
    return texts.select("license", F.sha2(form, 256).alias("digest"), F.length(form).alias("n_chars")).where("n_chars > 0").distinct()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per match: document id, line (0 for the entire document, else from 1), license, digest.

    Only units as long as some known canonical text are digested, which leaves out none that could match.
    """
    digests = known_digests(docs.sparkSession, known)
    lengths = sorted({r.n_chars for r in digests.select("n_chars").distinct().collect()})  # of the fixed table
    frame = docs.select(F.col(id_col).alias("__id"), canonical_lines(docs[text]).alias("__lines"))
    frame = frame.select("__id", F.concat(F.array(whole_text(F.col("__lines"))), F.col("__lines")).alias("__units"))
    units = F.filter(F.transform("__units", lambda u, i: F.struct(i.alias("line"), u.alias("unit"))), lambda x: F.length(x["unit"]).isin(lengths))
    rows = frame.select("__id", F.explode(units).alias("u")).select("__id", "u.line", F.sha2("u.unit", 256).alias("digest"))
    found = rows.join(F.broadcast(digests.drop("n_chars")), "digest")
    return found.select(F.col("__id").alias(id_col), F.col("line").cast("int").alias("line"), "license", "digest")


def oracle_sql() -> str:
    """The same scan of `documents` in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(col: str) -> str:
        out = f"regexp_replace(lower(coalesce({col}, '')), {quote(COPYRIGHT_LINES)}, '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return f"list_transform(string_split(regexp_replace({out}, {quote(NOT_WORDS)}, ' ', 'g'), chr(10)), lambda x: trim(x, ' '))"

    whole = "array_to_string(list_filter(l, lambda x: x <> ''), ' ')"
    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_texts())
    return f"""
    WITH known AS (SELECT license, {lines("text")} AS l FROM (VALUES {rows}) AS k(license, text)),
    digests AS (SELECT DISTINCT license, sha256({whole}) AS digest FROM known WHERE {whole} <> ''),
    docs AS (SELECT doc_id, {lines("text")} AS l FROM documents),
    units AS (
        SELECT doc_id, 0 AS line, {whole} AS unit FROM docs
        UNION ALL SELECT doc_id, unnest(generate_series(1, len(l)))::INT, unnest(l) FROM docs
    )
    SELECT doc_id, line::INT AS line, license, digest FROM (SELECT doc_id, line, sha256(unit) AS digest FROM units WHERE unit <> '') JOIN digests USING (digest)
    """
