r"""License scans by canonical digests, in DataFrame functions only.

A whole text is put into canonical form: lower case; copyright statements removed; white space folded, line breaks
included; equivalent spellings replaced by one; everything but letters and digits turned into single spaces. A statement begins
a line and is a copyright sign, or the word with a sign or a year, or the word with a holder where it begins or ends a
paragraph. It goes to the end of its line (after a comma, of the next one, within 200 characters a line), or to where a
known licence begins in the same line. The query's SQL states an older form, which removes whole lines and folds none; the
tests hold the given tables to it. The SHA-256 of what remains is joined by
hash to the digests of known licence texts, which pass through the same expressions. Known are the licences fixed below,
the full texts in license_texts, and those of a table that the caller gives; their digests are broadcast if their counted
rows are few, else merged. Corpus texts are neither shuffled nor gathered.

Whole texts alone miss a licence that stands in or below other prose. `parts` therefore joins the digests of every line and
of every paragraph of several lines (paragraphs are parted by blank lines) in the same way, over the whole of each text. A
licence of several paragraphs is found where it is the whole text.

Defined results: null, empty and copyright-only texts have the empty canonical form and match nothing; repeated rows give
repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import join_small

#: Bytes of a known licence's digest and id in a join.
ROW_BYTES = 256

_START = r"\b(?:permission (?:is hereby|to use)|redistribution and use|(?:licen[sc]ed|released) under|this work is licen|spdx-licen|(?:the )?(?:mit|isc|bsd [0-9]-clause|apache) licen)"
_REST = rf"(?:(?!{_START})[^\n]){{0,200}}"
_END = rf"{_REST}(?:(?<=,)[^\S\n]*\n{_REST}){{0,3}}(?=\n|\z|{_START})"
_NO_HOLDER = r"(?!(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|permissions?|interests?|treaty|disclaimers?|line|and|or|in|on|of|to|is|as|for|this|that|which)\b)"
_BEFORE, _YEAR = r"[^a-z0-9©(\n]*", r"(?:1[89]|20)[0-9]{2}\b"
#: Replacements on lower-case text, in this order: line ends; lines without letters and digits; statements with a
#: sign or year ((c) alone may number a list); with a holder alone; reserved rights. Only texts with one of MARKS need them.
STATEMENTS = [
    (r"\r\n?", "\n"),
    (r"\n[^\p{L}\p{N}\n©]+(?=\n)", "\n"),
    (rf"(?m)^{_BEFORE}(?:copyright[^a-z0-9©(\n]*(?:\(c\)|©|[^a-z0-9\n]*{_YEAR})|©|\(c\)[^a-z0-9\n]*{_YEAR}){_END}", "\n"),
    (rf"(?<=\A|\n\n){_BEFORE}copyright\b[^a-z0-9\n]*+{_NO_HOLDER}{_END}|(?m:^){_BEFORE}copyright\b[^a-z0-9\n]*+{_NO_HOLDER}{_END}(?=\n\n|\n?\z|\n?{_START})", "\n"),
    (rf"(?m)^[^a-z0-9\n]*all rights reserved\.?[^a-z0-9\n]*(?=\n|\z|{_START})", " "),
]
MARKS = ("copyright", "©", "(c)", "rights reserved")
#: Fixed value: white space but for single blanks, with the marks of comments that begin lines.
FOLD = r"\s(?:\s*(?<=\n)[\s*#/;|>%-]*|\s+|(?<! ))"
#: Fixed values of the query's SQL: lines that state a copyright, to the end of the line.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved\.?[^a-z0-9\n]*$"
#: Spellings that count as equal, as (pattern, replacement), applied in this order to lower-case text.
EQUIVALENT = [
    (r"licence", "license"),
    (r"sub[- ]licens", "sublicens"),
    (r"non[- ]infringement", "noninfringement"),
    (r"merchantib", "merchantab"),
    (r"copyright owners?", "copyright holder"),
    (r"copyright holders", "copyright holder"),
    (r"per cent", "percent"),
    (r"organisation", "organization"),
    (r"favour", "favor"),
    (r"acknowledgement", "acknowledgment"),
    (r"while ?st", "while"),
    (r"https?://(www\.)?", ""),
    (r"\bversion ", "v"),
    (r"\bv\.? ?([0-9])", "v$1"),
    (r"©|\(c\)", "copyright"),
    (r"&", " and "),
]
#: Licence texts, whole.
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known licence texts and notices by SPDX identifier (a licence may have several).
KNOWN = [
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null becomes empty."""
    low = out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STATEMENTS:
        out = F.regexp_replace(out, pattern, to)
    marked = functools.reduce(lambda a, b: a | b, [low.contains(m) for m in MARKS])
    out = F.when(marked, out).otherwise(low)
    for pattern, to in [(FOLD, " "), *EQUIVALENT]:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def built_in() -> list[tuple[str, str]]:
    """(license_id, text): KNOWN, MIT under its other titles, and the full texts, with and without what follows their terms."""
    mit = KNOWN[0][1].removeprefix("MIT License")
    out = [*KNOWN, *(("MIT", title + mit) for title in ("", "The MIT License", "The MIT License (MIT)"))]
    for file in sorted(resources.files("pixelframe.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(file.name.removesuffix(".txt"), t) for t in ([text, terms, terms + end] if end else [text])]
    return out


def known(spark, more: DataFrame | None = None) -> DataFrame:
    """(license_id, digest) of the known licences and of `more` (license_id, text), each digest once, with its least id."""
    texts = spark.createDataFrame(built_in(), "license_id string, text string")
    if more is not None:
        texts = texts.unionByName(more.select("license_id", "text"))
    forms = texts.where("license_id is not null").select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """Per row: the id, canonical_sha256, license_id (null if the whole text is no known licence). `more` has further
    licences (license_id, text)."""
    rows = df.select(df[id_col].alias("__id"), F.sha2(canonical(df[text_col]), 256).alias("canonical_sha256"))
    found = join_small(rows, known(df.sparkSession, more).withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left", ROW_BYTES)
    return found.select(F.col("__id").alias(id_col), "canonical_sha256", "license_id")


def parts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """Per line or paragraph that is a known licence: the id, part (line or paragraph), place (from 1), license_id. A
    licence in a line of its own inside a paragraph that is, but for copyrights, the same licence gives both."""

    def cut(kind: str, pattern: str) -> Column:
        pieces = F.split(df[text_col], pattern)
        return F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("part"), (i + 1).alias("place"), x.alias("t")))

    several = F.filter(cut("paragraph", r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+"), lambda x: x["t"].rlike(r"\S[^\S\r\n]*[\r\n]+\s*\S"))
    rows = df.select(df[id_col].alias("__id"), F.explode(F.concat(cut("line", r"\r\n?|\n"), several)).alias("p"))
    # a digest that can't be null gets no null check from the join, which would compute every form twice
    rows = rows.select("__id", "p.part", "p.place", F.coalesce(F.sha2(canonical(F.col("p.t")), 256), F.lit("")).alias("digest"))
    return join_small(rows, known(df.sparkSession, more), "digest", "inner", ROW_BYTES).select(F.col("__id").alias(id_col), "part", "place", "license_id")


def oracle() -> str:
    def form(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', ' ', 'g')"
        for pattern, to in EQUIVALENT:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return f"sha256(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN)
    return f"""
WITH k AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {form("text")} AS digest FROM (VALUES {rows}) AS t(license_id, text)) GROUP BY digest),
d AS (SELECT doc_id, {form("text")} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN k ON canonical_sha256 = digest
"""
