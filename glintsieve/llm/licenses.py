"""Licence scanning by canonical digests, in DataFrame functions.

A text's canonical form has no copyright lines, is lower-cased, spells equivalent words
in one way and has one space for each run of punctuation and white space.  The digests
of entire texts are hash-joined to those of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many known digests are broadcast; beyond, both sides are shuffled.
BROADCAST_DIGESTS = 200_000

# Lines that name holders of rights, which a sign, a year, a blank to fill in or a capital tells from
# wrapped lines that begin with the word; and spellings that mean the same.
COPYRIGHT_LINE = (
    r"(?im)^[^\n\p{L}]*(©|all rights reserved|\(c\)[^\n]*(19|20)\d\d|copyright[^\n\p{L}]*(©|\(c\)|[<\[{])|copyright[^\n]*(19|20)\d\d"
    r"|(?-i:Copyright)[ \t]+(by[ \t]+)?(?!holder|notice|owner|licen|law|act\b|statement|interest)(?-i:\p{Lu}))[^\n]*$"
)
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("favour", "favor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("http://", "https://"), ("&", " and "),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Licences whose texts are short; a longer list is a table that users give.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
]


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """The SHA-256 of the canonical form, in hex; null for a text of which nothing is left."""
    form = canonical(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, canonical_sha256, license_id) for each row of ``docs`` (doc_id, text).

    ``known`` has license_id and text; of several licences with one canonical text the
    first by name counts.  Entire texts are compared: license_id is null for a text that
    is more or less than a licence.  Null and empty texts, and such of copyright lines
    only, have neither; so have known licences without text, which match nothing.
    Repeated rows are judged each, and other columns are ignored.
    """
    table = known.select("license_id", digest(F.col("text")).alias("canonical_sha256")).where("canonical_sha256 is not null and license_id is not null")
    table = table.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    small = F.broadcast(table) if table.count() <= BROADCAST_DIGESTS else table
    return docs.select("doc_id", digest(F.col("text")).alias("canonical_sha256")).join(small, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
