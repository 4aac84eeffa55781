"""License scan by canonical digest lookup.

A whole text is brought to a canonical form (case, copyright lines, punctuation,
white space and equivalent spellings no longer matter) and its SHA-256 is looked up
among those of known licences.  The known digests are broadcast only when their
counted rows are within ``BROADCAST_ROWS``.  Nothing but digests is compared, and
texts are never shuffled.

A copyright line claims copyright: after "copyright", "(c)" or the sign comes a year, a
placeholder, a name or another sign; a line of running text that wrapped before
"copyright notice" or "copyright holders" is none, nor is an item "(c)" of a list.  A
line of nothing but "All rights reserved." goes with them.

Edge cases: a null text, or one that is empty in canonical form, has a null digest
and matches nothing; of known licences with equal canonical texts the smallest id is
reported; equal rows get equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.session import small_batches, table, trimmed

BROADCAST_ROWS = 100_000

# Spellings that count as equal, after lower-casing and without punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("owner", "holder"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Whole licences with their usual title lines; ``all_rights`` where "All rights reserved." may stand before the text.
BUNDLED = Path(__file__).with_name("licenses.json")

# Short notices and licences that documents may consist of.
KNOWN = [
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
]
# What makes a line a copyright line, in the syntax that Python's and DuckDB's patterns share; ``%`` is a year or placeholder.
_CLAIMS = [
    r"[Cc](?:opyright|OPYRIGHT)[ \t]*(?:\([Cc]\)|©|&copy;|%|by[ \t])",
    r"[Cc]opyright:?[ \t]+(?:the[ \t]+)?[A-Z][A-Za-z.&-]*[ \t]*(?:[A-Z(,]|and[ \t]|contributors|[0-9]|$)",
    r"(?:\([Cc]\)|&copy;)[ \t]*(?:[Cc](?:opyright|OPYRIGHT)|%)",
    r"©",
    r"[Aa](?:ll [Rr]ights [Rr]eserved|LL RIGHTS RESERVED)\.?[ \t]*$",
]
_YEAR = r"[:,]?[ \t]*(?:[\[<{(][ \t]*)?(?:[0-9]{4}|yyyy|YYYY|[Yy]ear|YEAR|[\[<{])"
COPYRIGHT_LINE = r"^[ \t]*(?:[#*;%/-]+[ \t]*)?(?:[Pp]ortions[ \t]+)?(?:" + "|".join(c.replace("%", _YEAR) for c in _CLAIMS) + r")[^\n]*"
_COPYRIGHT = re.compile(COPYRIGHT_LINE, re.M)
_SIGNS = ("opyright", "OPYRIGHT", "(c)", "(C)", "©", "&copy;", "eserved", "RESERVED")  # one is in every such line
_APART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_ONE = {a.encode(): b.encode() for a, b in SPELLINGS if " " not in a}
_SEVERAL = {tuple(a.encode().split()): b.encode() for a, b in SPELLINGS if " " in a}


def canonical(text: str) -> bytes:
    """Lower case, no copyright lines, one space for every run of punctuation and white space, one
    spelling, in UTF-8; every word is looked at once."""
    text = text.replace("\r\n", "\n")
    if any(sign in text for sign in _SIGNS):
        text = _COPYRIGHT.sub("", text)
    words = [_ONE.get(w, w) for w in text.lower().encode().translate(_APART).split()]
    for several, one in _SEVERAL.items():
        if several[0] in words:
            k, out = 0, []
            while k < len(words):
                hit = tuple(words[k : k + len(several)]) == several
                out.append(one if hit else words[k])
                k += len(several) if hit else 1
            words = out
    return b" ".join(words)


def digest(text: str | None) -> str | None:
    form = canonical(text) if text else b""
    return hashlib.sha256(form).hexdigest() if form else None


def with_digests(texts: DataFrame, key: str) -> DataFrame:
    """``(key, digest)`` for every row of ``texts(key, text)``."""
    small_batches(texts.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(t.as_py()) for t in batch.column(1)], pa.string())], names=[key, "digest"])

    picked = texts.select(key, "text")
    return picked.mapInArrow(trimmed(read), f"{key} {picked.schema[key].dataType.simpleString()}, digest string")


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, license_id)`` of a table ``(license_id, text)``, one row per digest."""
    return with_digests(known, "license_id").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(documents: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: its canonical digest and the licence that it is, or null."""
    table_of = known_digests(known)
    if table_of.count() <= BROADCAST_ROWS:
        table_of = F.broadcast(table_of)
    return with_digests(documents, "doc_id").join(table_of, "digest", "left").select("doc_id", "digest", "license_id")


def bundled() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the bundled licences in their usual forms: with and without a
    title, wrapped and with one line to a paragraph, links with either scheme."""
    out = set()
    for x in json.loads(BUNDLED.read_text(encoding="utf-8")):
        for title in ("", *x["titles"]):
            for rights in ("", "All rights reserved.")[: 1 + x["all_rights"]]:
                whole = "\n\n".join(part for part in (title, rights, x["text"]) if part)
                for form in (whole, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", whole)):
                    out |= {(x["license_id"], form), (x["license_id"], form.replace("https://", "http://")), (x["license_id"], form.replace("http://", "https://"))}
    return sorted(out)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the known notices and the bundled licences."""
    return scan_licenses(table(spark, sf_dir, "documents"), spark.createDataFrame(KNOWN + bundled(), "license_id string, text string"))


def _sql_canonical(text: str) -> str:
    """The same form another way: words stand between two spaces, so that neighbours share none, and
    spellings are replaced one by one."""
    lines = COPYRIGHT_LINE.replace("'", "''")
    out = rf"regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), '(?m){lines}', '', 'g')"
    out = rf"concat('  ', regexp_replace(lower({out}), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', '  ', 'g'), '  ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"nullif(trim(regexp_replace({out}, ' +', ' ', 'g')), '')"


_VALUES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
OP7_SQL = f"""
WITH k AS (
  SELECT sha256({_sql_canonical("t")}) AS digest, min(i) AS license_id FROM (VALUES {_VALUES}) AS v(i, t) GROUP BY 1
), d AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256({_sql_canonical("text")}) END AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license_id FROM d LEFT JOIN k ON d.digest = k.digest
"""
