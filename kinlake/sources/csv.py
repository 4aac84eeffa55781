"""Delimited text, from files, strings or links, as all-string tables."""

from __future__ import annotations

import csv
import re
import urllib.parse
import urllib.request
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.functions.text import raw_file_url

DELIMITERS = (",", ";", "\t", "|")
INLINE_BYTES, LINK_BYTES, SNIFF_BYTES, TIMEOUT = 4_000_000, 10_000_000, 8_192, 15


class SourceError(ValueError):
    """A source that can't be read."""


def sniff_delimiter(text: str) -> str:
    """The header's most frequent delimiter, unless the sniffer's occurs there as often."""
    header = text.split("\n", 1)[0]
    most = max(DELIMITERS, key=header.count)
    try:
        found = csv.Sniffer().sniff(text[:SNIFF_BYTES], delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        found = ""
    if found in DELIMITERS and header.count(found) >= header.count(most):
        return found
    return most if header.count(most) else ","


def tidy(df: DataFrame) -> DataFrame:
    """Columns with a name, missing cells as empty text, no rows that are blank throughout."""
    columns = [c for c in df.columns if c and c.strip() and not re.fullmatch(r"_c\d+", c)]
    out = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns))
    return out.where(reduce(lambda a, b: a | b, (F.trim(F.col(f"`{c}`")) != "" for c in columns))) if columns else out


def read_files(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Files of one table; without ``sep`` it is sniffed from the first lines."""
    if sep is None:
        head = "\n".join(r["value"] for r in spark.read.text(path).limit(50).collect())
        sep = sniff_delimiter(head)
    return tidy(spark.read.csv(path, header=True, inferSchema=False, sep=sep, quote='"', escape='"', multiLine=True))


def read_text(spark: SparkSession, text: str, max_bytes: int | None = INLINE_BYTES) -> DataFrame:
    """A table given as text, up to ``max_bytes`` of it."""
    if max_bytes is not None and len(text.encode()) > max_bytes:
        raise SourceError(f"inline text is over {max_bytes} bytes")
    rows = list(csv.reader(text.splitlines(keepends=True), delimiter=sniff_delimiter(text)))
    if not rows:
        raise SourceError("no header")
    header = rows[0]
    keep = [k for k, c in enumerate(header) if c.strip()]
    data = [tuple(r[k] if k < len(r) else "" for k in keep) for r in rows[1:]]
    schema = ", ".join(f"`{header[k]}` string" for k in keep)
    return tidy(spark.createDataFrame(data, schema))


def rewrite_link(url: str) -> str:
    """Adds https, allows http(s) only, and points code hosts' views to their raw files."""
    url = url.strip()
    if "://" not in url:
        url = "https://" + url
    if urllib.parse.urlparse(url).scheme not in ("http", "https"):
        raise SourceError("only http and https links are read")
    found = re.match(r"https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", url)
    if found:
        return "https://raw.githubusercontent.com/" + "/".join(found.groups())
    if re.match(r"https?://gist\.github\.com/[^/]+/[0-9a-fA-F]+/?$", url):
        return url.rstrip("/") + "/raw"
    return url


def fetch(url: str, max_bytes: int = LINK_BYTES) -> tuple[str, str]:
    """``(text, name)`` of a linked file; pages are refused unless they say they are CSV."""
    request = urllib.request.Request(rewrite_link(url), headers={"User-Agent": "kinlake"})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as response:  # noqa: S310
        data, kind = response.read(max_bytes + 1), response.headers.get("Content-Type", "")
    if len(data) > max_bytes:
        raise SourceError(f"the file is over {max_bytes} bytes")
    text = data.decode("utf-8", errors="replace")
    if "csv" not in kind and ("html" in kind or re.match(r"\s*<(!doctype|html)", text, re.I)):
        raise SourceError("the link leads to a web page, not to a table")
    return text, urllib.parse.urlparse(url).path.rsplit("/", 1)[-1] or "download.csv"


def read_link(spark: SparkSession, url: str) -> DataFrame:
    return read_text(spark, fetch(url)[0], max_bytes=None)


def raw_links(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, raw_file_url(column))


def records_and_gold(df: DataFrame, truth: str, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records without truth and the dropped columns, names lower-cased; and the truth column with the dropped ids."""
    records = df.drop(truth, *drop)
    return records.toDF(*(c.lower() for c in records.columns)), df.select(*drop, truth)
