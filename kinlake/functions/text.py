"""Column functions on text.  All but ``strip_html`` stay in the JVM; NULL is the missing value."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NGRAM = 3
HASH_DIM = 512
PREFIX = 3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Lower-cased without surrounding white space of any script; blank is NULL."""
    return F.nullif(F.regexp_replace(F.lower(col(c).cast("string")), r"(?U)^\s+|\s+$", ""), F.lit(""))


def prefix_key(c: Column | str, n: int = PREFIX) -> Column:
    return F.substring(clean(c), 1, n)


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def record_text(columns: list[str], skip_blank: bool = False) -> Column:
    """Values joined by spaces.  With ``skip_blank``: stripped, blank ones left out, lower-cased."""
    if skip_blank:
        return F.lower(F.concat_ws(" ", *(F.nullif(F.regexp_replace(F.col(c).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit("")) for c in columns)))
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def char_ngrams(c: Column | str, n: int = NGRAM) -> Column:
    """All n-grams in order, with repeats; a text of at most ``n`` characters is one gram, an empty one none."""
    s = squeeze(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(F.length(s) > n, grams).when(F.length(s) > 0, F.array(s)).otherwise(F.array().cast("array<string>"))


def _hash(gram: Column) -> Column:
    return F.aggregate(F.split(gram, ""), F.lit(0).cast("long"), lambda h, ch: (h * 31 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hashed_ngrams(c: Column | str, n: int = NGRAM, dim: int = HASH_DIM) -> Column:
    """The set of hashed n-grams of the lower-cased, space-padded text, ascending."""
    s = F.concat(F.lit(" "), F.lower(col(c)), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: (_hash(F.substring(s, i, F.lit(n))) % dim).cast("int"))
    return F.when(F.length(s) >= n, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<int>"))


def alnum_text(c: Column | str) -> Column:
    """Lower-cased ASCII letters and digits, other runs one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def shingle_set(c: Column | str, n: int = NGRAM) -> Column:
    return F.array_sort(F.array_distinct(char_ngrams(alnum_text(c), n)))


def token_set(c: Column | str, least: int = 2) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(alnum_text(c), " "), lambda t: F.length(t) >= least)))


def words(c: Column | str) -> Column:
    """Distinct white-space tokens; blank text has none."""
    return F.array_remove(F.array_distinct(F.split(squeeze(c), " ")), "")


def norm01(c: Column | str) -> Column:
    return F.when(col(c) > 1, col(c) / 100).otherwise(col(c))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def pairs_of(n: Column | str) -> Column:
    """How many unordered pairs ``n`` things make."""
    return (col(n) * (col(n) - 1) / 2).cast("long")


def is_number(c: Column | str) -> Column:
    return F.expr(f"try_cast(trim({c}) AS double) IS NOT NULL") if isinstance(c, str) else c.try_cast("double").isNotNull()


def checksum(c: Column | str) -> tuple[Column, Column]:
    """Position-weighted byte sums modulo 2**31 - 1, forward and reversed (ASCII)."""
    mod, chars = 2**31 - 1, F.split(col(c), "")

    def weighted(values: Column) -> Column:
        return F.aggregate(F.transform(values, lambda ch, i: F.ascii(ch).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: (s + x) % mod)

    return weighted(chars), weighted(F.reverse(chars))


def slug(c: Column | str) -> Column:
    s = F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), "[^a-z0-9_-]", "-"), 1, 60)
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("upload"))


def raw_file_url(c: Column | str) -> Column:
    """Links to a code host's file view become links to the raw file."""
    u = F.regexp_replace(col(c), r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")
    return F.when(u.rlike(r"^https?://gist\.github\.com/[^/]+/[0-9a-fA-F]+/?$"), F.concat(F.regexp_replace(u, "/$", ""), F.lit("/raw"))).otherwise(u)


def with_scheme(c: Column | str) -> Column:
    return F.when(col(c).rlike("^https?://"), col(c)).otherwise(F.concat(F.lit("https://"), col(c)))


def paper_url(c: Column | str) -> Column:
    """A paper's id or address as its HTML address; NULL when there is none or the host is another."""
    u = F.trim(F.coalesce(col(c), F.lit("")))
    full = with_scheme(u)
    host = F.lower(F.regexp_extract(full, r"^https?://([^/:?#]+)", 1))
    number = F.regexp_extract(full, r"^https?://[^/?#]+[^?#]*?/(?:abs|html|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    path = F.regexp_extract(full, r"^https?://[^/?#]+(/[^?#]*)", 1)
    known = host.isin("arxiv.org", "www.arxiv.org", "export.arxiv.org", "ar5iv.org", "www.ar5iv.org", "ar5iv.labs.arxiv.org")
    return (
        F.when(u.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), F.concat(F.lit("https://ar5iv.org/html/"), u))
        .when(known & (number != ""), F.concat(F.lit("https://ar5iv.org/html/"), number))
        .when((host == "ar5iv.org") & path.startswith("/html/"), F.concat(F.lit("https://ar5iv.org"), path))
    )


@F.arrow_udf(StringType())
def plain_text(texts: pa.Array) -> pa.Array:
    """Every character reference decoded (named, decimal, hexadecimal), white space of any script squeezed."""
    return pa.array([None if t is None else re.sub(r"\s+", " ", html.unescape(t)).strip() for t in texts.to_pylist()], pa.string())


_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.arrow_udf(StringType())
def plain_text_of_ended(texts: pa.Array) -> pa.Array:
    """As ``plain_text``, but only references that end in ``;`` are decoded: ``&amp x`` stays."""
    decode = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return pa.array([None if t is None else re.sub(r"\s+", " ", _ENDED.sub(decode, t)).strip() for t in texts.to_pylist()], pa.string())


def strip_html(c: Column | str, ended: bool = False) -> Column:
    """Text without script, style and tags, character references decoded (with ``ended`` only those
    that end in ``;``), white space squeezed."""
    s = F.regexp_replace(col(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return (plain_text_of_ended if ended else plain_text)(F.regexp_replace(s, "<[^>]+>", " "))
