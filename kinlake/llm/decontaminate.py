"""Benchmark decontamination by a hash set of normalised word windows.

Words are runs of ASCII letters and digits and of any other non-ASCII characters,
A-Z lower-cased.  A benchmark item gives every window of ten consecutive words, an
item of fewer words the whole of it.  A window is known by 128 bits: two hashes of
the hashes of its words.  Training texts are cut into small pieces of words, so that a
long text is no long row; the first hash of every window is looked up in the
broadcast set, and the second verifies the hit.

The set is broadcast up to ``WINDOWS_AT_ONCE`` windows.  A larger benchmark is dealt by
hash into as many sets as it takes, each held against the corpus in a scan of its own,
so windows of training texts are never shuffled.  Only hits and narrow per-document
columns are.

Edge cases: null or wordless texts have no words and no hits; wordless items match
nothing; equal rows get equal results, each its own row; null ids are rows like
others; columns beside ``doc_id``/``text`` and ``item_id``/``text`` are ignored
(and kept by :func:`drop_contaminated`).
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.session import drop_matching, stash, table

WINDOW = 10
PIECES = (16_384, 512, 32)
WINDOWS_AT_ONCE = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _hashed(text: Column) -> Column:
    """A hash for each word of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


WINDOW_TYPE = "array<struct<at:int,width:int,a:bigint,b:bigint>>"


def _windows(of: Column, width: int, first: Column, most: int | None = None) -> Column:
    """``array<struct<at, width, a, b>>`` of the windows of an array of word hashes that starts at word
    ``first``, at most ``most`` of them; empty when there are fewer words."""
    last = F.size(of) - width if most is None else F.least(F.size(of) - width, F.lit(most - 1))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(of, i + 1, width))
    each = F.transform(parts, lambda part, i: F.struct((first + i).alias("at"), F.lit(width).alias("width"), F.xxhash64(part).alias("a"), F.xxhash64(F.lit(width), part).alias("b")))
    return F.when(F.size(of) >= width, each).otherwise(F.array().cast(WINDOW_TYPE))


def _cut(rows: DataFrame, size: int, more: int) -> DataFrame:
    """``(text_a, text_b, at, w)`` cut into pieces of ``size`` words and ``more`` of the next; a slice reads its
    whole array, so long texts are cut in steps."""
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size)), lambda k: F.struct((F.col("at") + k).alias("at"), F.slice("w", k + 1, size + more).alias("w")))
    return rows.select("text_a", "text_b", F.explode(F.when(F.size("w") > size, cut).otherwise(F.array(F.struct("at", "w")))).alias("p")).select("text_a", "text_b", "p.at", "p.w")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, width, a, b)``, distinct; ``item`` is the item id as a string, ``a`` and ``b`` the window's hashes."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), _hashed(F.col("text")).alias("w"))
    each = [_windows(F.col("w"), window, F.lit(0))]  # and for fewer words, the whole
    each += [F.when(F.size("w") == k, _windows(F.col("w"), k, F.lit(0))).otherwise(F.array().cast(WINDOW_TYPE)) for k in range(1, window)]
    return split.select("item", F.explode(F.concat(*each)).alias("g")).select("item", "g.width", "g.a", "g.b").distinct()


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(text_a, text_b, hits, items)`` for each distinct contaminated text: the sorted distinct
    ``(at, width)`` spans, in words, and the sorted ids of items found there."""
    grams = stash(benchmark_windows(benchmark, window), "benchmark-windows")
    known = stash(grams.select("width", "a", "b").distinct(), "benchmark-keys")
    sizes = {r["width"]: r["n"] for r in known.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    widths = sorted(sizes) or [window]
    pieces = documents.select(*text_key(F.col("text")), F.lit(0).alias("at"), _hashed(F.col("text")).alias("w"))
    for size in PIECES:
        pieces = _cut(pieces, size, widths[-1] - 1)
    every = [_windows(F.col("w"), k, F.col("at"), PIECES[-1]) for k in widths]
    spread = pieces.select("text_a", "text_b", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("g")).select("text_a", "text_b", "g.*")
    sets = max(1, -(-sum(sizes.values()) // WINDOWS_AT_ONCE))

    def met(k: int) -> DataFrame:
        some = known.where(F.pmod("a", F.lit(sets)) == k) if sets > 1 else known
        some = some.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("width").alias("__width"))
        found = spread.join(F.broadcast(some), F.col("a") == F.col("__a")).where("b = __b AND width = __width")
        return found.select("text_a", "text_b", "at", "width", "a", "b")

    hits = reduce(DataFrame.unionByName, (met(k) for k in range(sets)))
    return (
        hits.distinct()
        .join(grams, ["width", "a", "b"])
        .groupBy("text_a", "text_b")
        .agg(F.array_sort(F.collect_set(F.struct("at", "width"))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    )


def covered(hits: Column) -> Column:
    """How many words lie inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, hit: Column) -> Column:
        end = hit["at"] + hit["width"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], hit["at"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    hits = stash(find_hits(documents, benchmark, window).withColumnsRenamed({"text_a": "__a", "text_b": "__b"}), "contaminated")
    narrow = documents.select("doc_id", *text_key(F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return (
        narrow.join(hits, (F.col("text_a") == F.col("__a")) & (F.col("text_b") == F.col("__b")), "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    hits = find_hits(documents, benchmark, window).select(F.col("text_a").alias("__a"), F.col("text_b").alias("__b"))
    a, b = text_key(F.col("text"))
    return drop_matching(documents, hits, (a == F.col("__a")) & (b == F.col("__b")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item, 10 AS k, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION
  SELECT item, len(w) AS k, array_to_string(w, ' ') AS gram FROM b WHERE len(w) BETWEEN 1 AND 9
), dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT d.r, d.w, s.k, unnest(range(1, len(d.w) - s.k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM g) s WHERE len(d.w) >= s.k)
), h AS (
  SELECT dw.r, dw.k, dw.i, g.item FROM dw JOIN g ON dw.k = g.k AND dw.gram = g.gram
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""
