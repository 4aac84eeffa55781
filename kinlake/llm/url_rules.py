"""URL filtering by explicit rules and by association rules mined with FP-growth.

Explicit rules name a host (with all its subdomains) and a path prefix; the longest
that fits decides.  Elsewhere mined rules do: the URLs of labelled pages become
token sets with their label as one more item, Spark's FP-growth finds frequent sets,
and combinations that predict the label ``block`` with enough confidence and support
are kept, unless a part of them already does as well.  They are matched through an
inverted index from token to rule: a rule holds when all its tokens were met.

Matching runs on distinct URLs, so one hot URL costs one row.  The index is broadcast
only when its counted rows are within ``BROADCAST_ROWS``.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed; equal rows get equal verdicts; with no labels (or only one kind)
nothing is mined and all other URLs are allowed; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.session import stash, table

# The explicit rules (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
BROADCAST_ROWS = 200_000
_BLOCK, _ALLOW = "label:block", "label:allow"
_PARTS = r"^(?s)(.*?)://([^/?#]*)([^?#]*)(.*)$"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 2), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as ``host + path``, and its verdict; both null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host suffixes, words of host and path, query parts and the fragment; digits are one sign."""
    digits = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    tail = F.regexp_extract(url, _PARTS, 4)
    query = F.transform(F.split(F.regexp_extract(tail, r"^\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("query:"), digits(x)))
    steps = F.transform(F.split(path(url), r"[/._-]+"), lambda x: F.concat(F.lit("path:"), digits(x)))
    end = F.array(F.concat(F.lit("fragment:"), F.regexp_extract(tail, r"#(.*)$", 1)), F.concat(F.lit("scheme:"), F.regexp_extract(url, _PARTS, 1)))
    return F.filter(F.array_distinct(F.concat(suffixes, steps, query, end)), lambda x: ~x.endswith(":"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(rule_id, tokens, confidence, support)`` that predict ``block``.

    ``labelled`` has ``url`` and ``block`` (boolean).  A rule is pruned when a rule on a
    proper part of its tokens is at least as confident.
    """
    items = labelled.where(F.col("url").isNotNull() & F.col("block").isNotNull()).select(
        F.concat(url_tokens(F.col("url")), F.array(F.when(F.col("block"), _BLOCK).otherwise(_ALLOW))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", _BLOCK) & ~F.array_contains("antecedent", _ALLOW)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    )
    rules = stash(rules.withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    parts = rules.select(F.col("rule_id").alias("part_id"), F.col("tokens").alias("part"), F.col("confidence").alias("as_good"))
    # a part shares its first token with the whole
    whole = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("first"))
    worse = whole.join(
        parts.withColumn("first", F.element_at("part", 1)),
        "first",
    ).where((F.size("part") < F.size("tokens")) & (F.col("as_good") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
    return rules.join(worse.select("rule_id"), "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` values on which any rule holds, with the best confidence."""
    rules = stash(rules, "url-rules")
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    met = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token")
    whole = met.groupBy("url", "rule_id", "need", "confidence").agg(F.count("*").alias("n")).where(F.col("n") == F.col("need"))
    return whole.groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` rows as ``(page_id, host, path, rule, verdict, confidence)``."""
    blocked = matched_urls(pages, mine_rules(labelled)).withColumnRenamed("url", "__url")
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    return (
        pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        .join(blocked, F.col("url") == F.col("__url"), "left")
        .withColumn("rule", name)
        .withColumn("verdict", F.coalesce(said, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "confidence")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL; a page is labelled ``block`` when its document's quality is 0."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", (F.col("quality") == 0).alias("block"))
    return filter_urls(pages, labelled)
