"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlake.llm import decontaminate, embedding_dedup, html_extract, jaccard_join, licenses, packing, sharding, toxicity, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
    "op2_sharding": sharding.op2_sharding,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_warc": warc.op6_warc,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filter": url_rules.op9_url_filter,
    "op10_packing": packing.op10_packing,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": jaccard_join.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
}
