"""Queries of the document segmenter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.operators import segment as S
from kinlake.plans.entries import query
from kinlake.session import table


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return S.text_sections(table(spark, sf, "documents"))


@query()
def text_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as sections; blank-line blocks are held against brute force in the tests."""
    return sections(spark, sf).select("doc_id", "position", "title", F.md5("body").alias("body_md5"))


_CUES = {k: " + ".join(f"(length(s) - length(replace(s, '{c}', ''))) // {len(c)}" for c in v) for k, v in S.KEYWORDS.items()}
_RULES = " ".join(f"WHEN contains(t, '{c}') THEN '{k}'" for c, k in S.TITLE_RULES)
_SKIP = " OR ".join(f"contains(t, '{c}')" for c in S.SKIP_TITLES)


@query(
    f"""WITH c AS (SELECT conv_id AS doc_id, turn, role AS title, text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
x AS (SELECT *, lower(title) AS t, lower(title || ' ' || substr(body, 1, 1200)) AS s FROM c),
k AS (SELECT *, [{", ".join(f"({_CUES[k]})" + (" + CASE WHEN position = 0 THEN 2 ELSE 0 END" if k == "MotivationProblem" else " + CASE WHEN position = n - 1 THEN 2 ELSE 0 END" if k == "ConclusionExtensions" else "") for k, _ in S.TYPES)}] AS v FROM x),
b AS (SELECT *, list_max(v) AS best, list_position(v, list_max(v)) AS place, list_reverse_sort(v)[2] AS second FROM k)
SELECT doc_id, position, CASE WHEN {_SKIP} THEN NULL {_RULES} WHEN best = 0 THEN 'MotivationProblem' ELSE {[k for k, _ in S.TYPES]}[place] END AS component_type,
CASE WHEN {_SKIP} THEN 0.0 {" ".join(f"WHEN contains(t, '{c}') THEN 0.95" for c, _ in S.TITLE_RULES)} WHEN best = 0 THEN 0.5 ELSE round(0.55 + 0.40 * (best - second) / ((best - second) + 2), 2) END::DOUBLE AS confidence FROM b"""
)
def section_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as sections: their role is the title."""
    from pyspark.sql.window import Window

    c = table(spark, sf, "conversations")
    position = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("position")
    found = S.classify_sections(c.select(F.col("conv_id").alias("doc_id"), F.lit("").alias("doc_title"), position, F.col("role").alias("title"), F.col("text").alias("body")))
    return found.select("doc_id", "position", "component_type", "confidence")


@query()
def component_graph(spark: SparkSession, sf: str) -> DataFrame:
    found = S.components(S.classify_sections(sections(spark, sf)))
    return found.select("doc_id", "comp_id", "component_type", "order", "confidence", F.length("text").alias("n_chars"))


@query()
def json_ld(spark: SparkSession, sf: str) -> DataFrame:
    return S.json_ld(S.components(S.classify_sections(sections(spark, sf)))).select("doc_id", "n_components", F.md5("document").alias("document_md5"))


@query("SELECT page_id AS doc_id, 0 AS sections FROM pages WHERE FALSE")
def section_split(spark: SparkSession, sf: str) -> DataFrame:
    """The pages hold none of the markup that papers have; a paper is split in the tests."""
    return S.html_sections(table(spark, sf, "pages")).groupBy("doc_id").agg(F.count("*").cast("int").alias("sections"))
