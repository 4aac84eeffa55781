"""Queries of truth attachment, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.operators import truth
from kinlake.operators.components import connected_components
from kinlake.plans.entries import query
from kinlake.plans.q_budget import vectors
from kinlake.session import table

FIRST = "f AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS truth FROM embeddings WHERE label IS NOT NULL GROUP BY label)"


@query(f"WITH {FIRST} SELECT vec_id AS rid, truth FROM embeddings LEFT JOIN f USING (label)")
def truth_from_column(spark: SparkSession, sf: str) -> DataFrame:
    return truth.from_column(table(spark, sf, "embeddings"), "label", "vec_id")


@query("SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS truth FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def truth_from_labels(spark: SparkSession, sf: str) -> DataFrame:
    return truth.from_labels(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "doc_id", "quality")


COPIES = "c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id), e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a, min(b) AS truth FROM r GROUP BY a)"


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents of one text: each with the first."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    return docs.join(first, "h").where("doc_id != a").select("a", F.col("doc_id").alias("b"))


@query(f"WITH RECURSIVE {COPIES} SELECT doc_id AS rid, CAST(truth AS VARCHAR) AS truth FROM documents LEFT JOIN m ON doc_id = a")
def truth_from_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return truth.from_pairs(table(spark, sf, "documents"), _copies(spark, sf), "doc_id").withColumn("truth", F.col("truth").cast("string"))


@query(f"WITH RECURSIVE {COPIES} SELECT a AS node, truth AS component FROM m")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(_copies(spark, sf), "a", "b")


@query("SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def gold_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return truth.gold_pairs(vectors(spark, sf))


@query("SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS y FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 20")
def pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    near = v.select(F.col("rid").alias("i"), F.explode(F.sequence(F.col("rid") + 1, F.col("rid") + 20)).alias("j"))
    return truth.pair_labels(near, v)


# entities: the parts' names
NAMES = "n AS (SELECT p_name AS truth, count(*) AS size, md5(concat_ws('|', '42', p_name)) AS h FROM part GROUP BY p_name)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("truth"))


@query(f"WITH {NAMES} SELECT truth, size, CASE WHEN row_number() OVER (ORDER BY h, truth) <= floor(0.7 * (SELECT count(*) FROM n)) THEN 'train' ELSE 'test' END AS part FROM n")
def entity_split(spark: SparkSession, sf: str) -> DataFrame:
    return truth.entity_split(_names(spark, sf))


@query(f"WITH {NAMES} SELECT truth, size, CASE WHEN coalesce(sum(size) OVER (ORDER BY h, truth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.7 * (SELECT count(*) FROM part) THEN 'train' ELSE 'test' END AS part FROM n")
def record_split(spark: SparkSession, sf: str) -> DataFrame:
    return truth.record_split(_names(spark, sf))


@query(f"WITH {NAMES}, k AS (SELECT truth FROM (SELECT truth, coalesce(sum(size) OVER (ORDER BY h, truth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) WHERE before < 500) SELECT p_partkey AS rid, p_name AS truth FROM part WHERE p_name IN (SELECT truth FROM k)")
def cluster_sample(spark: SparkSession, sf: str) -> DataFrame:
    return truth.cluster_sample(_names(spark, sf), 500).select("rid", "truth")


@query()
def cluster_sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Whole entities up to 500 records; skipping is sequential, so it is tested against brute force."""
    return truth.cluster_sample_capped(_names(spark, sf), 500).select("rid", "truth")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat_ws('|', '42', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 100")
def row_sample(spark: SparkSession, sf: str) -> DataFrame:
    return truth.row_sample(table(spark, sf, "customer").select("c_custkey", "c_name"), 100, "c_custkey")


_KEYS = ["p_name", "p_brand", "p_type", "p_size"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS distinct_values, count(*) FILTER (WHERE n >= 2) AS groups, max(n) AS largest, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM part GROUP BY lower(trim(CAST({c} AS VARCHAR))))" for c in _KEYS))
def key_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return truth.key_statistics(table(spark, sf, "part"), _KEYS)


@query("SELECT vec_id AS rid, dense_rank() OVER (ORDER BY first) - 1 AS label FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings)")
def compact_labels(spark: SparkSession, sf: str) -> DataFrame:
    return truth.compact(vectors(spark, sf).select("rid", F.col("truth").alias("label")))


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def drop_unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")
