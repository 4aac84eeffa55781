"""Queries of links and of the ways to group records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake import registry
from kinlake.functions.similarity import score_pairs
from kinlake.operators import blocking as B
from kinlake.operators import budget, grouping, metrics
from kinlake.operators.neighbors import cosine_pairs
from kinlake.operators.vector_groups import VECTORS, leiden, vectors_each
from kinlake.plans.entries import QUERIES, query
from kinlake.plans.q_blocking import PARTS, SAME, parts
from kinlake.plans.q_budget import STUBS, stubs, vectors
from kinlake.plans.q_similarity import BRAND, JC_TYPE, LV_NAME
from kinlake.session import stash


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    return score_pairs(B.block_standard(p, "p_brand"), p, {"p_name": "lv", "p_type": "jaccard"})


@query(f"WITH {PARTS}, {BRAND} SELECT i, j, round(({LV_NAME} + {JC_TYPE}) / 2, 6) AS score FROM c WHERE round(({LV_NAME} + {JC_TYPE}) / 2, 9) >= 0.6")
def threshold_links(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where(F.round("score", 9) >= 0.6).select("i", "j", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {PARTS}, {SAME}, e AS (SELECT i, j FROM c UNION SELECT j, i FROM c), r AS (SELECT rid AS a, rid AS b FROM p UNION SELECT r.a, e.j FROM r JOIN e ON r.b = e.i), m AS (SELECT a AS rid, min(b) AS first FROM r GROUP BY a) SELECT rid, dense_rank() OVER (ORDER BY first) - 1 AS label FROM m")
def transitive_closure(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    return grouping.transitive_closure(B.block_standard(p, "p_key"), p)


@query(f"WITH {STUBS}, q AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(cos) AS score FROM s GROUP BY 1, 2) SELECT q.i, q.j, round(score, 6) AS score FROM q JOIN embeddings a ON q.i = a.vec_id JOIN embeddings b ON q.j = b.vec_id WHERE a.label = b.label")
def community_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pool pairs inside the labels taken as communities."""
    groups = vectors(spark, sf).select("rid", F.col("truth").alias("label"))
    return grouping.community_links(budget.pool_pairs(stubs(spark, sf)), groups).select("i", "j", F.round("score", 6).alias("score"))


@query(f"WITH {STUBS}, q AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM s) SELECT count(*) AS pairs, count(*) FILTER (WHERE a.label <> b.label) AS across FROM q JOIN embeddings a ON q.i = a.vec_id JOIN embeddings b ON q.j = b.vec_id")
def cross_community(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    end = lambda e: v.select(F.col("rid").alias(e), F.col("truth").alias(f"t_{e}"))
    return budget.pool_pairs(stubs(spark, sf)).join(end("i"), "i").join(end("j"), "j").agg(F.count("*").alias("pairs"), F.count_if(F.col("t_i") != F.col("t_j")).alias("across"))


def _vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of all pairs above 0.1 as scores."""
    return stash(cosine_pairs(vectors(spark, sf), 0.1).where("cos > 0.1").withColumnRenamed("cos", "score"))


def _community_query(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v, pairs = vectors(spark, sf).select("rid"), _vector_pairs(spark, sf)
        return registry.COMMUNITIES[name](pairs, v)

    return run


def _cluster_query(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pairs = _vector_pairs(spark, sf)
        return registry.CLUSTERERS[name](pairs.where("score >= 0.3"), pairs, vectors(spark, sf).select("rid"))

    return run


def _graph_query(name: str, least: float = 0.1, **options):
    """As the pairs of :func:`_vector_pairs`, which aren't made."""
    return lambda spark, sf: VECTORS[name](vectors(spark, sf).select("rid", "v"), least, **options)


# iterative groupings without a SQL form: held against brute force and known answers in the tests.
# Those that need all distances at once run on points, in one task.
QUERIES["louvain_groups"] = _community_query("louvain")
QUERIES["gc_groups"] = _graph_query("gc", 0.3)
for _name in ("leiden", "label_prop"):
    QUERIES[f"{_name}_groups"] = _graph_query(_name)
for _name in ("center", "mc"):
    QUERIES[f"{_name}_clusters"] = _cluster_query(_name)
QUERIES["hc_clusters"] = _graph_query("hc", hc_h=0.6)


def _dense(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """All suppliers by account balance and nation; their distances are made in the one task."""
    from kinlake.session import table

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rid"), (F.col("s_acctbal") / 10_000).alias("x"), (F.col("s_nationkey") / 25).alias("y"))
    return grouping.POINTS[name](s, ["x", "y"], **({"min_points": 5} if name == "hdbscan" else {}))


def _dense_query(name: str):
    return lambda spark, sf: _dense(spark, sf, name)


for _name in ("hclust_avg", "hclust_ward", "pam", "hdbscan"):
    QUERIES[f"{_name}_groups"] = _dense_query(_name)


@query()
def louvain_communities(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.louvain_communities(_vector_pairs(spark, sf), vectors(spark, sf).select("rid"))


@query()
def leiden_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of Leiden groups at three resolutions."""
    v, out, tried = vectors(spark, sf), None, (0.5, 1.0, 1.5)
    for r, labels in zip(tried, vectors_each(v.select("rid", "v"), leiden, 0.1, [{"resolution": r} for r in tried]), strict=True):
        row = metrics.quality(labels.join(v.select("rid", "truth"), "rid")).select(F.lit(r).alias("resolution"), F.round("ari", 4).alias("ari"), F.round("pair_f1", 4).alias("pair_f1"))
        out = row if out is None else out.unionByName(row)
    return out
