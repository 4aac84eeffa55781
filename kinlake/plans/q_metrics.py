"""Queries of the quality measures: the embeddings' label against a made-up grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.operators import metrics
from kinlake.operators.neighbors import cosine_sums
from kinlake.plans.entries import query
from kinlake.plans.q_budget import ALL, vectors
from kinlake.session import table

LABELS = "l AS (SELECT vec_id AS rid, label AS truth, CASE WHEN vec_id % 11 < 8 THEN label ELSE 100 + vec_id % 17 END AS label FROM embeddings)"
CELLS = f"{LABELS}, n AS (SELECT truth, label, count(*) AS n FROM l WHERE truth IS NOT NULL GROUP BY 1, 2), t AS (SELECT truth, sum(n) AS t FROM n GROUP BY 1), p AS (SELECT label, sum(n) AS p FROM n GROUP BY 1)"
SUMS = f"""{CELLS}, s AS (SELECT (SELECT sum(n) FROM n)::DOUBLE AS n, (SELECT sum(n * (n - 1) / 2) FROM n) AS tp, (SELECT sum(t * (t - 1) / 2) FROM t) AS ct, (SELECT sum(p * (p - 1) / 2) FROM p) AS cp,
(SELECT sum(n * n / p) FROM n JOIN p USING (label)) AS bp, (SELECT sum(n * n / t) FROM n JOIN t USING (truth)) AS br,
(SELECT sum(n / (SELECT sum(n) FROM n) * ln(n * (SELECT sum(n) FROM n) / (t * p))) FROM n JOIN t USING (truth) JOIN p USING (label)) AS mi,
(SELECT -sum(t / (SELECT sum(n) FROM n) * ln(t / (SELECT sum(n) FROM n))) FROM t) AS ht, (SELECT -sum(p / (SELECT sum(n) FROM n) * ln(p / (SELECT sum(n) FROM n))) FROM p) AS hp,
(SELECT sum(t * t) FROM t) AS st, (SELECT sum(p * p) FROM p) AS sp, (SELECT sum(n * n) FROM n) AS sn,
(SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY truth)) AS bt, (SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY label)) AS bl)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    made = F.when(F.col("rid") % 11 < 8, F.col("truth")).otherwise(100 + F.col("rid") % 17)
    return vectors(spark, sf).select("rid", "truth", made.alias("label"))


def _measures(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    q = metrics.quality(_labels(spark, sf))
    return q.select(*(F.round(F.col(n).cast("double"), 6).alias(n) for n in names))


@query(f"WITH {CELLS} SELECT truth, label, n FROM n")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.contingency(_labels(spark, sf))


@query(f"WITH {SUMS} SELECT round((tp - ct * cp / (n * (n - 1) / 2)) / ((ct + cp) / 2 - ct * cp / (n * (n - 1) / 2)), 6) AS ari FROM s")
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "ari")


@query(f"WITH {SUMS} SELECT round(tp / cp, 6) AS pair_p, round(tp / ct, 6) AS pair_r, round(2 * (tp / cp) * (tp / ct) / (tp / cp + tp / ct), 6) AS pair_f1 FROM s")
def pairwise_prf(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "pair_p", "pair_r", "pair_f1")


@query(f"WITH {SUMS} SELECT round(bp / n, 6) AS b3_p, round(br / n, 6) AS b3_r, round(2 * (bp / n) * (br / n) / ((bp + br) / n), 6) AS b3_f1 FROM s")
def b_cubed(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "b3_p", "b3_r", "b3_f1")


@query(f"WITH {SUMS} SELECT round((n * (n - 1) / 2 + 2 * tp - ct - cp) / (n * (n - 1) / 2), 6) AS rand, round(tp / sqrt(ct * cp), 6) AS fowlkes_mallows, round(tp / (ct + cp - tp), 6) AS jaccard, round(st + sp - 2 * sn, 6)::DOUBLE AS mirkin FROM s")
def pair_indices(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "rand", "fowlkes_mallows", "jaccard", "mirkin")


@query(f"WITH {SUMS} SELECT round(ht, 6) AS entropy_truth, round(hp, 6) AS entropy_label, round(mi, 6) AS mutual_information, round(2 * mi / (ht + hp), 6) AS nmi, round(ht + hp - 2 * mi, 6) AS vi, round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) AS v_measure FROM s")
def information_indices(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "entropy_truth", "entropy_label", "mutual_information", "nmi", "vi", "homogeneity", "completeness", "v_measure")


@query(f"WITH {SUMS} SELECT (2 * n - bt - bl)::DOUBLE AS van_dongen, round(bl / n, 6) AS max_match, n AS n_truth FROM s")
def set_matching(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "van_dongen", "max_match", "n_truth")


@query(f"WITH {LABELS} SELECT label, count(*) AS size FROM l GROUP BY label")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cluster_sizes(_labels(spark, sf))


@query(f"WITH {LABELS}, s AS (SELECT count(*) AS c FROM l GROUP BY label) SELECT round(max(c) / sum(c), 9) AS share, count(*) AS n_clusters, max(c) / sum(c) > 0.5 AS warning FROM s")
def dominance_share(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.dominance(_labels(spark, sf)).withColumn("share", F.round("share", 9))


@query(f"WITH {LABELS} SELECT (SELECT count(*) FROM (SELECT DISTINCT truth, label FROM l)) = (SELECT count(DISTINCT truth) FROM l) AND (SELECT count(*) FROM (SELECT DISTINCT truth, label FROM l)) = (SELECT count(DISTINCT label) FROM l) AS same")
def same_partition(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.same_partition(_labels(spark, sf), "truth", "label")


@query(
    f"""WITH {ALL}, m AS (SELECT i, a.label AS own, b.label AS other, avg(1 - cos) AS d FROM x JOIN embeddings a ON i = a.vec_id JOIN embeddings b ON j = b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT i, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM m GROUP BY i)
SELECT i AS rid, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM s"""
)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).where("v IS NOT NULL")
    labels = v.select("rid", F.col("truth").alias("label"))
    return metrics.silhouette_of_sums(cosine_sums(v, labels), labels).withColumn("silhouette", F.round("silhouette", 6))


# runs: months of orders as runs of a study
RUNS = "r AS (SELECT date_trunc('month', o_orderdate) AS ts, count(*) AS pairs, round(avg(o_totalprice), 4) AS ari, CASE WHEN count(*) % 2 = 0 THEN 'a' ELSE 'b' END AS method FROM orders GROUP BY 1)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.count("*").alias("pairs"), F.round(F.avg("o_totalprice"), 4).alias("ari"))
    return months.withColumn("method", F.when(F.col("pairs") % 2 == 0, "a").otherwise("b"))


@query(f"WITH {RUNS} SELECT strftime(ts, '%Y-%m') AS month, method <> first(method) OVER (ORDER BY ts) AS method_changed, ari = max(ari) OVER () AS ari_best, round(ari - lag(ari) OVER (ORDER BY ts), 3) AS ari_delta FROM r")
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.compare_runs(_runs(spark, sf), ["method"], ["ari"])
    return out.select(F.date_format("ts", "yyyy-MM").alias("month"), "method_changed", "ari_best", F.round("ari_delta", 3).alias("ari_delta"))


@query(f"WITH {RUNS}, k AS (SELECT * FROM r WHERE month(ts) <= 6), m AS (SELECT * FROM r WHERE month(ts) >= 5) SELECT strftime(ts, '%Y-%m') AS month, pairs FROM k UNION ALL SELECT strftime(m.ts, '%Y-%m'), m.pairs FROM m ANTI JOIN k ON m.ts = k.ts")
def run_import(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).withColumn("id", F.date_format("ts", "yyyy-MM"))
    merged = metrics.merge_runs(runs.where(F.month("ts") <= 6), runs.where(F.month("ts") >= 5))
    return merged.select(F.col("id").alias("month"), "pairs")


@query(f"WITH {RUNS} SELECT strftime(ts, '%Y-%m') AS id, CASE WHEN strftime(ts, '%Y-%m') = '1995-03' THEN 'renamed' ELSE method END AS name, pairs FROM r WHERE strftime(ts, '%Y-%m') <> '1995-01' AND year(ts) = 1995")
def run_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of 1995 without one, another renamed."""
    runs = _runs(spark, sf).select(F.date_format("ts", "yyyy-MM").alias("id"), F.col("method").alias("name"), "pairs")
    months = [f"1995-{m:02}" for m in range(1, 13)]
    return metrics.edit_runs(runs, drop=["1995-01"], rename={"1995-03": "renamed"}, keep=months)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 17")
def jump_by_number(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_number(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "no. 17")
