"""Queries of the column profiles and of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.operators import profile as P
from kinlake.plans.entries import query
from kinlake.session import table
from kinlake.sources import csv as csv_source
from kinlake.sources import sinks

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def _profile_sql(t: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS name, count(*) FILTER (WHERE v IS NULL) AS n_missing, round(100.0 * count(*) FILTER (WHERE v IS NULL) / count(*), 1)::DOUBLE AS missing_pct, count(DISTINCT v) AS n_unique,
 count(*) > 1 AND count(DISTINCT v) = count(*) AS u, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AS num, min(try_cast(v AS DOUBLE)) AS low, max(try_cast(v AS DOUBLE)) AS high, avg(try_cast(v AS DOUBLE)) AS mean, avg(length(v)) AS len
 FROM (SELECT nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM {t})"""
    rows = " UNION ALL ".join(one.format(c=c, t=t) for c in columns)
    return f"""WITH x AS ({rows}), y AS (SELECT *, CASE WHEN regexp_matches(name, '(^|_)id$', 'i') OR u THEN 'id' WHEN num THEN 'numeric' ELSE 'text' END AS dtype,
CASE WHEN u THEN CASE WHEN regexp_matches(name, '(^|_)id$', 'i') THEN 'id' ELSE 'exclude' END WHEN regexp_matches(name, '(^|_)id$', 'i') THEN 'id' ELSE 'feature' END AS role FROM x)
SELECT name, n_missing, missing_pct, n_unique, dtype, role, CASE WHEN dtype = 'numeric' THEN round(low, 4) END AS min, CASE WHEN dtype = 'numeric' THEN round(high, 4) END AS max,
CASE WHEN dtype = 'numeric' THEN round(mean, 4) END AS mean, CASE WHEN dtype = 'text' THEN round(len, 1) END AS avg_len FROM y"""


@query(_profile_sql("part", PART))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.column_profile(table(spark, sf, "part"), PART, "p_partkey")


@query(_profile_sql("customer", CUSTOMER))
def column_profile_customers(spark: SparkSession, sf: str) -> DataFrame:
    return P.column_profile(table(spark, sf, "customer"), CUSTOMER, "c_custkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, place, v AS value, n FROM (SELECT v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS place FROM (SELECT trim(CAST({c} AS VARCHAR)) AS v, p_partkey FROM part) GROUP BY v) WHERE place <= 5" for c in ("p_name", "p_brand", "p_type")))
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_values(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], "p_partkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, place, substr(v, 1, 60) AS value FROM (SELECT trim(CAST({c} AS VARCHAR)) AS v, row_number() OVER (ORDER BY c_custkey) AS place FROM customer) WHERE place <= 3" for c in CUSTOMER))
def column_samples(spark: SparkSession, sf: str) -> DataFrame:
    return P.samples(table(spark, sf, "customer"), CUSTOMER, "c_custkey")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE trim(c_name) <> '' AND trim(c_mktsegment) <> '' AND c_custkey % 5 <> 0) AS n_complete, count(*) FILTER (WHERE c_custkey % 5 = 0) AS missing_cells FROM customer")
def complete_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth customer gets a blank segment."""
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")))
    return P.complete_records(c, ["c_name", "c_mktsegment"])


@query("SELECT count(*) AS n_entities, CAST(sum(s) AS BIGINT) AS n_labeled, min(s) AS size_min, max(s) AS size_max, round(avg(s), 1) AS size_mean, count(*) FILTER (WHERE s = 1) AS n_singletons FROM (SELECT count(*) AS s FROM part GROUP BY p_name || p_brand)")
def truth_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.truth_summary(table(spark, sf, "part").withColumn("truth", F.concat("p_name", "p_brand")), "truth")


@query("SELECT size, count(*) AS entities FROM (SELECT count(*) AS size FROM part GROUP BY p_name || p_brand) GROUP BY size")
def truth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.truth_histogram(table(spark, sf, "part").withColumn("truth", F.concat("p_name", "p_brand")), "truth")


@query("SELECT unnest(['p_name', 'p_brand']) AS field, unnest([1, 2])::BIGINT AS place")
def suggested_fields(spark: SparkSession, sf: str) -> DataFrame:
    got = P.suggested_fields(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_type"], "p_partkey")
    return spark.createDataFrame([(c, k + 1) for k, c in enumerate(got)], "field string, place long")


@query("SELECT c_custkey, c_name, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, '') AS c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as pipe-delimited text with missing cells and blank rows, and read back."""
    from kinlake.session import new_path

    path = new_path(spark, "csv")
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    blank = spark.createDataFrame([("", "", " ")] * 3, c.schema)
    c.unionByName(blank).write.csv(path, header=True, sep="|", quote='"', escape='"', emptyValue="")
    return csv_source.read_files(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT p_partkey % 50 AS cluster, p_partkey, p_name FROM part")
def labelled_output(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return sinks.labelled(p, p.select(F.col("p_partkey").alias("rid"), (F.col("p_partkey") % 50).alias("label")), "p_partkey")


@query("SELECT p_partkey % 50 AS __cluster, p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 300")
def display_head(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return sinks.head(p, p.select(F.col("p_partkey").alias("rid"), (F.col("p_partkey") % 50).alias("label")), "p_partkey")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND contains(lower(p_name), 'a')")
def faceted_search(spark: SparkSession, sf: str) -> DataFrame:
    """Any of some facets, and all of the others."""
    p = table(spark, sf, "part")
    return p.where(F.arrays_overlap(F.array("p_brand"), F.array(*(F.lit(f"Brand#{k}") for k in (11, 12, 13)))) & F.lower("p_name").contains("a")).select("p_partkey", "p_name", "p_brand")


@query("SELECT CASE WHEN year(o_orderdate) < 1994 THEN 'before 1994' WHEN year(o_orderdate) < 1997 THEN '1994-1996' ELSE 'since 1997' END AS period, o_orderpriority AS facet, count(*) AS n FROM orders GROUP BY 1, 2")
def year_facets(spark: SparkSession, sf: str) -> DataFrame:
    y = F.year("o_orderdate")
    period = F.when(y < 1994, "before 1994").when(y < 1997, "1994-1996").otherwise("since 1997")
    return table(spark, sf, "orders").select(period.alias("period"), F.explode(F.array("o_orderpriority")).alias("facet")).groupBy("period", "facet").agg(F.count("*").alias("n"))
