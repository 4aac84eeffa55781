"""Truth, gold pairs, splits and samples.  Unknown truth is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.functions.text import clean
from kinlake.operators.blocking import pairs_within
from kinlake.operators.components import connected_components
from kinlake.operators.ordering import global_rank, running_total


SEED = 42


def shuffled(seed: int, c: str) -> Column:
    """A deterministic random order: the same text hash in Spark and in SQL."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string")))


def compact(labels: DataFrame, label: str = "label", rid: str = "rid") -> DataFrame:
    """Labels renumbered from 0 in the order of their first record."""
    firsts = labels.groupBy(label).agg(F.min(rid).alias("__first"))
    numbered = global_rank(firsts, [F.col("__first")], "__new")
    return labels.join(numbered, labels[label].eqNullSafe(numbered[label])).select(labels[rid], F.col("__new").alias(label))


def from_column(records: DataFrame, column: str, rid: str = "rid", blank_is_entity: bool = False) -> DataFrame:
    """``(rid, truth)`` numbered by first appearance; blank values are unknown unless ``blank_is_entity``."""
    value = F.trim(F.col(column).cast("string"))
    value = F.coalesce(value, F.lit("")) if blank_is_entity else F.nullif(value, F.lit(""))
    rows = records.select(F.col(rid).alias("rid"), value.alias("value"))
    known = compact(rows.where("value IS NOT NULL"), "value").withColumnRenamed("value", "truth")
    return rows.select("rid").join(known, "rid", "left")


def from_labels(records: DataFrame, labels: DataFrame, record_id: str, label_id: str, cluster: str, line: str | None = None) -> DataFrame:
    """Truth from a labels table: ids trimmed, the last of repeated ids wins, blank clusters unknown."""
    key = lambda c: F.trim(F.col(c).cast("string"))
    order = F.col(line) if line else F.monotonically_increasing_id()
    last = labels.select(key(label_id).alias("__id"), F.nullif(key(cluster), F.lit("")).alias("truth"), order.alias("__line")).groupBy("__id").agg(F.max_by("truth", "__line").alias("truth"))
    return records.join(last, key(record_id) == F.col("__id"), "left").drop("__id")


def from_pairs(records: DataFrame, pairs: DataFrame, rid: str = "rid", a: str = "a", b: str = "b") -> DataFrame:
    """``(rid, truth)``: components of the pairs whose both ends exist; records in none are unknown."""
    ids = records.select(F.col(rid).alias("rid"))
    known = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    known = known.join(ids.withColumnRenamed("rid", "src"), "src", "left_semi").join(ids.withColumnRenamed("rid", "dst"), "dst", "left_semi")
    comp = connected_components(known).select(F.col("node").alias("rid"), F.col("component").alias("truth"))
    return ids.join(comp, "rid", "left")


def gold_pairs(truth: DataFrame, column: str = "truth", rid: str = "rid") -> DataFrame:
    """All pairs of records of one entity."""
    return pairs_within(truth.select(F.col(rid).alias("rid"), F.col(column).alias("key")).where("key IS NOT NULL"))


def pair_labels(pairs: DataFrame, truth: DataFrame, column: str = "truth", rid: str = "rid") -> DataFrame:
    """``pairs`` whose both ends are known, with ``y``: 1 for the same entity, else 0."""
    end = lambda e: truth.where(F.col(column).isNotNull()).select(F.col(rid).alias(e), F.col(column).alias(f"__{e}"))
    return pairs.join(end("i"), "i").join(end("j"), "j").withColumn("y", (F.col("__i") == F.col("__j")).cast("int")).drop("__i", "__j")


def entity_split(truth: DataFrame, column: str = "truth", share: float = 0.7, seed: int = SEED, least: int = 10) -> DataFrame:
    """``(truth, part)``: ``floor(share * entities)`` of them in hashed order are ``train``, the
    others ``test``; with fewer than ``least`` entities all are ``both``."""
    entities = truth.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("size"))
    total = entities.count()
    if total < least:
        return entities.withColumn("part", F.lit("both")).select(column, "size", "part")
    ranked = global_rank(entities, [shuffled(seed, column), F.col(column)], "__rank")
    return ranked.withColumn("part", F.when(F.col("__rank") < int(share * total), "train").otherwise("test")).select(column, "size", "part")


def record_split(truth: DataFrame, column: str = "truth", share: float = 0.7, seed: int = SEED) -> DataFrame:
    """As :func:`entity_split`, but whole entities are taken until ``share`` of the records is reached."""
    entities = truth.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("size"))
    total = truth.where(F.col(column).isNotNull()).count()
    taken = running_total(entities, [shuffled(seed, column), F.col(column)], F.col("size"), "__taken")
    return taken.withColumn("part", F.when(F.col("__taken") < share * total, "train").otherwise("test")).select(column, "size", "part")


def cluster_sample(truth: DataFrame, target: int, column: str = "truth", seed: int = SEED) -> DataFrame:
    """Records of whole entities, in hashed order until ``target`` records are reached."""
    sizes = truth.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__size"))
    kept = running_total(sizes, [shuffled(seed, column), F.col(column)], F.col("__size"), "__taken").where(F.col("__taken") < target).select(column)
    return truth.join(kept, column, "left_semi")


def cluster_sample_capped(truth: DataFrame, cap: int, column: str = "truth", seed: int = SEED) -> DataFrame:
    """Records of whole entities, in hashed order, skipping an entity that would go past ``cap``.

    Skipping depends on all before, so sizes are read in order; at most ``cap`` entities are taken.
    """
    sizes = truth.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("size")).orderBy(shuffled(seed, column), column)
    taken, total = [], 0
    for row in sizes.toLocalIterator():
        if total + row["size"] > cap and taken:
            continue
        taken.append((row[column],))
        total += row["size"]
        if total >= cap:
            break
    kept = truth.sparkSession.createDataFrame(taken, truth.select(column).schema) if taken else truth.select(column).limit(0)
    return truth.join(kept, column, "left_semi")


def row_sample(records: DataFrame, n: int, rid: str = "rid", seed: int = SEED) -> DataFrame:
    """``n`` records, the same ones each time."""
    return records.orderBy(shuffled(seed, rid), rid).limit(n)


def key_statistics(records: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, of cleaned values: distinct ones, groups of two and more, the largest, and pairs."""
    long = records.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), clean(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    groups = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return groups.groupBy("column").agg(
        F.count("*").alias("distinct_values"), F.count_if(F.col("n") >= 2).alias("groups"), F.max("n").alias("largest"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")
    )


