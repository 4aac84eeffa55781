"""Column profiles.  One pass turns the table into ``(column, value, rid)`` counts; nothing is sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names that mark a truth column, and the pattern of identifiers.
TRUTH_NAMES = ["truth", "gold", "gold_truth", "true_label", "true_labels", "label", "labels", "target"]
ID_LIKE = r"(?i)(^|_)id$"


def long_values(records: DataFrame, columns: list[str], rid: str = "rid") -> DataFrame:
    """``(column, rid, value)``: trimmed text, NULL when blank."""
    value = lambda c: F.nullif(F.regexp_replace(F.col(c).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns))
    return records.select(F.col(rid).alias("rid"), F.explode(cells).alias("x")).select("x.column", "rid", "x.value")


def _value_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("rid").alias("first"))


def id_like(column: Column) -> Column:
    return F.trim(column).rlike(ID_LIKE)


def column_profile(records: DataFrame, columns: list[str], rid: str = "rid", truth: str | None = None) -> DataFrame:
    """Per column: missing, distinct, type, role, and numeric or text statistics."""
    counts = _value_counts(long_values(records, columns, rid))
    number = F.expr("try_cast(value AS double)")
    some = F.col("value").isNotNull()
    sums = counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("n_missing"), F.count("value").alias("n_unique"),
        F.bool_and(F.when(some, number.isNotNull())).alias("numeric"), F.min(number).alias("low"), F.max(number).alias("high"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"),
        (F.sum(F.when(some, F.length("value") * F.col("n"))) / F.sum(F.when(some, F.col("n")))).alias("avg_len"),
    )
    unique = (F.col("n") > 1) & (F.col("n_unique") == F.col("n"))
    dtype = F.when(id_like(F.col("column")) | unique, "id").when(F.coalesce("numeric", F.lit(False)), "numeric").otherwise("text")
    named = F.lower(F.trim("column")).isin(TRUTH_NAMES) | (F.col("column") == F.lit(truth) if truth else F.lit(False))
    role = (
        F.when(named, "truth").when(F.col("n_missing") == F.col("n"), "exclude").when(unique, F.when(id_like(F.col("column")), "id").otherwise("exclude"))
        .when(id_like(F.col("column")), "id").otherwise("feature")
    )
    is_number, is_text = F.col("dtype") == "numeric", F.col("dtype") == "text"
    return sums.withColumns({"dtype": dtype, "role": role}).select(
        F.col("column").alias("name"), "n_missing", F.round(100.0 * F.col("n_missing") / F.col("n"), 1).alias("missing_pct"), "n_unique", "dtype", "role",
        F.when(is_number, F.round("low", 4)).alias("min"), F.when(is_number, F.round("high", 4)).alias("max"), F.when(is_number, F.round("mean", 4)).alias("mean"),
        F.when(is_text, F.round("avg_len", 1)).alias("avg_len"),
    )


def samples(records: DataFrame, columns: list[str], rid: str = "rid", n: int = 3) -> DataFrame:
    """The first ``n`` values of each column."""
    order = Window.partitionBy("column").orderBy("rid")
    return long_values(records, columns, rid).where("value IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.col("column").alias("name"), "place", F.substring("value", 1, 60).alias("value"))


def top_values(records: DataFrame, columns: list[str], rid: str = "rid", n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each column, earlier ones first among equals."""
    counts = _value_counts(long_values(records, columns, rid)).where("value IS NOT NULL")
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.col("column").alias("name"), "place", F.substring("value", 1, 60).alias("value"), "n")


def truth_summary(records: DataFrame, truth: str) -> DataFrame:
    """One row: entities, labelled records, sizes."""
    sizes = records.where(F.trim(F.col(truth).cast("string")) != "").groupBy(truth).agg(F.count("*").alias("s"))
    return sizes.agg(
        F.count("*").alias("n_entities"), F.sum("s").alias("n_labeled"), F.min("s").alias("size_min"), F.max("s").alias("size_max"),
        F.round(F.avg("s"), 1).alias("size_mean"), F.count_if(F.col("s") == 1).alias("n_singletons"),
    ).where("n_entities > 0")


def truth_histogram(records: DataFrame, truth: str) -> DataFrame:
    sizes = records.where(F.trim(F.col(truth).cast("string")) != "").groupBy(truth).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("entities")).orderBy("size")


def complete_records(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row: records, those without a blank cell, and blank cells in all."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    holes = sum((blank(c).cast("long") for c in columns), F.lit(0).cast("long"))
    return records.agg(F.count("*").alias("n"), F.count_if(holes == 0).alias("n_complete"), F.coalesce(F.sum(holes), F.lit(0)).alias("missing_cells"))


def suggested_fields(records: DataFrame, columns: list[str], rid: str = "rid", k: int = 2) -> list[str]:
    """The first ``k`` columns that are neither identifiers nor all distinct; else the first ``k``."""
    got = {r["name"]: r for r in column_profile(records, columns, rid).select("name", "n_unique", "n_missing").collect()}
    n = records.count()
    import re

    fit = [c for c in columns if not re.search(ID_LIKE, c.strip()) and not (n > 1 and got[c]["n_unique"] + (got[c]["n_missing"] > 0) == n)]
    return fit[:k] or columns[:k]


def smart_key(columns: list[str]) -> str | None:
    """A column that ends in ``name`` or ``title``, else the first."""
    return next((c for c in columns if c.lower().endswith(("name", "title"))), columns[0] if columns else None)


def guess_truth(columns: list[str]) -> str | None:
    return next((c for c in columns if c.strip().lower() in TRUTH_NAMES), None)


def without_truth(fields: dict[str, str], truth: str | None) -> dict[str, str]:
    """Match fields without the truth column; an error when none is left."""
    left = {c: m for c, m in fields.items() if c != truth}
    if fields and not left:
        raise ValueError("the truth column can't be the only match field")
    return left
