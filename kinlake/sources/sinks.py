"""Results as CSV, JSON and JSON-LD."""

from __future__ import annotations

import base64
import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 300


def labelled(records: DataFrame, labels: DataFrame, rid: str = "rid", name: str = "cluster") -> DataFrame:
    """The records with their label first."""
    named = labels.select(F.col("rid").alias("__rid"), F.col("label").alias(name))
    return records.join(named, records[rid] == F.col("__rid")).select(name, *(records[c] for c in records.columns))


def write_labelled(records: DataFrame, labels: DataFrame, path: str, rid: str = "rid") -> None:
    labelled(records, labels, rid).write.mode("overwrite").csv(path, header=True, escape='"')


def head(records: DataFrame, labels: DataFrame, rid: str = "rid", n: int = HEAD) -> DataFrame:
    return labelled(records, labels, rid, "__cluster").orderBy(rid).limit(n)


def csv_base64(df: DataFrame, max_rows: int = 10_000) -> str:
    """A small table as base64 CSV text; more than ``max_rows`` rows are refused."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write files instead")
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(rows)
    return base64.b64encode(out.getvalue().encode()).decode()


def result_json(quality: DataFrame | None, sizes: DataFrame, config: dict, warnings: list[str], top: int = 12) -> str:
    """A run's summary: measures, the largest clusters, settings and warnings."""
    got = quality.first().asDict() if quality is not None and not quality.isEmpty() else None
    return json.dumps({"metrics": got, "cluster_sizes": [r["size"] for r in sizes.limit(top).collect()], "config": config, "warnings": warnings}, ensure_ascii=False)


def write_two(records: DataFrame, gold: DataFrame, path: str) -> None:
    records.write.mode("overwrite").csv(f"{path}/records", header=True, escape='"')
    gold.write.mode("overwrite").csv(f"{path}/gold", header=True, escape='"')


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document per line."""
    documents.select(column).write.mode("overwrite").text(path)
