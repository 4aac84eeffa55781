"""Incremental resolution of a stream: an extension, the batch operators applied batch by batch.

Every micro-batch is paired with itself and with the records seen before that share a
blocking key, scored, and its links are appended.  State is two tables partitioned by
batch, so a batch that is run again replaces its own part and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlake.functions.similarity import score_pairs
from kinlake.functions.text import clean
from kinlake.operators.blocking import keyed, pairs_within
from kinlake.operators.grouping import transitive_closure


class IncrementalResolver:
    """Keeps ``records`` and ``links`` under ``path``."""

    def __init__(self, path: str, fields: dict[str, str], key: str, threshold: float, rid: str = "rid") -> None:
        self.path, self.fields, self.key, self.threshold, self.rid = path.rstrip("/"), fields, key, threshold, rid

    def _seen(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        spark = batch.sparkSession
        try:
            return spark.read.parquet(f"{self.path}/records").where(F.col("__batch") != batch_id).drop("__batch")
        except Exception as missing:  # the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Adds one micro-batch; safe to repeat."""
        columns = [self.rid, *dict.fromkeys([*self.fields, self.key])]
        new = batch.select(*columns).dropDuplicates([self.rid])
        old = self._seen(batch, batch_id)
        pairs = pairs_within(keyed(new, clean(self.key), self.rid))
        everything = new
        if old is not None:
            a, b = keyed(new, clean(self.key), self.rid), keyed(old, clean(self.key), self.rid).withColumnRenamed("rid", "other")
            met = a.join(b, "key").where("rid != other").select(F.least("rid", "other").alias("i"), F.greatest("rid", "other").alias("j"))
            pairs, everything = pairs.unionByName(met).distinct(), new.unionByName(old.select(*columns))
        links = score_pairs(pairs, everything, self.fields, rid=self.rid).where(F.col("score") >= self.threshold).select("i", "j", "score")
        for df, name in ((links, "links"), (new, "records")):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/__batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        step: Callable[[DataFrame, int], None] = self.absorb
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def labels(self, spark) -> DataFrame:
        """The entities of all records so far."""
        return transitive_closure(spark.read.parquet(f"{self.path}/links"), spark.read.parquet(f"{self.path}/records").select(F.col(self.rid).alias("rid")))
