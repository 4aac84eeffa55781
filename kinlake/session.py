"""Sessions, and tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and all runs on one machine, as in tests, a new local folder; on a
    cluster that would scatter tables over its machines, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kinlake-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_stashes(spark: SparkSession) -> None:
    """Removes all tables that this application has stashed; results that were not written elsewhere go with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a
    lost executor costs only the tasks that read it."""
    path = new_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")  # the write's own shuffle files go once it has ended
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = 500
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bounds the rows and bytes of an Arrow batch: rows that hold whole texts can be long, and
    each running task has a few batches in memory.

    Settings are read when a plan is run, which is after the operator has returned, so
    they stay lowered for the session.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name, str(most)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def trimmed(function):
    """Wraps a function for ``mapInArrow``: once its task ends, memory that the (reused) Python
    worker has freed goes back to the machine."""

    def run(batches):
        yield from function(batches)
        import ctypes
        import gc

        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS = 1_000_000


def drop_matching(df: DataFrame, bad: DataFrame, condition: Column) -> DataFrame:
    """``df`` without the rows that match a narrow table.

    The table is written first and broadcast only when its counted rows are within
    ``BROADCAST_ROWS``; beyond that both sides are shuffled.
    """
    bad = stash(bad, "drop-keys")
    return df.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, condition, "left_anti")
