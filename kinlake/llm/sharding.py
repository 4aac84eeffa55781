"""Uniform shuffle into shards of exact sizes by a communication matrix.

Rows lie in source blocks, by a hash of the row and of its place in the written input,
so that equal rows are dealt over blocks and a task that is run again finds the same.  How many rows of each block go to each shard is drawn from the
multivariate hypergeometric law that a uniform random permutation would give:
block sizes are the row sums, exact shard sizes the column sums.  Each block then
permutes its rows and deals them out by its row of the matrix, the rows are
exchanged, and each shard permutes what it got.  The result has the law of a
uniform permutation cut into shards, and no step sees more than one block or one
piece of a shard.

Only narrow columns (id, byte size, checksum) are moved.  There are at least ``BLOCKS``
blocks and ``PIECES`` pieces of a shard, and one for every ``ROWS_PER_BLOCK`` rows, so
the matrix and the counts stay a millionth of the input.  The draws are as exact as
numpy's; above 10**9 rows they go by log-gamma in double precision.

Edge cases: null text has size 1 and the checksum of an empty text; null ids are
rows like others; equal rows stay apart, each with its own slot; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlake.session import stash, table

SHARDS = 16
BLOCKS = 256
PIECES = 64
ROWS_PER_BLOCK = 1_000_000
SEED = 20240601


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw; numpy's own sampler is bounded at 10**9 items, beyond that the law's terms are summed from its mode."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good + bad else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    weight = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left = rng.random() - weight
    up = down = weight
    a = b = mode
    while left > 0 and (a < high or b > low):  # outwards from the mode
        if a < high:
            up *= (good - a) * (n - a) / ((a + 1) * (bad - n + a + 1))
            a += 1
            left -= up
            if left <= 0:
                return a
        if b > low:
            down *= b * (bad - n + b) / ((good - b + 1) * (n - b + 1))
            b -= 1
            left -= down
            if left <= 0:
                return b
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int = SEED) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform permutation would deal them."""
    rng = np.random.default_rng(seed)
    room = list(shard_rows)
    out = np.zeros((len(block_rows), len(shard_rows)), dtype=np.int64)
    for i, rows in enumerate(block_rows):
        total = sum(room)
        for j in range(len(room)):
            rest = total - room[j]
            got = rows if not rest else _hypergeometric(rng, room[j], rest, rows)
            out[i, j], total, rows = got, rest, rows - got
        room = [r - int(g) for r, g in zip(room, out[i], strict=True)]
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def shuffle_into_shards(df: DataFrame, identity: list[str], shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``identity`` names the columns that tell rows apart; rows equal in all of them are
    told apart by their place.  Shard sizes differ by at most one.
    """
    spark = df.sparkSession
    key = lambda salt: F.xxhash64(F.lit(seed + salt), *identity, "__row")
    rows = stash(df.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")  # places stand once written
    n = rows.count()
    blocks, pieces = max(blocks, -(-n // rows_per_block)), max(PIECES, -(-n // (shards * rows_per_block)))
    rows = rows.withColumn("__block", F.pmod(key(1), F.lit(blocks)).cast("int"))
    counts = {r["__block"]: r["n"] for r in rows.groupBy("__block").agg(F.count("*").alias("n")).collect()}  # at most `blocks` rows
    per_block = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(per_block, shard_sizes(n, shards), seed)
    bounds = spark.createDataFrame([(b, [int(x) for x in np.cumsum(matrix[b])]) for b in range(blocks)], "__block int, __bounds array<bigint>")
    local = Window.partitionBy("__block").orderBy(key(2), "__row")
    dealt = stash(
        rows.withColumn("__rank", F.row_number().over(local))
        .join(F.broadcast(bounds), "__block")
        .withColumn("shard", F.size(F.filter("__bounds", lambda x: x < F.col("__rank"))).cast("int"))
        .drop("__block", "__bounds", "__rank")
        .withColumn("__piece", F.pmod(key(3), F.lit(pieces)).cast("int")),
        "shard-dealt",
    )
    per_piece = dealt.groupBy("shard", "__piece").agg(F.count("*").alias("__n"))  # at most shards * pieces rows
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select("shard", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    again = Window.partitionBy("shard", "__piece").orderBy(key(4), "__row")
    return (
        dealt.withColumn("__at", F.row_number().over(again))
        .join(F.broadcast(offsets), ["shard", "__piece"])
        .withColumn("slot", (F.col("__before") + F.col("__at") - 1).cast("long"))
        .drop("__piece", "__at", "__before", "__row")
    )


def measured(documents: DataFrame) -> DataFrame:
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards under the law ``rows``."""
    out = shuffle_into_shards(measured(table(spark, sf_dir, "documents")), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
