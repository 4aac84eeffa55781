"""Connected components of an edge table.

Every round points each node at the smallest node beside it, follows those
pointers a few times and contracts the edges.  The smallest node of a component
always points at itself, so it is what remains in the end.  Contracted tables
shrink quickly; each is written to the shared folder, so that a lost executor
costs one round's tasks, and node-to-node maps are composed once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.session import stash

JUMPS = 3


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest
    node reachable.  Null ends and loops are dropped (a node seen only in a loop isn't
    returned).  Works for any number of nodes: nothing is collected.
    """
    a, b = F.col(src), F.col(dst)
    current = stash(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
        .distinct(),
        "cc-edges",
    )
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = both.groupBy(F.col("src").alias("v")).agg(F.least(F.min("dst"), F.col("v")).alias("p"))
        to = stash(to, "cc-map")
        up = to.select(F.col("v").alias("w"), F.col("p").alias("q"))
        for _ in range(JUMPS):
            to = to.join(up, F.col("p") == F.col("w")).select("v", F.col("q").alias("p"))
        to = stash(to, "cc-map")
        maps.append(to)
        left = to.select(F.col("v").alias("src"), F.col("p").alias("a"))
        right = to.select(F.col("v").alias("dst"), F.col("p").alias("b"))
        current = stash(
            current.join(left, "src")
            .join(right, "dst")
            .where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct(),
            "cc-edges",
        )
    if not maps:
        return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    out = maps[0].select(F.col("v").alias("node"), F.col("p").alias("component"))
    for level in maps[1:]:
        out = (
            out.join(level, F.col("component") == F.col("v"), "left")
            .select("node", F.coalesce("p", "component").alias("component"))
        )
    return out
