"""Near-duplicate embeddings by collision-counting projections.

Two unit vectors at the threshold are ``DELTA`` apart, so their difference along a
Gaussian direction is normal with that deviation.  Vectors are projected on
``PROJECTIONS`` directions.

Which vectors meet is narrowed by the same projections: for each label a tree cuts the
vectors at one projection after another.  A vector just above a cut (by ``REACH`` at
most) also goes below it as a guest, so two vectors that a cut parts still meet when
their projections differ by no more than that; two guests of one cut have met above it
and don't count.  Cuts are chosen on a sample of ``SAMPLE`` vectors in all, where they
make the fewest guests; every vector goes through the tree.  A cut that wouldn't lessen
the work isn't made, so a crowd of near copies stays together in one leaf, which is
dealt into blocks that meet two by two.

Where blocks meet, a query's window of half-width ``WINDOW`` is looked up in every
sorted projection and its collisions are counted per pair.  Pairs with at least
``least_collisions`` of them - the largest count that still keeps a linked pair with
probability ``RECALL`` - are verified by their cosine in double precision.  Equal
vectors are one class from the start.  From a meeting come only sums of links per class
and a spanning forest, never the pairs.

Edge cases: a vector that is null, empty or zero, holds null or non-finite components,
or has a null label links with nothing and is kept; vectors of different lengths never
link; equal rows are different vectors that link; a null id never names a component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kinlake.operators.components import connected_components
from kinlake.session import stash, table, trimmed

THRESHOLD = 0.98
DELTA = math.sqrt(2 - 2 * THRESHOLD)
WINDOW = 3 * DELTA
REACH = 2.5 * DELTA
PROJECTIONS = 16
RECALL = 0.9999
BLOCK = 512
LEAF = 1024
SAMPLE = 200_000
LEAST_SAMPLE = 32
WORTH = 0.9
SEED = 7


def least_collisions(projections: int = PROJECTIONS, window: float = WINDOW, delta: float = DELTA, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    hit = math.erf(window / delta / math.sqrt(2))
    tail, count = 0.0, projections
    while count > 0:
        tail += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if tail >= recall:
            return count
        count -= 1
    return 0


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def _units(raw: bytes, dtype: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision, whatever the magnitude of the components."""
    x = np.frombuffer(raw, dtype=dtype).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def parsed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """``(vec_id, label, dim, digest, raw)`` of every row, and the type of ``raw``'s components; the
    last three are null for vectors that link with nothing."""
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("digest", pa.binary()), ("raw", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, label = batch.column("embedding"), batch.column("label")
            at = lists.offsets.to_numpy()
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=dtype)  # nulls are nan
            size = np.where(np.asarray(lists.is_valid()) & np.asarray(label.is_valid()), np.diff(at), 0)
            dim, digest, raw = ([None] * len(batch) for _ in range(3))
            for d in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == d)
                part = values[at[rows][:, None] + np.arange(d)] + np.zeros(1, dtype)  # no negative zeros
                for k, x in zip(rows[(ok := np.isfinite(part).all(1) & part.any(1))].tolist(), part[ok], strict=True):
                    raw[k], dim[k] = x.tobytes(), d
                    digest[k] = hashlib.blake2b(raw[k], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), label, *(pa.array(c, schema.field(n).type) for c, n in ((dim, "dim"), (digest, "digest"), (raw, "raw")))], schema=schema)

    wanted = F.col("embedding") if dtype == "<f4" else F.col("embedding").cast("array<double>")
    picked = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), wanted.alias("embedding"))
    return picked.mapInArrow(trimmed(read), "vec_id long, label string, dim int, digest binary, raw binary"), dtype


@dataclass
class Tree:
    """Cuts of one label's vectors: node 0 is the root; a node without ``axis`` (-1) is a leaf of ``subs`` blocks."""

    axis: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    subs: list[int] = field(default_factory=list)

    def _add(self) -> int:
        for column, empty in ((self.axis, -1), (self.cut, 0.0), (self.below, -1), (self.above, -1), (self.subs, 1)):
            column.append(empty)
        return len(self.axis) - 1

    @staticmethod
    def best_cut(points: np.ndarray, reach: float) -> tuple[float, int, float]:
        """``(work, axis, cut)``: the sum of squares of both sides, guests counted, as a share of the whole's."""
        n = len(points)
        best = (math.inf, -1, 0.0)
        for k in range(points.shape[1]):
            x = np.sort(points[:, k])
            at = np.unique(np.linspace(n // 5, n - n // 5 - 1, 25).astype(int))
            low = np.searchsorted(x, x[at], side="right")
            guests = np.searchsorted(x, x[at] + reach, side="right") - low
            work = ((low + guests) / n) ** 2 + ((n - low) / n) ** 2
            i = int(np.argmin(np.where(low < n, work, math.inf)))
            best = min(best, (float(work[i]) if low[i] < n else math.inf, k, float(x[at[i]])))
        return best

    def grow(self, points: np.ndarray, scale: float, reach: float = REACH, depth: int = 0) -> int:
        """Adds the node for sampled ``points`` that stand for ``scale`` vectors each."""
        node = self._add()
        size = len(points) * scale
        if size > LEAF and len(points) >= 2 * LEAST_SAMPLE and depth < 60:
            work, axis, cut = self.best_cut(points, reach)
            if work <= WORTH:
                x = points[:, axis]
                self.axis[node], self.cut[node] = axis, cut
                self.below[node] = self.grow(points[x <= cut + reach], scale, reach, depth + 1)
                self.above[node] = self.grow(points[x > cut], scale, reach, depth + 1)
                return node
        self.subs[node] = max(1, math.ceil(size / BLOCK))
        return node

    def leaves(self, points: np.ndarray, reach: float = REACH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(leaf, rows, guest bits)``: every row of ``points`` in each leaf that it goes to; bit d tells a guest of the cut at depth d."""
        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.int64), 0)]
        while todo:
            node, rows, bits, depth = todo.pop()
            if not len(rows):
                continue
            if self.axis[node] < 0:
                yield node, rows, bits
                continue
            x = points[rows, self.axis[node]]
            over = x > self.cut[node]
            near = x <= self.cut[node] + reach
            todo.append((self.above[node], rows[over], bits[over], depth + 1))
            todo.append((self.below[node], rows[near], np.where(over, bits | np.int64(1 << depth), bits)[near], depth + 1))


def grown_trees(classes: DataFrame, dtype: str, sample: int = SAMPLE) -> dict[tuple[str, int], Tree]:
    """Trees of the labels that are worth cutting, from the projections of about ``sample`` classes
    (those of smallest hash), which is all that the driver gets."""
    total = classes.count()
    if total <= LEAF:
        return {}
    share = min(1.0, sample / total)
    some = classes.where(F.pmod(F.xxhash64(F.lit(SEED), "class"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("label", "dim", "raw")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out: list[bytes] = [b""] * len(batch)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                raw = b"".join(batch.column("raw")[k].as_py() for k in rows.tolist())
                for k, p in zip(rows.tolist(), (_units(raw, dtype, d) @ directions(d)).astype(np.float32), strict=True):
                    out[k] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dim"), pa.array(out, pa.binary())], names=["label", "dim", "places"])

    points: dict[tuple[str, int], list[bytes]] = {}
    for row in some.mapInArrow(trimmed(project), "label string, dim int, places binary").collect():
        points.setdefault((row["label"], row["dim"]), []).append(row["places"])
    trees = {}
    for name, places in points.items():
        if len(places) / share > LEAF:
            tree = Tree()
            tree.grow(np.frombuffer(b"".join(sorted(places)), np.float32).reshape(-1, PROJECTIONS).astype(float), 1 / share)
            trees[name] = tree
    return trees


KEYS = ["label", "dim", "leaf", "sub"]


def dealt(classes: DataFrame, trees: dict[tuple[str, int], Tree], dtype: str) -> DataFrame:
    """``(label, dim, leaf, sub, class, n, bits, raw)``: every class in each leaf that it goes to."""
    shared = classes.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("leaf", pa.int32()), ("sub", pa.int32()), ("class", pa.int64()), ("n", pa.int64()), ("bits", pa.int64()), ("raw", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            names: dict[tuple[str, int], list[int]] = {}
            for k, name in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                names.setdefault(name, []).append(k)
            number = batch.column("class").to_numpy()
            for (label, dim), rows in names.items():
                part = batch.take(pa.array(rows, pa.int64()))
                tree = shared.value.get((label, dim))
                if tree is None:
                    found = [(0, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
                else:
                    if dim not in known:
                        known[dim] = directions(dim)
                    found = tree.leaves(_units(b"".join(part.column("raw").to_pylist()), dtype, dim) @ known[dim])
                for leaf, at, bits in found:
                    subs = tree.subs[leaf] if tree else 1
                    some = part.take(pa.array(at))
                    sub = ((number[np.array(rows)[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(subs)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("label"), some.column("dim"), pa.array(np.full(len(at), leaf, np.int32)), pa.array(sub.astype(np.int32)), some.column("class"), some.column("n"), pa.array(bits), some.column("raw")], schema=schema
                    )

    return classes.select("label", "dim", "class", "n", "raw").mapInArrow(trimmed(read), "label string, dim int, leaf int, sub int, class long, n long, bits long, raw binary")


def pack_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of at most ``BLOCK`` classes of a leaf: their numbers, sizes, guest bits and vectors end to end."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("leaf", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary()), ("raw", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row() -> pa.RecordBatch:
            *numbers, raw = zip(*held, strict=True)
            values = [*now[:3], *(np.array(x, np.int64).tobytes() for x in numbers), b"".join(raw)]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for *key, i, n, bits, raw in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "class", "n", "bits", "raw")), strict=True):
                if key != now or len(held) >= BLOCK:
                    if held:
                        yield row()
                    now, held = key, []
                held.append((i, n, bits, raw))
        if held:
            yield row()

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(trimmed(pack), "label string, dim int, leaf int, ids binary, sizes binary, bits binary, raw binary")


def collisions(a: np.ndarray, b: np.ndarray, window: float = WINDOW) -> np.ndarray:
    """How many sorted projections have ``b``'s row inside the window around ``a``'s."""
    out = np.zeros((len(a), len(b)), dtype=np.int8)
    query = np.arange(len(a))
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        ordered = b[order, k]
        edges = np.zeros((len(a), len(b) + 1), dtype=np.int8)  # a window opens at +1 and ends at -1
        edges[query, np.searchsorted(ordered, a[:, k] - window)] += 1
        edges[query, np.searchsorted(ordered, a[:, k] + window, side="right")] -= 1
        inside = np.cumsum(edges[:, :-1], axis=1, dtype=np.int8)
        place = np.empty(len(b), np.int64)
        place[order] = np.arange(len(b))
        out += inside[:, place]
    return out


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def meet(pairs: DataFrame, dtype: str) -> DataFrame:
    """``(class, n_links, root)`` from rows of two blocks, or of one (``raw_b`` null) that meets itself."""
    schema = pa.schema([("class", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])
    least = least_collisions()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                dim, alone = row["dim"], row["raw_b"] is None
                if dim not in known:
                    known[dim] = directions(dim)
                ids, sizes = (np.concatenate([np.frombuffer(row[f"{c}_{s}"], np.int64) for s in ("a" if alone else "ab")]) for c in ("ids", "sizes"))
                bits_a, bits_b = (np.frombuffer(row[f"bits_{s}"], np.int64) for s in ("aa" if alone else "ab"))
                a = _units(row["raw_a"], dtype, dim)
                b = a if alone else _units(row["raw_b"], dtype, dim)
                i, j = np.nonzero(collisions(a @ known[dim], b @ known[dim]) >= least)
                count = (bits_a[i] & bits_b[j]) == 0
                if alone:
                    count &= i < j
                i, j = i[count], j[count]
                linked = np.concatenate([np.einsum("kd,kd->k", a[i[p : p + 65536]], b[j[p : p + 65536]]) for p in range(0, len(i), 65536)] or [np.zeros(0)]) >= THRESHOLD
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                j = j if alone else j + len(a)
                # a class may be in both blocks, as a guest of another cut
                ids, same = np.unique(ids, return_inverse=True)
                sizes = sizes[np.unique(same, return_index=True)[1]]
                i, j = same[i], same[j]
                n = np.zeros(len(ids), dtype=np.int64)
                np.add.at(n, i, sizes[j])
                np.add.at(n, j, sizes[i])
                met = np.flatnonzero(n)
                root = _roots(i, j, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(n[met]), pa.array(ids[root[met]])], schema=schema)

    return pairs.mapInArrow(trimmed(look), "class long, n_links long, root long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding, label)``."""
    rows, dtype = parsed(vectors)
    rows = stash(rows, "embedding-rows")
    same = ["label", "dim", "digest"]
    classes = rows.where("digest IS NOT NULL").groupBy(*same).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("raw").alias("raw"))
    classes = stash(classes.withColumn("class", F.monotonically_increasing_id()), "embedding-classes")  # numbers stand once written
    blocks = pack_blocks(dealt(classes, grown_trees(classes, dtype), dtype))
    blocks = stash(blocks.withColumn("block", F.monotonically_increasing_id()), "embedding-blocks")

    values = ("ids", "sizes", "bits", "raw")
    alone = blocks.select("dim", *(F.col(c).alias(f"{c}_a") for c in values), *(F.lit(None).cast("binary").alias(f"{c}_b") for c in values))
    names = blocks.select("label", "dim", "leaf", "block")
    pairs = names.withColumnRenamed("block", "block_a").join(names.withColumnRenamed("block", "block_b"), ["label", "dim", "leaf"]).where("block_a < block_b").select("dim", "block_a", "block_b")
    for s in "ab":
        pairs = pairs.join(blocks.select(F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in values)), f"block_{s}")
    tasks = max(1, min(blocks.count() // 4, 50_000))
    met = stash(meet(alone.repartition(tasks).unionByName(pairs.select(*alone.columns)), dtype), "embedding-links")

    roots = connected_components(met, "class", "root")
    sums = met.groupBy("class").agg(F.sum("n_links").alias("others"))
    rooted = classes.select("class", *same, "n", "first").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("component", "class"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.join(named, "root").join(sums, "class", "left").select(*same, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("digest IS NOT NULL").select("vec_id", *same).join(of_class, same).select("vec_id", "n_links", "component_id")
    rest = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against each other."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND list_sum(list_transform(x, lambda c: abs(c))) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}
), r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
