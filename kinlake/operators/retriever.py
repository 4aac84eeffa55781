"""Learned blocking: hashed n-gram records, an optional trained projection, nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.functions.text import HASH_DIM, hashed_ngrams
from kinlake.operators import truth
from kinlake.operators.blocking import undirect
from kinlake.operators.budget import completeness, k_for_budget
from kinlake.operators.neighbors import knn_of_copies
from kinlake.operators.ordering import global_rank
from kinlake.session import stash

HIDDEN, OUT = 128, 64
LEAST_PAIRS, SAMPLE_PAIRS = 4, 20_000
SEED = 42
DENSE_ROWS = 1_000


def record_vectors(records: DataFrame, text: str = "text") -> DataFrame:
    """``(rid, v)``: a 0/1 vector of hashed n-grams times ln 2.

    The n-grams are hashed once for a record, in the JVM; only their numbers go to Python.
    """
    rid = dict(records.dtypes)["rid"]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, DENSE_ROWS):
                part = batch.slice(lo, DENSE_ROWS)
                bits = part.column("bits")
                sizes = np.diff(np.asarray(bits.offsets))
                x = np.zeros((len(bits), HASH_DIM))
                x[np.repeat(np.arange(len(bits)), sizes), np.asarray(bits.flatten())] = math.log(2.0)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * HASH_DIM), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), v], names=["rid", "v"])

    bits = hashed_ngrams(F.coalesce(F.col(text), F.lit("")))
    return records.select("rid", bits.alias("bits")).mapInArrow(dense, f"rid {rid}, v array<double>")


class Projection:
    """512 -> 128 (tanh) -> 64, to unit length; trained to tell duplicates from the batch's others."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.w1, self.w2 = rng.normal(0, 1 / math.sqrt(HASH_DIM), (HASH_DIM, HIDDEN)), rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, OUT))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(x @ self.w1) @ self.w2
        return z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]

    def fit(self, a: np.ndarray, b: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.05, temperature: float = 0.1, seed: int = SEED) -> Projection:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for lo in range(0, len(a), batch):
                x = np.concatenate([a[order[lo : lo + batch]], b[order[lo : lo + batch]]])
                n = len(x) // 2
                if n < 2:
                    continue
                h = np.tanh(x @ self.w1)
                raw = h @ self.w2
                norm = np.maximum(np.linalg.norm(raw, axis=1), 1e-12)[:, None]
                z = raw / norm
                s = z[:n] @ z[n:].T / temperature
                p = np.exp(s - s.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - np.eye(n)) / (n * temperature)
                dz = np.concatenate([d @ z[n:], d.T @ z[:n]])
                draw = (dz - z * (dz * z).sum(1, keepdims=True)) / norm
                dh = draw @ self.w2.T * (1 - h * h)
                self.w2 -= rate * h.T @ draw
                self.w1 -= rate * x.T @ dh
        return self


def trained(vectors: DataFrame, gold: DataFrame, seed: int = SEED) -> Projection | None:
    """Fits on at most ``SAMPLE_PAIRS`` gold pairs (hashed order); None with fewer than four."""
    some = stash(gold.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "i", "j")), "i", "j").limit(SAMPLE_PAIRS), "training-pairs")
    pairs = some.orderBy("i", "j").toArrow()
    if len(pairs) < LEAST_PAIRS:
        return None
    ends = some.select(F.explode(F.array("i", "j")).alias("rid")).distinct()
    found = vectors.join(ends, "rid").toArrow().combine_chunks()
    ids, x = np.asarray(found["rid"]), np.asarray(found["v"].combine_chunks().flatten()).reshape(len(found), -1)
    order = np.argsort(ids)
    i, j = (order[np.searchsorted(ids[order], np.asarray(pairs[e]))] for e in ("i", "j"))
    return Projection(seed).fit(x[i], x[j], seed=seed)


def project(vectors: DataFrame, model: Projection | None) -> DataFrame:
    if model is None:
        return vectors

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(model(np.stack(v.to_numpy())))) if len(v) else pd.Series([], dtype=object)

    return vectors.select("rid", apply("v").alias("v"))


def block_embed(records: DataFrame, text: str, budget: int, gold: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Pairs of each record and its nearest ``k``, and the ``k`` used; ``k`` follows from the budget."""
    vectors = stash(record_vectors(records, text), "record-vectors")
    k = k_for_budget(budget, records.count())
    stubs = knn_of_copies(project(vectors, trained(vectors, gold) if gold is not None else None), k, positive=False)
    return undirect(stubs.select("i", "j")), k


def heldout_recall(records: DataFrame, known: DataFrame, k: int, text: str = "text", test_share: float = 0.3, seed: int = SEED) -> DataFrame:
    """One row: recall of the nearest ``k`` on the gold pairs of entities that the projection wasn't trained on.

    ``floor(test_share * entities)`` of them, one at least, are held out, in hashed order of
    ``known(rid, truth)``; neighbours are sought among all records.  Refuses fewer than two
    entities, fewer than ``LEAST_PAIRS`` training pairs, and no test pairs.
    """
    entities = known.where("truth IS NOT NULL").select("truth").distinct()
    total = entities.count()
    if total < 2:
        raise ValueError("held-out recall needs at least two entities")
    held = max(1, int(test_share * total))
    split = global_rank(entities, [truth.shuffled(seed, "truth"), F.col("truth")], "at").select("truth", (F.col("at") < held).alias("test"))
    ends = known.join(split, "truth").select(F.col("rid").alias("i"), "test")
    gold = stash(truth.gold_pairs(known).join(ends, "i").select("i", "j", "test"), "held-out-gold")
    train, test = (gold.where(F.col("test") == flag).select("i", "j") for flag in (False, True))
    n_train, n_test = train.count(), test.count()
    if n_train < LEAST_PAIRS:
        raise ValueError(f"held-out recall needs at least {LEAST_PAIRS} training pairs: {n_train}")
    if not n_test:
        raise ValueError("held-out recall needs pairs of the entities held out")
    vectors = stash(record_vectors(records, text), "record-vectors")
    pairs = stash(undirect(knn_of_copies(project(vectors, trained(vectors, train, seed)), k, positive=False).select("i", "j")), "held-out-pairs")
    counts = {"n_train_pairs": n_train, "n_test_pairs": n_test, "n_train_entities": total - held, "n_test_entities": held}
    return completeness(pairs, test).select(F.col("pc").alias("recall"), F.lit(k).cast("long").alias("k"), F.col("pairs").alias("n_pairs"), *(F.lit(v).cast("long").alias(c) for c, v in counts.items()))
