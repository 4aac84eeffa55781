"""Tuned canopies, pruning aligned to a budget, permuted communities and held-out recall, against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from kinlake.operators import blocking, budget
from kinlake.operators.neighbors import ranked
from kinlake.operators.retriever import heldout_recall

N = 24


def made(seed):
    rng = random.Random(seed)
    return {(i, j): rng.choice([0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) for i, j in combinations(range(N), 2)}


def pairs_frame(spark, cosines, name="cos"):
    return spark.createDataFrame([(i, j, c) for (i, j), c in cosines.items()], f"i long, j long, {name} double")


def nodes(spark):
    return spark.range(N).withColumnRenamed("id", "rid")


def stubs_of(spark, cosines):
    both = [(i, j, c) for (i, j), c in cosines.items()] + [(j, i, c) for (i, j), c in cosines.items()]
    return ranked(spark.createDataFrame(both, "i long, j long, cos double"), 8)


def best_pairs(stubs):
    out = {}
    for r in stubs.collect():
        key = (min(r["i"], r["j"]), max(r["i"], r["j"]))
        out[key] = max(out.get(key, -1.0), r["cos"])
    return out


def brute_align(chosen, pool, b):
    kept = sorted(chosen, key=lambda p: (-chosen[p], p))[:b]
    return kept + sorted((p for p in pool if p not in chosen), key=lambda p: (-pool[p], p))[: b - len(kept)]


# --- canopies


@pytest.mark.parametrize("wanted", [0, 120, 10**6])
def test_canopy_bounds_are_tuned_to_the_budget(spark, wanted):
    cosines = made(1)
    pool = best_pairs(stubs_of(spark, cosines))
    sym = cosines | {(j, i): c for (i, j), c in cosines.items()}

    def count(loose, tight):
        gone, total = set(), 0
        for i in range(N):
            if i in gone:
                continue
            near = [j for j in range(N) if j == i or sym[i, j] >= loose]
            total += len(near) * (len(near) - 1) // 2
            gone |= {j for j in range(N) if j != i and sym[i, j] >= tight}
        return total

    grid = sorted(set(np.quantile(list(pool.values()), blocking.QUANTILES)))
    counts = [(abs(count(q, min(0.99, q + 0.05)) - wanted), q, min(0.99, q + 0.05), count(q, min(0.99, q + 0.05))) for q in grid]
    _, loose, tight, pairs = min(counts)
    got = blocking.tune_canopies(pairs_frame(spark, cosines), nodes(spark), pairs_frame(spark, pool, "score"), wanted).collect()
    assert len(got) == 1 and (got[0]["loose"], got[0]["tight"], got[0]["pairs"]) == (pytest.approx(loose), pytest.approx(tight), pairs)


def test_canopies_without_a_pool_or_with_too_many_records(spark):
    none = pairs_frame(spark, {}, "score")
    assert blocking.tune_canopies(pairs_frame(spark, made(1)), nodes(spark), none, 10).collect() == []
    with pytest.raises(blocking.PairBudgetExceeded):
        blocking.tune_canopies(pairs_frame(spark, made(1)), nodes(spark), pairs_frame(spark, made(1), "score"), 10, limit=5)


# --- cardinality pruning


@pytest.mark.parametrize("b", [0, 3, 6, 40])
def test_heaviest_edges_with_ties_by_cosine_and_a_pool_to_top_up(spark, b):
    edges = {(0, 1): 0.5, (0, 2): 0.5, (1, 2): 0.9, (3, 4): 0.5, (5, 6): 0.1, (7, 8): 0.5}
    pool = {(0, 2): 0.7, (3, 4): 0.2, (5, 6): 0.99, (8, 9): 0.4, (2, 9): 0.4, (1, 9): 0.8}
    want = sorted(edges, key=lambda p: (-edges[p], -pool.get(p, -1.0), p))[:b]
    want += sorted((p for p in pool if p not in edges), key=lambda p: (-pool[p], p))[: b - len(want)]
    got = budget.heaviest_edges(pairs_frame(spark, edges, "js"), pairs_frame(spark, pool, "score"), b).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted(want)


# --- communities


@pytest.mark.parametrize("b", [25, 60, 500])
def test_permuted_communities_against_brute_force(spark, b):
    cosines, replicates, cap, insurance = made(2), 4, 5, 2
    comm = {i: i % 3 for i in range(N)}
    gold = {p for p in cosines if p[0] % 3 == p[1] % 3 and p[1] % 2}
    stubs = stubs_of(spark, cosines)
    pool, listed = best_pairs(stubs), sorted(stubs.collect(), key=lambda r: (r["i"], r["rank"]))
    sym = cosines | {(j, i): c for (i, j), c in cosines.items()}

    def pc(label):
        size = {c: list(label.values()).count(c) for c in label.values()}
        out = {}
        for i in range(N):
            mates = [j for j in range(N) if j != i and label[j] == label[i]]
            if size[label[i]] > cap:
                mates = sorted(mates, key=lambda j: (-sym[i, j], j))[:cap]
            away = [r["j"] for r in listed if r["i"] == i and label[r["j"]] != label[i]][:insurance]
            out |= {(min(i, j), max(i, j)): sym[i, j] for j in mates + away}
        return len(gold & set(brute_align(out, pool, b))) / len(gold)

    def shuffled(replicate):
        order = sorted(range(N), key=lambda i: (hashlib.md5(f"20261016|{replicate}|{i}".encode()).hexdigest(), i))
        return {i: comm[at] for at, i in enumerate(order)}

    frame = spark.createDataFrame(list(comm.items()), "rid long, comm long")
    got = {(r["replicate"], r["rid"]): r["comm"] for r in budget.permuted_communities(frame, replicates).collect()}
    assert got == {(k, i): c for k in range(1, replicates + 1) for i, c in shuffled(k).items()}
    null = [pc(shuffled(k)) for k in range(1, replicates + 1)]
    gold_frame = spark.createDataFrame(sorted(gold), "i long, j long")
    row = budget.community_test(pairs_frame(spark, cosines), stubs, frame, gold_frame, b, replicates, cap, insurance).first()
    seen = pc(comm)
    assert row["observed"] == pytest.approx(seen) and row["null_mean"] == pytest.approx(np.mean(null)) and row["null_sd"] == pytest.approx(np.std(null, ddof=1))
    assert row["p"] == pytest.approx((1 + sum(x >= seen - 1e-12 for x in null)) / (replicates + 1))


# --- held-out recall


def test_held_out_recall_counts_only_entities_left_out(spark):
    rng = random.Random(3)
    words = ["ring", "bolt", "screw", "plate", "wheel", "valve", "lever", "spring", "gear", "axle"]
    rows = []
    for e in range(20):
        name = " ".join(rng.sample(words, 3)) + f" {e * 37 % 101}"
        rows += [(len(rows) + k, name + x, f"e{e}") for k, x in enumerate(["", " new", " x"])]
    rows.append((len(rows), "ring of no entity", None))
    frame = spark.createDataFrame(rows, "rid long, text string, truth string")
    known = frame.select("rid", "truth")
    row = heldout_recall(frame, known, 10**3).first()
    assert (row["n_train_entities"], row["n_test_entities"], row["n_train_pairs"], row["n_test_pairs"]) == (14, 6, 42, 18)
    assert row["recall"] == 1.0 and row["n_pairs"] == len(rows) * (len(rows) - 1) // 2
    near = heldout_recall(frame, known, 2).first()
    assert 0.5 < near["recall"] <= 1.0 and near["n_pairs"] <= 2 * len(rows)
    for few in (known.where("truth = 'e1'"), known.where("rid % 3 = 0"), known.where("truth in ('e1', 'e2')")):
        with pytest.raises(ValueError, match="held-out recall needs"):
            heldout_recall(frame, few, 2)
