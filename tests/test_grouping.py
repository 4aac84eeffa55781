"""Groupings on small fixtures with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlake import registry
from kinlake.operators import grouping
from kinlake.operators.components import connected_components


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["label"], set()).add(r["rid"])
    return sorted(map(sorted, out.values()))


def records(spark, n):
    return spark.createDataFrame([(k,) for k in range(n)], "rid long")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, score double")


CLIQUES = [(0, 1, 0.9), (0, 2, 0.9), (1, 2, 0.8), (3, 4, 0.9), (3, 5, 0.8), (4, 5, 0.9), (2, 3, 0.2)]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    for edges in ([], [(1, 1), (2, None)], [(k, k + 1) for k in range(60)], [(7, k) for k in range(40)], [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(70)]):
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if b is not None and a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in root}


def test_transitive_closure_keeps_lone_records(spark):
    assert groups(grouping.transitive_closure(pairs(spark, [(0, 1, 1.0), (1, 2, 1.0)]), records(spark, 5))) == [[0, 1, 2], [3], [4]]


def test_center_breaks_chains_and_merge_center_mends(spark):
    chain = [(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.7)]
    run = lambda m: groups(registry.CLUSTERERS[m](pairs(spark, chain), pairs(spark, chain), records(spark, 4)))
    # 0 is a center and recruits 1; 1 may not recruit 2; 2 becomes a center and recruits 3
    assert run("center") == [[0, 1], [2, 3]]
    bridged = [(0, 1, 0.9), (2, 3, 0.8), (0, 2, 0.7)]
    run = lambda m: groups(registry.CLUSTERERS[m](pairs(spark, bridged), pairs(spark, bridged), records(spark, 4)))
    assert run("center") == [[0, 1], [2, 3]] and run("mc") == [[0, 1, 2, 3]]


def test_average_linkage_cut(spark):
    # {0,1} merge at 0.1; 2 is at 0.3 from 0 and 1.0 from 1, 0.65 on average
    rows = pairs(spark, [(0, 1, 0.9), (0, 2, 0.7)])
    assert groups(registry.CLUSTERERS["hc"](rows, rows, records(spark, 4), hc_h=0.5)) == [[0, 1], [2], [3]]
    assert groups(registry.CLUSTERERS["hc"](rows, rows, records(spark, 4), hc_h=0.7)) == [[0, 1, 2], [3]]


def brute_average_linkage(d, height):
    clusters = [[k] for k in range(len(d))]
    while len(clusters) > 1:
        best = min((np.mean([d[x][y] for x in a for y in b]), a, b) for k, a in enumerate(clusters) for b in clusters[k + 1 :])
        if best[0] > height:
            break
        clusters = [c for c in clusters if c not in best[1:]] + [best[1] + best[2]]
    return sorted(map(sorted, clusters))


@pytest.mark.parametrize("seed", range(4))
def test_average_linkage_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    d = np.ones((12, 12))
    rows = []
    for i in range(12):
        for j in range(i + 1, 12):
            if rng.random() < 0.5:
                w = float(rng.random())
                d[i, j] = d[j, i] = 1 - w
                rows.append((i, j, w))
    p = pairs(spark, rows)
    assert groups(registry.CLUSTERERS["hc"](p, p, records(spark, 12), hc_h=0.6)) == brute_average_linkage(d, 0.6)


@pytest.mark.parametrize("name", ["louvain", "leiden", "label_prop", "gc"])
def test_communities_of_two_cliques(spark, name):
    assert groups(registry.COMMUNITIES[name](pairs(spark, CLIQUES), records(spark, 7))) == [[0, 1, 2], [3, 4, 5], [6]]


def test_louvain_needs_the_whole_graph_s_weight(spark):
    # two rings of cliques far apart: groups of a component must not depend on how many others there are
    rows = CLIQUES + [(i + 10, j + 10, w) for i, j, w in CLIQUES]
    found = groups(registry.COMMUNITIES["louvain"](pairs(spark, rows), records(spark, 16)))
    assert [0, 1, 2] in found and [13, 14, 15] in found


def clouds(spark, sizes=(8, 8, 8), spread=0.02):
    rng = np.random.default_rng(1)
    points = np.concatenate([np.array(c) + rng.normal(0, spread, (n, 2)) for c, n in zip([(0, 0), (0.5, 0.5), (0, 0.7)], sizes, strict=False)])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    rows = [(i, j, float(1 - min(1, d[i, j]))) for i in range(len(d)) for j in range(i + 1, len(d))]
    want, at = [], 0
    for n in sizes:
        want.append(list(range(at, at + n)))
        at += n
    return pairs(spark, rows), records(spark, at), want


@pytest.mark.parametrize("name", ["hclust_avg", "hclust_ward", "pam"])
def test_dense_groupings_of_clouds(spark, name):
    rows, ids, want = clouds(spark)
    assert groups(registry.COMMUNITIES[name](rows, ids)) == want


def test_hdbscan_finds_clouds_and_leaves_noise_alone(spark):
    rows, ids, want = clouds(spark)
    noisy = ids.unionByName(spark.createDataFrame([(99,)], "rid long"))
    assert groups(registry.CLUSTERERS["hdbscan"](rows, rows, noisy, hdbscan_min_pts=3)) == [*want, [99]]


def test_two_records_and_caps(spark, monkeypatch):
    one = pairs(spark, [(0, 1, 0.4)])
    for name in ("pam", "hclust_avg"):
        assert groups(registry.COMMUNITIES[name](one, records(spark, 2))) == [[0, 1]]
    with pytest.raises(ValueError, match="cap"):
        grouping.at_once(one, records(spark, 5), grouping.pam, 4)


def test_silhouette_matches_the_definition():
    rng = np.random.default_rng(2)
    x = rng.random((10, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    labels = np.array([0, 0, 0, 1, 1, 1, 1, 2, 2, 3])
    want = []
    for k in range(10):
        own = [d[k, j] for j in range(10) if labels[j] == labels[k] and j != k]
        if not own:
            want.append(0)
            continue
        other = min(np.mean([d[k, j] for j in range(10) if labels[j] == c]) for c in set(labels) - {labels[k]})
        want.append((other - np.mean(own)) / max(other, np.mean(own)))
    assert grouping.mean_silhouette(d, labels) == pytest.approx(np.mean(want))
    assert np.isnan(grouping.mean_silhouette(d, np.zeros(10))) and np.isnan(grouping.mean_silhouette(d, np.arange(10)))


def test_community_links_need_a_positive_score(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 0)], "rid long, label long")
    got = grouping.community_links(pairs(spark, [(0, 1, 0.5), (0, 3, 0.0), (1, 2, 0.9)]), labels)
    assert [tuple(r) for r in got.select("i", "j").collect()] == [(0, 1)]
    assert got.where(F.col("score") <= 0).isEmpty()
