"""Groupings of vectors that make no pairs, against those of the pairs."""

import numpy as np
import pytest
from pyspark import TaskContext

from kinlake.operators import grouping, neighbors, vector_groups
from kinlake.plans import q_grouping
from kinlake.plans.catalog import QUERIES

LEAST = {"label_prop": 0.5, "leiden": 0.5, "hc": 0.5}


def clouds(spark, seed, n=60):
    """Two parts that no cosine above 0.5 joins, copies, a lone record, a zero vector and a null."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.eye(9)[rng.integers(0, 4, n)], np.eye(9)[4 + rng.integers(0, 4, n)]]) + np.abs(rng.normal(0, 0.35, (2 * n, 9))) * np.repeat([[1] * 4 + [0] * 5, [0] * 4 + [1] * 4 + [0]], n, 0)
    x = np.concatenate([x, x[:5], np.eye(9)[8:], np.zeros((1, 9))])
    rows = [(int(k) * 3 - 7, [float(c) for c in v]) for k, v in zip(rng.permutation(len(x)), x, strict=True)]
    return spark.createDataFrame([*rows, (9_999, None)], "rid long, v array<float>")


def by_pairs(name, v, least, **options):
    pairs = neighbors.cosine_pairs(v, least).where(f"cos > {least}").withColumnRenamed("cos", "score")
    run = grouping.COMMUNITIES[name] if name in grouping.COMMUNITIES else lambda p, r, **o: grouping.CLUSTERERS[name](p, p, r, **o)
    return {tuple(r) for r in run(pairs, v.select("rid"), **options).collect()}


def same_as_pairs(spark, name, options, seed):
    v = clouds(spark, seed)
    got = [tuple(r) for r in vector_groups.VECTORS[name](v, LEAST[name], **options).collect()]
    assert len(got) == len(set(got)) == v.count()
    assert set(got) == by_pairs(name, v, LEAST[name], **options)


def queries_without_pairs(spark, folder, monkeypatch, name):
    monkeypatch.setattr(q_grouping, "cosine_pairs", lambda *a, **k: pytest.fail("pairs are made"))
    clouds(spark, 5).selectExpr("rid AS vec_id", "v AS embedding", "CAST(pmod(rid, 3) AS INT) AS label").write.parquet(f"{folder}/embeddings.parquet")
    return QUERIES[name](spark, str(folder)).collect()


@pytest.mark.parametrize("cells", [1 << 22, 400])
@pytest.mark.parametrize("seed", [1, 2])
def test_label_propagation_over_vectors(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(vector_groups, "CELLS", cells)
    same_as_pairs(spark, "label_prop", {}, seed)


def test_label_prop_groups_make_no_pairs(spark, tmp_path, monkeypatch):
    assert len(queries_without_pairs(spark, tmp_path, monkeypatch, "label_prop_groups")) == 128


@pytest.mark.parametrize("held", [1 << 25, 0])
@pytest.mark.parametrize("options", [{}, {"resolution": 1.5}, {"refine": False}])
def test_leiden_over_vectors(spark, monkeypatch, held, options):
    monkeypatch.setattr(vector_groups, "CELLS", 500)
    monkeypatch.setattr(vector_groups, "HELD", held)
    same_as_pairs(spark, "leiden", options, 3)


@pytest.mark.parametrize("seed", range(4))
def test_passes_over_kept_sums_make_few_rows(monkeypatch, seed):
    """Moves are those of passes that make all weights anew, but rows are made for records that move."""
    rng = np.random.default_rng(seed)
    x = np.eye(12)[rng.integers(0, 12, 900)] + np.abs(rng.normal(0, 0.4, (900, 12)))
    graph = vector_groups.Cosines(x / np.linalg.norm(x, axis=1)[:, None], 0.3)
    strength, total = graph.strengths() / 1e9, graph.strengths().sum() / 2e9
    want, seen = np.arange(900), []
    vector_groups._move(graph, want, strength, total, 1.0, np.random.default_rng(1))
    for within in (None, np.arange(900) % 7):
        got, plain = np.arange(900), np.arange(900)
        tiles, run = vector_groups.Cosines.tiles, vector_groups.Mover.run
        monkeypatch.setattr(vector_groups.Cosines, "tiles", lambda self, at: seen.append(len(at)) or tiles(self, at))
        passes = []
        monkeypatch.setattr(vector_groups.Mover, "run", lambda self, order: passes.append(len(order)) or run(self, order))
        vector_groups._moved(graph, got, strength, total, 1.0, np.random.default_rng(1), within)
        monkeypatch.undo()
        vector_groups._move(graph, plain, strength, total, 1.0, np.random.default_rng(1), within)
        same = lambda label: [np.flatnonzero(label == c)[0] for c in label]
        assert same(got) == same(plain)
        if within is None:
            assert same(got) == same(want) and sum(passes) > 5 * 900 and sum(seen) < sum(passes)


def test_leiden_groups_make_no_pairs(spark, tmp_path, monkeypatch):
    assert len(queries_without_pairs(spark, tmp_path, monkeypatch, "leiden_groups")) == 128


@pytest.mark.parametrize("held", [1 << 25, 100])
@pytest.mark.parametrize("seed", [1, 2])
def test_cliques_over_vectors(spark, monkeypatch, seed, held):
    monkeypatch.setattr(vector_groups, "CELLS", 500)
    monkeypatch.setattr(vector_groups, "HELD", held)
    v = clouds(spark, seed)
    pairs = neighbors.cosine_pairs(v, 0.7).withColumnRenamed("cos", "score")
    want = {tuple(r) for r in grouping.COMMUNITIES["gc"](pairs, v.select("rid"), threshold=0.7).collect()}
    got = [tuple(r) for r in vector_groups.VECTORS["gc"](v, 0.7).collect()]
    assert len(got) == len(set(got)) == v.count() and set(got) == want
    assert 2 < len({label for _, label in got}) < v.count() - 20


def test_links_are_those_of_rounded_cosines():
    """Cosines from 0.3 - 1e-9 to 0.3 + 1e-9, which short floats can't tell apart."""
    cos = 0.3 + np.array([-10, -6, -4, 0, 4, 6, 10]) * 1e-10
    x = np.concatenate([[[1.0, 0.0]], np.stack([cos, np.sqrt(1 - cos**2)], 1)])
    ((_, j),) = vector_groups.Links(x, 0.3).near(np.array([0]), np.arange(8))
    assert j.tolist() == [3, 4, 5, 6, 7]


def test_gc_groups_make_no_pairs(spark, tmp_path, monkeypatch):
    assert len(queries_without_pairs(spark, tmp_path, monkeypatch, "gc_groups")) == 128


@pytest.mark.parametrize("held", [1 << 25, 1_000])
@pytest.mark.parametrize("height", [0.0, 0.2, 0.4, 0.99, 1.0])
def test_average_linkage_over_vectors(spark, monkeypatch, height, held):
    monkeypatch.setattr(vector_groups, "CELLS", 500)
    monkeypatch.setattr(vector_groups, "HELD", held)
    same_as_pairs(spark, "hc", {"hc_h": height}, 4)


def test_average_linkage_merges_a_neighbour_of_many():
    """The nearest of many records merges first, so that theirs must be found anew; by brute force."""
    x = np.random.default_rng(6).normal(size=(80, 3))
    x[1:40] = x[0] + 0.4 * x[1:40]
    graph = vector_groups.Cosines(x / np.linalg.norm(x, axis=1)[:, None], 0.1)
    w = graph.rows(np.arange(80))
    parts = [[v] for v in range(80)]
    while len(parts) > 1:
        d, a, b = min((round(1 - w[np.ix_(p, q)].mean(), 12), i, i + 1 + j) for i, p in enumerate(parts) for j, q in enumerate(parts[i + 1 :]))
        if d > 0.3:
            break
        parts[a] += parts.pop(b)
    got = vector_groups.average_linkage_cut(graph, {"height": 0.3})
    assert sorted(map(sorted, parts)) == sorted(np.flatnonzero(got == c).tolist() for c in np.unique(got))


def test_average_linkage_holds_small_clusters_against_near_ones(monkeypatch):
    """By the same merges as over whole rows, which aren't made."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 12))[rng.integers(0, 60, 500)] + rng.normal(0, 0.1, (500, 12))
    graph = vector_groups.Cosines(x / np.linalg.norm(x, axis=1)[:, None], 0.1)
    lists = vector_groups.Links.lists
    with monkeypatch.context() as m:
        m.setattr(vector_groups.Links, "lists", lambda self, most: lists(self, 0))
        want = vector_groups.average_linkage_cut(graph, {"height": 0.3})
    monkeypatch.setattr(vector_groups, "HELD", 5_000)  # clusters are small below 50 records
    monkeypatch.setattr(vector_groups.Cosines, "rows", lambda *a: pytest.fail("whole rows are made"))
    assert vector_groups.average_linkage_cut(graph, {"height": 0.3}).tolist() == want.tolist()
    assert 20 < len(set(want.tolist())) < 100


def test_hc_clusters_make_no_pairs(spark, tmp_path, monkeypatch):
    assert len(queries_without_pairs(spark, tmp_path, monkeypatch, "hc_clusters")) == 128


def test_hdbscan_of_points_makes_no_matrix(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, float(np.round(rng.normal(4_000, 2_500), 0)), int(rng.integers(0, 25))) for k in range(150)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    d = grouping.Distances(np.array([(x / 10_000, y / 25) for _, x, y in rows])).matrix()
    of = grouping.hdbscan_of(d, {"min_points": 5})
    monkeypatch.setattr(grouping.Distances, "matrix", lambda self: pytest.fail("all distances are made"))
    got = {r["rid"]: r["label"] for r in QUERIES["hdbscan_groups"](spark, str(tmp_path)).collect()}
    _, want = np.unique([np.flatnonzero(of == c)[0] for c in of], return_inverse=True)
    assert [got[k] for k in range(150)] == want.tolist()


@pytest.mark.parametrize("name", ["hclust_avg", "hclust_ward"])
def test_hclust_of_copies_makes_distances_of_different_points_only(spark, monkeypatch, name):
    rng = np.random.default_rng(8)
    base = np.stack([np.round(rng.uniform(-0.1, 1, 30), 6), rng.integers(0, 25, 30) / 25], 1)
    x = base[rng.integers(0, 30, 400)]
    of = grouping.hclust_of(grouping.Distances(x).matrix(), {"ward": name == "hclust_ward"})
    _, want = np.unique([np.flatnonzero(of == c)[0] for c in of], return_inverse=True)
    matrix = grouping.Distances.matrix
    monkeypatch.setattr(grouping.Distances, "matrix", lambda self: matrix(self) if len(self) <= 30 else pytest.fail("all distances are made"))
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "rid long, x double, y double")
    got = {r["rid"]: r["label"] for r in grouping.POINTS[name](points, ["x", "y"]).collect()}
    assert [got[k] for k in range(400)] == want.tolist()


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ward", [False, True])
def test_hclust_of_few_points_with_many_records(seed, ward):
    """Also where there are fewer points than groups."""
    rng = np.random.default_rng(seed)
    x = rng.random((14, 2))[rng.integers(0, 1 + 2 * seed, 40)]
    d = grouping.Distances(x)
    assert grouping.hclust_points(d, {"ward": ward}).tolist() == grouping.hclust_of(d.matrix(), {"ward": ward}).tolist()


def test_a_chain_of_records_needs_no_list_for_each_of_its_merges():
    n, x = 4_000, np.cumsum(np.linspace(1e-5, 2e-4, 4_000))
    import tracemalloc

    tracemalloc.start()
    grouping.hdbscan_of(grouping.Distances(x[:, None]), {"min_points": 3})
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * grouping.CHUNK * n * 8 + (16 << 20)  # lists of all merges: 64 MB more


def test_no_vectors_give_no_groups(spark):
    none = spark.createDataFrame([], "rid long, v array<double>")
    for run in vector_groups.VECTORS.values():
        assert run(none, 0.1).collect() == []


def test_runs_have_a_task_each(spark, tmp_path):
    def group(graph, options):
        (tmp_path / f"{options['k']}-{TaskContext.get().taskAttemptId()}").touch()
        return np.arange(len(graph)) % options["k"]

    runs = vector_groups.vectors_each(clouds(spark, 5), group, 0.5, [{"k": k} for k in (1, 2, 3)])
    many = [len({r["label"] for r in run.collect()}) for run in runs]
    assert many[0] < many[1] < many[2]
    assert len({p.name.split("-")[1] for p in tmp_path.iterdir()}) == 3


def test_leiden_resolution_makes_no_pairs(spark, tmp_path, monkeypatch):
    got = queries_without_pairs(spark, tmp_path, monkeypatch, "leiden_resolution")
    v = clouds(spark, 5)
    for row in got:
        labels = spark.createDataFrame(sorted(by_pairs("leiden", v, 0.1, resolution=row["resolution"])), "rid long, label long")
        want = q_grouping.metrics.quality(labels.selectExpr("rid", "label", "CAST(pmod(rid, 3) AS INT) AS truth")).first()
        assert (row["ari"], row["pair_f1"]) == (round(want["ari"], 4), round(want["pair_f1"], 4))
    assert sorted(r["resolution"] for r in got) == [0.5, 1.0, 1.5]
