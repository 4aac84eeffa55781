"""Grouping records from scored pairs.

``tc`` is distributed.  The others work on one connected part of the graph at a time
(``applyInPandas`` by component): the rules of ``center``, ``mc``, ``gc`` and of greedy
modularity only touch neighbours, and for ``hc`` records without a pair are at the
largest distance, so below height 1 no merge crosses components.  ``hclust_*``, ``pam``
and ``hdbscan`` need all distances at once; they are one group and refuse more records
than their cap.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.operators.components import connected_components
from kinlake.operators.truth import compact
from kinlake.session import stash

DENSE_CAP, HDBSCAN_CAP, COMPONENT_CAP = 1_500, 3_000, 50_000
CHUNK = 256
CELLS = 1 << 22  # distances that are made at a time, where all are too many

Grouper = Callable[[np.ndarray, np.ndarray, np.ndarray, int, dict], np.ndarray]


def transitive_closure(links: DataFrame, records: DataFrame, rid: str = "rid") -> DataFrame:
    """``(rid, label)``: connected components; a record without a link is alone."""
    comp = connected_components(links, "i", "j")
    ids = records.select(F.col(rid).alias("rid"))
    return compact(ids.join(comp, F.col("rid") == F.col("node"), "left").select("rid", F.coalesce("component", "rid").alias("label")))


def by_component(pairs: DataFrame, records: DataFrame, group: Grouper, rid: str = "rid", cap: int = COMPONENT_CAP, **options) -> DataFrame:
    """``(rid, label)``: ``group(i, j, w, n, options)`` on each component of ``pairs(i, j, w)``.

    A component of more than ``cap`` records is an error, not a cut.
    """
    comp = connected_components(pairs, "i", "j")
    inside = pairs.join(comp, pairs["i"] == comp["node"]).select("component", "i", "j", "w")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["i", "j"]].to_numpy())
        if len(ids) > cap:
            raise ValueError(f"a component of {len(ids)} records is over the cap of {cap}")
        rows = rows.sort_values(["i", "j"])
        labels = group(np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"]), rows["w"].to_numpy(float), len(ids), options)
        first = pd.Series(ids).groupby(labels).transform("min")
        return pd.DataFrame({"rid": ids, "label": first.to_numpy()})

    found = inside.groupBy("component").applyInPandas(solve, "rid long, label long")
    ids = records.select(F.col(rid).alias("rid"))
    return compact(ids.join(found, "rid", "left").select("rid", F.coalesce("label", "rid").alias("label")))


def at_once(pairs: DataFrame, records: DataFrame, group: Grouper, cap: int, rid: str = "rid", **options) -> DataFrame:
    """``(rid, label)``: ``group`` on all records together, refused above ``cap``."""
    n = records.count()
    if n > cap:
        raise ValueError(f"this method needs all distances at once: {n} records are over the cap of {cap}")
    rows = records.select(F.col(rid).alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("w")).unionByName(pairs.select("i", "j", "w"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(rows.loc[rows["j"].isna(), "i"].to_numpy())
        edges = rows.dropna(subset=["j"]).sort_values(["i", "j"])
        labels = group(np.searchsorted(ids, edges["i"]), np.searchsorted(ids, edges["j"].astype("int64")), edges["w"].to_numpy(float), len(ids), options)
        return pd.DataFrame({"rid": ids, "label": pd.Series(ids).groupby(labels).transform("min").to_numpy()})

    return compact(rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(solve, "rid long, label long"))


class Distances:
    """The distances of points by row, made when asked for: Euclidean, 1 at most, to nine places."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, rows: int | slice) -> np.ndarray:
        at = np.arange(len(self))[rows]
        own = self.x[at][..., None, :] if np.ndim(at) else self.x[at]
        d = 1 - np.round(1 - np.minimum(np.sqrt(sum((own[..., k] - self.x[:, k]) ** 2 for k in range(self.x.shape[1]))), 1), 9)
        d[(np.arange(len(at)), at) if np.ndim(at) else at] = 0
        return d

    def matrix(self) -> np.ndarray:
        d = np.empty((len(self), len(self)))
        for lo in range(0, len(self), CHUNK):
            d[lo : lo + CHUNK] = self[lo : lo + CHUNK]
        return d


def points_at_once(points: DataFrame, group: Callable[[np.ndarray | Distances, dict], np.ndarray], columns: list[str], rid: str = "rid", matrix: bool = True, **options) -> DataFrame:
    """``(rid, label)``: ``group(distances, options)`` on all records of ``points`` together, without a cap.

    Distances are Euclidean over ``columns``, 1 at most, to nine places.  Only the points are moved; the matrix is made in
    the one task, which needs some 16 to 32 bytes for each pair of records.  Without ``matrix``, ``group`` gets
    :class:`Distances`, of which no more than some rows are held.
    """
    rows = points.select(F.col(rid).cast("long").alias("rid"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        ids, d = rows["rid"].to_numpy(), Distances(rows[[f"c{k}" for k in range(len(columns))]].to_numpy())
        return pd.DataFrame({"rid": ids, "label": pd.Series(ids).groupby(group(d.matrix() if matrix else d, options)).transform("min").to_numpy()})

    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda g: solve(g.drop(columns="one")), "rid long, label long")
    return compact(stash(found, "point-groups"))  # which reads it more than once


class _Sets:
    """Disjoint sets; the first of two stays the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(b)] = self.root(a)

    def labels(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))])


def star(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    """CENTER: in order of falling score the smaller end of a pair, if new, becomes a center; a
    center recruits ends that are new.  With ``merge`` a pair that touches a center joins two clusters."""
    sets, center, member = _Sets(n), np.zeros(n, bool), np.zeros(n, bool)
    for k in np.lexsort((j, i, -w)):
        a, b = int(i[k]), int(j[k])
        if not member[a]:
            center[a] = member[a] = True
        if member[b]:
            if options.get("merge") and (center[a] or center[b]):
                sets.join(a, b)
        elif center[a]:
            sets.join(a, b)
            member[b] = True
    return sets.labels()


def _weights(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> list[dict[int, float]]:
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
        if a != b:
            near[a][b] += x
            near[b][a] += x
    return near


def average_linkage_cut(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    """Average linkage on ``1 - w`` (absent pairs at 1), merging while the least mean distance is at most ``height``."""
    height = options.get("height", 0.5)
    near, size, sets, alive = _weights(i, j, w, n), [1] * n, _Sets(n), [True] * n
    heap = [(1 - x, a, b) for a in range(n) for b, x in near[a].items() if a < b]
    heapq.heapify(heap)
    while heap:
        d, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or abs(d - (1 - near[a].get(b, -9) / (size[a] * size[b]))) > 1e-12:
            continue  # of clusters that have merged since
        if d > height:
            break
        alive[b] = False
        sets.join(a, b)
        size[a] += size[b]
        near[a].pop(b)
        for c, x in near[b].items():
            if c != a:
                near[c].pop(b)
                near[a][c] += x
                near[c][a] = near[a][c]
        for c, x in near[a].items():
            heapq.heappush(heap, (1 - x / (size[a] * size[c]), min(a, c), max(a, c)))
    return sets.labels() if height < 1 else np.zeros(n, int)


def clique_partition(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    """Recursive largest first on the links: from the free record of most free neighbours a clique
    grows by the candidate of most neighbours among the candidates."""
    near = [set(x) for x in _weights(i, j, w, n)]
    free, labels = set(range(n)), np.zeros(n, int)
    count = np.array([len(x) for x in near])  # free neighbours of the free; -1 for the others
    while free:
        seed = int(np.argmax(count))
        clique, rest = [seed], near[seed] & free
        while rest:
            v = max(rest, key=lambda x: (len(near[x] & rest), -x))
            clique.append(v)
            rest = rest & near[v]
        labels[clique] = seed
        free -= set(clique)
        count[clique] = -1
        for v in clique:
            for u in near[v] & free:
                count[u] -= 1
    return labels


def greedy_modularity(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    """Agglomeration by the largest gain in modularity; ``total`` is the weight of the whole graph."""
    near, sets = _weights(i, j, w, n), _Sets(n)
    total = options.get("total") or float(w.sum())
    share = [sum(x.values()) / (2 * total) for x in near]
    gain = lambda a, b: 2 * (near[a][b] / (2 * total) - share[a] * share[b])
    heap = [(-gain(a, b), a, b) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if b not in near[a] or a not in near[b] or abs(-g - gain(a, b)) > 1e-12:
            continue
        if -g <= 0:
            break
        sets.join(a, b)
        share[a] += share[b]
        share[b] = 0.0
        near[a].pop(b)
        for c, x in near[b].items():
            if c != a:
                near[c].pop(b)
                near[a][c] += x
                near[c][a] = near[a][c]
        near[b] = {}
        for c in near[a]:
            heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))
    return sets.labels()


def _move(near: list[dict[int, float]], label: list[int], strength: list[float], total: float, resolution: float, rng: np.random.Generator, within: list[int] | None = None) -> bool:
    """Local moves of modularity until none gains; with ``within`` only inside equal groups."""
    weight: dict[int, float] = defaultdict(float)
    for v, c in enumerate(label):
        weight[c] += strength[v]
    moved, again = False, True
    while again:
        again = False
        for v in rng.permutation(len(near)).tolist():
            links: dict[int, float] = defaultdict(float)
            for u, x in near[v].items():
                if u != v and (within is None or within[u] == within[v]):
                    links[label[u]] += x
            here = label[v]
            weight[here] -= strength[v]
            value = lambda c: links.get(c, 0.0) - resolution * strength[v] * weight[c] / (2 * total)  # noqa: B023, E731
            best = max(sorted(links), key=value, default=here)
            if best != here and value(best) > value(here) + 1e-12:
                label[v], again, moved = best, True, True
            weight[label[v]] += strength[v]
    return moved


def leiden(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    """Local moves, a refinement inside communities, and aggregation of the refined groups; with
    ``refine=False`` this is the Louvain method."""
    rng = np.random.default_rng(options.get("seed", 42))
    resolution, refine = options.get("resolution", 1.0), options.get("refine", True)
    near = [dict(x) for x in _weights(i, j, w, n)]
    total = options.get("total") or float(w.sum())
    if not total:
        return np.arange(n)
    of, label = np.arange(n), list(range(n))
    for _ in range(options.get("rounds", 50)):
        strength = [sum(x.values()) for x in near]
        moved = _move(near, label, strength, total, resolution, rng)
        if refine:
            fine = list(range(len(near)))
            _move(near, fine, strength, total, resolution, rng, within=label)
        else:
            fine = label
        if not moved and len(set(fine)) == len(near):
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(fine))}
        merged: list[dict[int, float]] = [defaultdict(float) for _ in names]
        parent = [0] * len(names)
        for v, x in enumerate(near):
            parent[names[fine[v]]] = label[v]
            for u, y in x.items():
                merged[names[fine[v]]][names[fine[u]]] += y
        of = np.array([names[fine[v]] for v in of])
        communities = {c: k for k, c in enumerate(dict.fromkeys(parent))}
        near, label = [dict(x) for x in merged], [communities[c] for c in parent]
        if len(near) == 1:
            break
    return np.array([label[v] for v in of])


def label_propagation(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    """Asynchronous weighted label propagation; a record keeps its label when that is among the best."""
    rng, near, label = np.random.default_rng(options.get("seed", 42)), _weights(i, j, w, n), list(range(n))
    for _ in range(options.get("rounds", 100)):
        changed = False
        for v in rng.permutation(n).tolist():
            votes: dict[int, float] = defaultdict(float)
            for u, x in near[v].items():
                votes[label[u]] += x
            if votes:
                top = max(votes.values())
                best = [c for c, x in votes.items() if x >= top - 1e-12]
                if label[v] not in best:
                    label[v], changed = min(best), True
        if not changed:
            break
    return np.array(label)


def distances(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    d = np.ones((n, n))
    np.minimum.at(d, (i, j), 1 - w)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 0)
    return d


def mean_silhouette(d: np.ndarray, labels: np.ndarray, of: np.ndarray | None = None) -> float:
    """NaN unless there are between 2 and ``n - 1`` clusters; a cluster of one counts 0.

    With ``of``, each record's point, ``d`` holds the distances of points.
    """
    names, at = np.unique(labels, return_inverse=True)
    if len(names) < 2 or len(names) >= len(labels):
        return float("nan")
    member = np.eye(len(names))[at]
    size, total = member.sum(0), d @ member if of is None else (d @ _counted(of, at, len(d), len(names)))[of]
    own = total[np.arange(len(at)), at] / np.maximum(size[at] - 1, 1)
    other = np.where(member > 0, np.inf, total / size).min(1)
    s = np.where(size[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(s.mean())


def _counted(of: np.ndarray, at: np.ndarray, points: int, clusters: int) -> np.ndarray:
    """How many records of each point are in each cluster."""
    return np.bincount(of * clusters + at, minlength=points * clusters).reshape(points, clusters).astype(float)


def _merges(d: np.ndarray, ward: bool, size: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The order in which clusters merge, by the Lance-Williams recurrence; ``size`` are the records of each at first (1).

    Each row's least distance is kept, and made anew only where it went to one of the two that merge.
    """
    n = len(d)
    x = d * d if ward else d.astype(float, copy=True)
    if ward and size is not None:
        for lo in range(0, n, CHUNK):
            own = size[lo : lo + CHUNK, None]
            x[lo : lo + CHUNK] *= 2 * own * size / (own + size)
    np.fill_diagonal(x, np.inf)
    size, out = np.ones(n) if size is None else size.astype(float), []
    near = x.argmin(1) if n else np.zeros(0, int)
    least = x[np.arange(n), near]
    for _ in range(n - 1):
        a = int(np.argmin(least))
        a, b = sorted((a, int(near[a])))
        out.append((a, b))
        if ward:
            new = ((size[a] + size) * x[a] + (size[b] + size) * x[b] - size * x[a, b]) / (size[a] + size[b] + size)
        else:
            new = (size[a] * x[a] + size[b] * x[b]) / (size[a] + size[b])
        new[[a, b]] = np.inf
        new[np.isinf(x[a])] = np.inf
        x[a], x[:, a] = new, new
        x[b], x[:, b] = np.inf, np.inf
        size[a] += size[b]
        stale = np.flatnonzero((near == a) | (near == b))
        closer = (new < least) | ((new == least) & (a < near) & np.isfinite(new))
        near[closer], least[closer] = a, new[closer]
        for lo in range(0, len(stale), CHUNK):
            rows = stale[lo : lo + CHUNK]
            near[rows] = x[rows].argmin(1)
            least[rows] = x[rows, near[rows]]
        near[a], near[b] = int(new.argmin()), 0
        least[a], least[b] = new[near[a]], np.inf
    return out


def cut(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    sets = _Sets(n)
    for a, b in merges[: n - k]:
        sets.join(a, b)
    return sets.labels()


def _best(d: np.ndarray, choices: list[int], labels_for: Callable[[int], np.ndarray], of: np.ndarray | None = None) -> np.ndarray:
    """The grouping of highest mean silhouette; one cluster when none can be judged."""
    n = len(d) if of is None else len(of)
    found = [(s, labels) for k in choices if 2 <= k < n and not np.isnan(s := mean_silhouette(d, labels := labels_for(k), of))]
    return max(found, key=lambda x: x[0])[1] if found else np.zeros(n, int)


def hclust_of(d: np.ndarray, options: dict) -> np.ndarray:
    n, merges = len(d), _merges(d, options.get("ward", False))
    return _best(d, options.get("choices", [2, 3, 5, 8, 12]), lambda k: cut(merges, n, k))


def hclust_points(d: Distances, options: dict) -> np.ndarray:
    """As :func:`hclust_of` on all distances.  Records of equal points merge first, at distance 0, so the distances of
    different points are made only, and a point counts as often as it has records."""
    _, first, at = np.unique(d.x, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    first, of, n = first[order], np.argsort(order)[at.ravel()], len(d)
    points = Distances(d.x[first]).matrix()
    copies = np.argsort(of, kind="stable")
    copies = copies[first[of[copies]] != copies]
    merges = list(zip(first[of[copies]].tolist(), copies.tolist(), strict=True))
    merges += [(int(first[a]), int(first[b])) for a, b in _merges(points, options.get("ward", False), np.bincount(of, minlength=len(first)))]
    return _best(points, options.get("choices", [2, 3, 5, 8, 12]), lambda k: cut(merges, n, k), of)


def hclust(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    return hclust_of(distances(i, j, w, n), options)


def pam(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    return pam_of(distances(i, j, w, n), options)


def _by_column(d: np.ndarray, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The column sums of ``value(d)``, made for some columns at a time."""
    return np.concatenate([value(d[:, lo : lo + CHUNK]).sum(0) for lo in range(0, len(d), CHUNK)])


def pam_of(d: np.ndarray, options: dict) -> np.ndarray:
    """k-medoids: greedy build, then the best swap until none helps."""
    n = len(d)

    def medoids(k: int) -> np.ndarray:
        chosen = [int(np.argmin(d.sum(0)))]
        while len(chosen) < k:
            base = d[:, chosen].min(1)[:, None]
            gains = _by_column(d, lambda part: np.maximum(base - part, 0))  # noqa: B023
            gains[chosen] = -1
            chosen.append(int(np.argmax(gains)))
        for _ in range(options.get("swaps", 100)):
            now, best = d[:, chosen].min(1).sum(), None
            for k_, _ in enumerate(chosen):
                kept = [c for c in chosen if c != chosen[k_]]
                base = (d[:, kept].min(1) if kept else np.full(n, np.inf))[:, None]
                costs = _by_column(d, lambda part: np.minimum(base, part))  # noqa: B023
                costs[chosen] = np.inf
                x = int(np.argmin(costs))
                if costs[x] < now - 1e-12 and (best is None or costs[x] < best[0]):
                    best = (costs[x], k_, x)
            if best is None:
                break
            chosen[best[1]] = best[2]
        return np.array(chosen)[np.argmin(d[:, chosen], 1)]

    return _best(d, options.get("choices", [2, 3, 5, 8]), medoids)


def hdbscan(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, options: dict) -> np.ndarray:
    return hdbscan_of(distances(i, j, w, n), options)


def hdbscan_of(d: np.ndarray | Distances, options: dict) -> np.ndarray:
    """Density clusters: mutual reachability, minimum spanning tree, condensed tree, excess of mass.

    The whole set is never a cluster; noise is alone.  Rows of distances are asked for, never all of them.
    """
    n = len(d)
    if n < 2:
        return np.zeros(n, int)
    points = options.get("min_points", 3)
    least = max(2, min(points, n))
    nth, core = max(1, min(points, n - 1)) - 1, np.empty(n)
    step = max(1, min(CHUNK, CELLS // n))
    for lo in range(0, n, step):
        away = d[lo : lo + step].copy()
        away[np.arange(len(away)), np.arange(lo, lo + len(away))] = np.inf
        core[lo : lo + step] = np.partition(away, nth, 1)[:, nth]
    reach = lambda v: np.maximum(np.maximum(core[v], core), d[v])

    # Prim from record 0
    done, best, parent, tree = np.zeros(n, bool), reach(0), np.zeros(n, int), []
    done[0] = True
    for _ in range(n - 1):
        v = int(np.argmin(np.where(done, np.inf, best)))
        tree.append((best[v], int(parent[v]), v))
        done[v] = True
        away = reach(v)
        nearer = ~done & (away < best)
        best[nearer], parent[nearer] = away[nearer], v
    tree.sort(key=lambda e: e[0])

    # single-linkage tree: nodes from n on
    sets, top, many = _Sets(n), list(range(n)), [1] * n
    kids: dict[int, tuple[int, int]] = {}
    born: dict[int, float] = {}
    for x, a, b in tree:
        a, b = sets.root(a), sets.root(b)
        if many[top[a]] < many[top[b]]:
            a, b = b, a
        node = n + len(kids)
        kids[node], born[node] = (top[a], top[b]), 1 / x if x > 1e-9 else 1e9
        many.append(many[top[a]] + many[top[b]])
        sets.join(a, b)
        top[sets.root(a)] = node
    root = n + len(kids) - 1
    longest = max(born.values())
    first, leaves = [0] * len(many), np.empty(n, int)  # a node's records are neighbours among the leaves
    for node in range(root, n - 1, -1):
        a, b = kids[node]
        first[a], first[b] = first[node], first[node] + many[a]
    leaves[first[:n]] = np.arange(n)
    below = lambda node: leaves[first[node] : first[node] + many[node]]

    # condensed tree: [node, lambda of birth, lambda of split, children]
    clusters: list[list] = [[root, 0.0, np.inf, []]]
    left, todo = np.full(n, np.inf), [(root, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        big = [s for s in kids[node] if many[s] >= least]
        if len(big) == 2:
            clusters[c][2] = born[node]
            for s in big:
                clusters[c][3].append(len(clusters))
                todo.append((s, len(clusters)))
                clusters.append([s, born[node], np.inf, []])
            continue
        for s in kids[node]:
            if s not in big:
                left[below(s)] = born[node]
        todo += [(s, c) for s in big]
    mass = []
    for node, birth, split, _ in clusters:
        out = left[below(node)]
        end = split if np.isfinite(split) else longest
        mass.append(float((np.minimum(out[out >= birth], end) - birth).sum()))
    chosen, value = [False] * len(clusters), list(mass)
    for c in range(len(clusters) - 1, 0, -1):
        own = clusters[c][3]
        if own and mass[c] <= sum(value[k] for k in own):
            value[c] = sum(value[k] for k in own)
            continue
        chosen[c] = True
        todo_down = list(own)
        while todo_down:
            k = todo_down.pop()
            chosen[k] = False
            todo_down += clusters[k][3]
    labels = n + len(clusters) + np.arange(n)
    for c, (node, birth, _, _) in enumerate(clusters):
        if chosen[c]:
            members = below(node)
            labels[members[left[members] >= birth]] = c
    return labels


def community_links(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs(i, j, score)`` above 0 whose ends share a group of ``groups(rid, label)``."""
    end = lambda e: groups.select(F.col("rid").alias(e), F.col("label").alias(f"__{e}"))
    return pairs.where("score > 0").join(end("i"), "i").join(end("j"), "j").where("__i = __j").select("i", "j", "score")


def _weighted(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", F.col("score").alias("w"))


def _positive(pairs: DataFrame) -> DataFrame:
    return _weighted(pairs.where("score > 0"))


def _community(method: Grouper, **fixed) -> Callable[..., DataFrame]:
    def run(pairs: DataFrame, records: DataFrame, rid: str = "rid", **options) -> DataFrame:
        edges = _positive(pairs)
        total = edges.agg(F.sum("w").alias("w")).first()["w"] or 0.0
        return by_component(edges, records, method, rid, **({"total": float(total)} | fixed | options))

    return run


#: Groupings of the pair graph, by name: ``f(pairs(i, j, score), records, rid, **options) -> (rid, label)``.
COMMUNITIES: dict[str, Callable[..., DataFrame]] = {
    "louvain": _community(greedy_modularity),
    "leiden": _community(leiden),
    "label_prop": _community(label_propagation),
    "gc": lambda pairs, records, rid="rid", threshold=0.5, **o: by_component(_weighted(pairs.where(F.col("score") >= threshold)), records, clique_partition, rid, **o),
    "hclust_avg": lambda pairs, records, rid="rid", **o: at_once(_positive(pairs), records, hclust, DENSE_CAP, rid, **o),
    "hclust_ward": lambda pairs, records, rid="rid", **o: at_once(_positive(pairs), records, hclust, DENSE_CAP, rid, ward=True, **o),
    "pam": lambda pairs, records, rid="rid", **o: at_once(_positive(pairs), records, pam, DENSE_CAP, rid, **o),
}
louvain_communities = _community(leiden, refine=False)

#: Groupings of points by all their distances, by name: ``f(points, columns, rid, **options)``; no cap.
POINTS: dict[str, Callable[..., DataFrame]] = {
    "hclust_avg": lambda points, columns, rid="rid", **o: points_at_once(points, hclust_points, columns, rid, matrix=False, **o),
    "hclust_ward": lambda points, columns, rid="rid", **o: points_at_once(points, hclust_points, columns, rid, matrix=False, ward=True, **o),
    "pam": lambda points, columns, rid="rid", **o: points_at_once(points, pam_of, columns, rid, **o),
    "hdbscan": lambda points, columns, rid="rid", **o: points_at_once(points, hdbscan_of, columns, rid, matrix=False, **o),
}

#: Groupings of links into entities, by name: ``f(links, pairs, records, rid, **options)``.
CLUSTERERS: dict[str, Callable[..., DataFrame]] = {
    "tc": lambda links, pairs, records, rid="rid", **o: transitive_closure(links, records, rid),
    "center": lambda links, pairs, records, rid="rid", **o: by_component(_weighted(links), records, star, rid),
    "mc": lambda links, pairs, records, rid="rid", **o: by_component(_weighted(links), records, star, rid, merge=True),
    "hc": lambda links, pairs, records, rid="rid", hc_h=0.5, **o: by_component(_positive(pairs), records, average_linkage_cut, rid, height=hc_h),
    "hdbscan": lambda links, pairs, records, rid="rid", hdbscan_min_pts=2, **o: at_once(_weighted(pairs), records, hdbscan, HDBSCAN_CAP, rid, min_points=hdbscan_min_pts),
}
