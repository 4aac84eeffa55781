"""Supervised pair models on the columns of scored pairs.

Fits that are sums (Gaussian models, Fellegi-Sunter, logistic steps) are aggregates over
all labelled pairs, and their scores are column expressions.  Models without such a form
fit on a bounded, stratified sample of labelled pairs on the driver and are applied by
an Arrow function.  Missing features are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlake.functions.text import sigmoid

LEAST = 10
SAMPLE, SVM_SAMPLE = 2_000, 1_500
RIDGE = 1e-6
SEED = 42

Model = Callable[[DataFrame], DataFrame]


def filled(pairs: DataFrame, features: list[str]) -> DataFrame:
    return pairs.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def stratified(labelled: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """At most about ``n`` rows, each class by its share, in hashed order."""
    sizes = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if total <= n:
        return labelled
    order = Window.partitionBy("y").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "i", "j")), "i", "j")
    quota = F.lit(0)
    for y, size in sizes.items():
        quota = F.when(F.col("y") == y, max(1, round(n * size / total))).otherwise(quota)
    return labelled.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= quota).drop("__r")


def _sample(labelled: DataFrame, features: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = stratified(filled(labelled, features).select("i", "j", "y", *features), n).orderBy("i", "j").toPandas()
    return rows[features].to_numpy(float), rows["y"].to_numpy(int)


def _by_arrow(features: list[str], predict: Callable[[np.ndarray], np.ndarray]) -> Model:
    @F.pandas_udf("double")
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series(predict(np.stack([c.to_numpy(float) for c in columns], 1)))

    return lambda pairs: filled(pairs, features).withColumn("p", apply(*(F.col(f) for f in features)))


def _moments(labelled: DataFrame, features: list[str]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: size, means and sums of centred products, in two passes."""
    means = {r["y"]: r for r in labelled.groupBy("y").agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in features)).collect()}
    centred = labelled
    for f in features:
        m = F.lit(0.0)
        for y, r in means.items():
            m = F.when(F.col("y") == y, F.lit(r[f])).otherwise(m)
        centred = centred.withColumn(f, F.col(f) - m)
    cells = [(a, b) for a in range(len(features)) for b in range(a, len(features))]
    sums = {r["y"]: r for r in centred.groupBy("y").agg(*(F.sum(F.col(features[a]) * F.col(features[b])).alias(f"c{a}_{b}") for a, b in cells)).collect()}
    out = {}
    for y, r in means.items():
        s = np.zeros((len(features), len(features)))
        for a, b in cells:
            s[a, b] = s[b, a] = sums[y][f"c{a}_{b}"]
        out[y] = (float(r["n"]), np.array([r[f] for f in features]), s)
    return out


def _quadratic(features: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    diff = [F.col(f) - float(m) for f, m in zip(features, mean, strict=True)]
    return sum((diff[a] * diff[b] * float(inverse[a, b]) for a in range(len(diff)) for b in range(len(diff))), F.lit(0.0))


def _gaussian(labelled: DataFrame, features: list[str], pooled: bool) -> Model:
    parts = _moments(filled(labelled, features), features)
    total = sum(n for n, _, _ in parts.values())
    eye = RIDGE * np.eye(len(features))
    shared = sum(s for _, _, s in parts.values()) / max(total - len(parts), 1) + eye
    score = {}
    for y, (n, mean, s) in parts.items():
        cov = shared if pooled else s / max(n - 1, 1) + eye
        _, logdet = np.linalg.slogdet(cov)
        score[y] = math.log(n / total) - 0.5 * logdet - 0.5 * _quadratic(features, mean, np.linalg.inv(cov))
    return lambda pairs: filled(pairs, features).withColumn("p", sigmoid(score[1] - score[0]))


def lda(labelled: DataFrame, features: list[str]) -> Model:
    return _gaussian(labelled, features, pooled=True)


def qda(labelled: DataFrame, features: list[str]) -> Model:
    return _gaussian(labelled, features, pooled=False)


def logistic(labelled: DataFrame, features: list[str], ridge: float = 1.0, steps: int = 50) -> Model:
    """Newton steps on the summed loss with an L2 penalty of ``ridge`` on the slopes; each is one aggregate."""
    rows = filled(labelled, features)
    columns = [F.col(f) for f in features] + [F.lit(1.0)]
    k, w = len(columns), np.zeros(len(features) + 1)
    penalty = np.diag([ridge] * len(features) + [0.0])
    for _ in range(steps):
        p = sigmoid(sum((c * float(v) for c, v in zip(columns, w, strict=True)), F.lit(0.0)))
        cells = [(a, b) for a in range(k) for b in range(a, k)]
        sums = rows.agg(*(F.sum((p - F.col("y")) * c) for c in columns), *(F.sum(p * (1 - p) * columns[a] * columns[b]) for a, b in cells)).first()
        gradient = np.array(sums[:k]) + penalty @ w
        hessian = np.zeros((k, k))
        for v, (a, b) in zip(sums[k:], cells, strict=True):
            hessian[a, b] = hessian[b, a] = v
        step = np.linalg.solve(hessian + penalty + 1e-9 * np.eye(k), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    z = sum((F.col(f) * float(v) for f, v in zip(features, w, strict=False)), F.lit(float(w[-1])))
    return lambda pairs: filled(pairs, features).withColumn("p", sigmoid(z))


def fellegi_sunter(labelled: DataFrame, features: list[str], bins: int = 5, smooth: float = 0.5) -> Model:
    """Log-likelihood ratios of binned features, plus the log-odds of the prior."""
    part = lambda f: F.least(F.floor(F.col(f) * bins), F.lit(bins - 1)).cast("int")
    rows = filled(labelled, features)
    long = rows.select("y", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.greatest(part(f), F.lit(0)).alias("b")) for f in features))).alias("x"))
    counts = {(r["f"], r["b"], r["y"]): r["n"] for r in long.groupBy("x.f", "x.b", "y").agg(F.count("*").alias("n")).collect()}  # fields * bins * 2 rows at most
    size = {y: sum(n for (f, _, c), n in counts.items() if f == features[0] and c == y) for y in (0, 1)}
    total = math.log(size[1] / size[0])
    score = F.lit(total)
    for f in features:
        weights = [math.log((counts.get((f, b, 1), 0) + smooth) / (size[1] + smooth * bins)) - math.log((counts.get((f, b, 0), 0) + smooth) / (size[0] + smooth * bins)) for b in range(bins)]
        score = score + F.element_at(F.array(*(F.lit(w) for w in weights)), F.greatest(part(f), F.lit(0)) + 1)
    return lambda pairs: filled(pairs, features).withColumn("p", sigmoid(score))


def knn(labelled: DataFrame, features: list[str], k: int = 5, weighted: bool = False) -> Model:
    """Mean label of the ``k`` nearest of at most ``SAMPLE`` labelled pairs (ties: first pair)."""
    x, y = _sample(labelled, features, SAMPLE)

    def predict(q: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for lo in range(0, len(q), 1024):
            d = np.round(((q[lo : lo + 1024, None, :] - x[None]) ** 2).sum(2), 12)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            w = 1 / (1 + np.take_along_axis(d, near, 1)) if weighted else np.ones(near.shape)
            out[lo : lo + 1024] = (w * y[near]).sum(1) / w.sum(1)
        return out

    return _by_arrow(features, predict)


def wknn(labelled: DataFrame, features: list[str], k: int = 5) -> Model:
    return knn(labelled, features, k, weighted=True)


class _Tree:
    """A regression tree on squared error (for 0/1 targets the same splits as Gini)."""

    def __init__(self, depth: int, least_split: int = 10, least_leaf: int = 2, cuts: int = 40) -> None:
        self.depth, self.least_split, self.least_leaf, self.cuts = depth, least_split, least_leaf, cuts
        self.nodes: list[tuple] = []

    def _split(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, int, float] | None:
        best, n = None, len(y)
        for f in use:
            order = np.argsort(x[:, f], kind="stable")
            v, total = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= self.least_leaf) & (at <= n - self.least_leaf)]
            if len(at) > self.cuts:
                at = at[np.linspace(0, len(at) - 1, self.cuts).astype(int)]
            if not len(at):
                continue
            s = total[at - 1]
            gain = s * s / at + (total[-1] - s) ** 2 / (n - at) - total[-1] ** 2 / n
            k = int(np.argmax(gain))
            if gain[k] > 1e-12 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, leaf=np.mean, pick=None) -> _Tree:
        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(self.nodes)
            self.nodes.append(())
            use = np.arange(x.shape[1]) if pick is None else pick(x.shape[1])
            best = self._split(x[rows], y[rows], use) if depth < self.depth and len(rows) >= self.least_split else None
            if best is None:
                self.nodes[me] = (None, float(leaf(rows if leaf is not np.mean else y[rows])))
                return me
            right = x[rows, best[1]] > best[2]
            self.nodes[me] = (best[1], best[2], grow(rows[~right], depth + 1), grow(rows[right], depth + 1))
            return me

        grow(np.arange(len(y)), 0)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x)), [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            node = self.nodes[k]
            if node[0] is None:
                out[rows] = node[1]
            else:
                right = x[rows, node[0]] > node[1]
                todo += [(node[2], rows[~right]), (node[3], rows[right])]
        return out


def tree(labelled: DataFrame, features: list[str]) -> Model:
    """A Gini tree of depth 6."""
    x, y = _sample(labelled, features, SAMPLE)
    return _by_arrow(features, _Tree(6).fit(x, y.astype(float)))


def forest(labelled: DataFrame, features: list[str], trees: int = 30) -> Model:
    """Bootstrap trees on random subsets of about the square root of the features."""
    x, y = _sample(labelled, features, SAMPLE)
    rng, use = np.random.default_rng(SEED), max(1, round(math.sqrt(len(features))))
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_Tree(6).fit(x[rows], y[rows].astype(float), pick=lambda n: np.sort(rng.choice(n, use, replace=False))))
    return _by_arrow(features, lambda q: np.clip(np.mean([t(q) for t in grown], 0), 0, 1))


def boosting(labelled: DataFrame, features: list[str], rounds: int = 50, rate: float = 0.1) -> Model:
    """Trees of depth 3 on the gradient of the logistic loss, leaves by a Newton step."""
    x, y = _sample(labelled, features, SAMPLE)
    rate0 = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start, grown = math.log(rate0 / (1 - rate0)), []
    z = np.full(len(y), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        grown.append(_Tree(3).fit(x, g, leaf=lambda rows: g[rows].sum() / h[rows].sum()))
        z = z + rate * grown[-1](x)
    return _by_arrow(features, lambda q: 1 / (1 + np.exp(-(start + rate * sum(t(q) for t in grown)))))


def network(labelled: DataFrame, features: list[str], hidden: int = 8, epochs: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """One tanh layer on standardised features, full-batch Adam."""
    x, y = _sample(labelled, features, SAMPLE)
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    x, rng = (x - mean) / sd, np.random.default_rng(SEED)
    w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, epochs + 1):
        a = np.tanh(x @ w[0] + w[1])
        d = (1 / (1 + np.exp(-(a @ w[2] + w[3]))) - y) / len(y)
        da = np.outer(d, w[2]) * (1 - a * a)
        grads = [x.T @ da + decay * w[0], da.sum(0), a.T @ d + decay * w[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return _by_arrow(features, lambda q: 1 / (1 + np.exp(-(np.tanh((q - mean) / sd @ w[0] + w[1]) @ w[2] + w[3]))))


def svm_radial(labelled: DataFrame, features: list[str], c: float = 1.0, steps: int = 20_000) -> Model:
    """RBF kernel machine by pairwise dual ascent on the most violating pair, with Platt scaling."""
    x, y01 = _sample(labelled, features, SVM_SAMPLE)
    gamma, y = 1 / len(features), np.where(y01 > 0, 1.0, -1.0)
    kernel = lambda q: np.exp(-gamma * ((q[:, None, :] - x[None]) ** 2).sum(2))
    k = kernel(x)
    alpha, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up, low = np.where(y > 0, alpha < c - 1e-12, alpha > 1e-12), np.where(y > 0, alpha > 1e-12, alpha < c - 1e-12)
        s = -y * g
        a, b = int(np.argmax(np.where(up, s, -np.inf))), int(np.argmin(np.where(low, s, np.inf)))
        if s[a] - s[b] < 1e-3:
            break
        step = (s[a] - s[b]) / max(k[a, a] + k[b, b] - 2 * k[a, b], 1e-12)
        step = min(step, c - alpha[a] if y[a] > 0 else alpha[a], alpha[b] if y[b] > 0 else c - alpha[b])
        alpha[a] += y[a] * step
        alpha[b] -= y[b] * step
        g += y * (k[:, a] - k[:, b]) * step
    s = -y * g
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    bias = float(s[free].mean()) if free.any() else float(s.mean())
    f = k @ (alpha * y) + bias
    pa, pb = 1.0, 0.0
    for _ in range(50):  # Platt scaling with a unit ridge on the slope
        p = 1 / (1 + np.exp(-(pa * f + pb)))
        w = p * (1 - p)
        h = np.array([[(w * f * f).sum() + 1, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-9]])
        d = np.linalg.solve(h, [((p - y01) * f).sum() + pa, (p - y01).sum()])
        pa, pb = pa - d[0], pb - d[1]
        if np.abs(d).max() < 1e-8:
            break
    keep = alpha > 1e-9
    xs, coef = x[keep], (alpha * y)[keep]
    return _by_arrow(features, lambda q: 1 / (1 + np.exp(-(pa * (np.exp(-gamma * ((q[:, None, :] - xs[None]) ** 2).sum(2)) @ coef + bias) + pb))))


#: Pair models by name: ``f(labelled(i, j, y, features...), features) -> model``; a model adds ``p`` to pairs.
MODELS: dict[str, Callable[[DataFrame, list[str]], Model]] = {
    "logistic": logistic, "lda": lda, "qda": qda, "knn": knn, "wknn": wknn, "tree": tree, "rf": forest, "xgboost": boosting,
    "nnet": network, "fellegi_sunter": fellegi_sunter, "svm_radial": svm_radial,
}


def train(name: str, labelled: DataFrame, features: list[str]) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown pair model: {name}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name](labelled, features)


def trainable(labelled: DataFrame) -> bool:
    """At least ``LEAST`` rows and both classes."""
    r = labelled.agg(F.count("*").alias("n"), F.countDistinct("y").alias("c")).first()
    return r["n"] >= LEAST and r["c"] == 2
