"""Toxicity by maximum-scoring segments of token log-odds.

Training reads a bounded sample of labelled documents (``TRAIN_ROWS``, those of
smallest hash), one of each set of near copies.  A word's log-odds is its share of
toxic documents against the base rate under a Dirichlet prior of ``PRIOR``
pseudo-documents; a word without enough evidence takes that of its longest known
prefix, so unseen inflections count.  Every token also costs ``DRIFT``, so chance
runs sink.  All words and prefixes with ``EVIDENCE`` are kept: their number is bounded
by the sample.

Scoring finds all maximal-scoring segments of a whole text in linear time (each is
one passage).  Their scores are calibrated by the extreme-value law of the best
segment of clean texts, ``P(best < s) = exp(-K n exp(-lambda s))``, fitted by maximum
likelihood; the calibrated scores of the significant passages are summed up and a
logistic curve on that turns them into a probability.

Edge cases: null, empty and wordless texts have no passage and the score of a text
without any; equal rows score equally; unlabelled tables (or one class only) score
everything 0; conflicting labels of one id count as toxic; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.llm.shingles import shingle_sets
from kinlake.session import small_batches, stash, table, trimmed

TRAIN_ROWS = 20_000
PRIOR = 4.0
DRIFT = 0.5
EVIDENCE = 3.5
PREFIXES = (7, 6, 5, 4)
SIGNIFICANT = 1.0
CACHE = 60_000
COUNTED_AT_ONCE = 100_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    slope: float = 0.0
    intercept: float = -math.inf


class _Scores(dict):
    """Scores of words, with the backed-off ones added as they come, up to a bound."""

    def __init__(self, model: Model) -> None:
        super().__init__({w: s - DRIFT for w, s in model.words.items()})
        self.prefixes, self.room = model.prefixes, CACHE

    def __missing__(self, word: str) -> float:
        score = next((s for k in PREFIXES if len(word) >= k and (s := self.prefixes.get(word[:k])) is not None), 0.0) - DRIFT
        if self.room > 0:
            self.room -= 1
            self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as ``(first, end, score)``, in linear time."""
    total = np.zeros(len(scores) + 1)
    np.cumsum(scores, out=total[1:])
    held: list[list] = []  # [first, end, total before, total after, place of the last one to the left with a smaller total before]
    for k in np.flatnonzero(scores > 0).tolist():
        new = [k, k + 1, float(total[k]), float(total[k + 1]), -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            new[4] = j
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3], -1]
            del held[j:]
    return [(a, b, after - before) for a, b, before, after, _ in held]


def _segments(text: str | None, scores: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return 0, []
    return len(words), maximal_segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))


def _evidence(n: int, segments: list[tuple[int, int, float]], model: Model) -> list[float]:
    """Calibrated scores: minus the log of how many segments that good chance would give."""
    return [model.rate * s - math.log(model.scale * n) for _, _, s in segments]


def _feature(evidence: list[float]) -> float:
    return math.sqrt(sum(x for x in evidence if x >= SIGNIFICANT))


def _chance(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 500), -500))) if x > -math.inf else 0.0


def _score(n: int, segments: list[tuple[int, int, float]], model: Model) -> tuple[float, list[float]]:
    """The probability of a text of ``n`` words, and its segments' calibrated scores."""
    evidence = _evidence(n, segments, model)
    return _chance(model.intercept + model.slope * _feature(evidence)), evidence


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(text, toxic)`` of at most ``rows`` labelled documents, one of each set of near copies."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "__doc")
    picked = documents.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__doc")).select("text", (F.col("toxic") > 0).alias("toxic"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for k in range(len(batch)):
                h, _ = shingle_sets(batch.column("text").slice(k, 1))
                keys.append(int(h[0].view(np.int64)) if len(h) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("text"), batch.column("toxic")], names=["key", "text", "toxic"])

    keyed = picked.mapInArrow(trimmed(least), "key long, text string, toxic boolean")
    return keyed.groupBy("key").agg(F.min(F.struct("text", "toxic")).alias("one")).select("one.*")  # of each key always the same one


def _unit_counts(sample: DataFrame) -> DataFrame:
    """``(unit, toxic, clean)`` documents that hold each word (``w:``) or prefix (``p:``)."""

    def flush(seen: dict[bool, Counter]) -> pa.RecordBatch:
        units = list(seen[True] | seen[False])
        return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([seen[True][u] for u in units], pa.int64()), pa.array([seen[False][u] for u in units], pa.int64())], names=["unit", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORD.findall((text.as_py() or "").lower()))
                seen[toxic].update({"w:" + w for w in words} | {"p:" + w[:k] for w in words for k in PREFIXES if len(w) >= k})
                if len(seen[True]) + len(seen[False]) > COUNTED_AT_ONCE:
                    yield flush(seen)
                    seen = {True: Counter(), False: Counter()}
        if seen[True] or seen[False]:
            yield flush(seen)

    return sample.mapInArrow(trimmed(count), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _measured(sample: DataFrame, model: Model, number: Callable[[int, list[tuple[int, int, float]], Model], float]) -> list[tuple[bool, int, float]]:
    """``(toxic, words, number)`` of each sampled document with words, in an order of its own: three numbers
    for each of the bounded sample's rows, however long they are."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            found = [_segments(text.as_py(), scores) for text in batch.column("text")]
            values = [number(n, segments, shared.value) if n else 0.0 for n, segments in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array(values, pa.float64())], names=["toxic", "n", "value"])

    rows = sample.mapInArrow(trimmed(measure), "toxic boolean, n long, value double").where("n > 0").collect()
    return sorted((r["toxic"], r["n"], r["value"]) for r in rows)


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on ``labels(doc_id, toxic)``; the driver gets the model's units and a few numbers per sampled document."""
    small_batches(documents.sparkSession)
    sample = stash(training_sample(documents, labels, rows), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model()
    base = toxic / (toxic + clean)
    share = (F.col("toxic") + PRIOR * base) / (F.col("toxic") + F.col("clean") + PRIOR)
    odds = F.log(share / (1 - share)) - math.log(base / (1 - base))
    spread = F.sqrt(1 / (F.col("toxic") + PRIOR * base) + 1 / (F.col("clean") + PRIOR * (1 - base)))
    units = (
        _unit_counts(sample)
        .where("toxic + clean >= 3")
        .select("unit", odds.alias("odds"), (F.abs(odds) / spread).alias("z"))
        .where(F.col("z") >= EVIDENCE)
        .collect()
    )
    model = Model({r["unit"][2:]: r["odds"] for r in units if r["unit"][0] == "w"}, {r["unit"][2:]: r["odds"] for r in units if r["unit"][0] == "p"})
    measured = _measured(sample, model, lambda n, found, _: max((s for _, _, s in found), default=0.0))
    best = [(n, s) for toxic, n, s in measured if not toxic]
    model.rate, model.scale = _extreme_value(np.array([n for n, _ in best], float), np.array([s for _, s in best]))
    measured = _measured(sample, model, lambda n, found, fitted: _feature(_evidence(n, found, fitted)))
    x, y = np.array([v for _, _, v in measured]), np.array([float(t) for t, _, _ in measured])
    model.slope, model.intercept = _logistic(x, y)
    return model


def _extreme_value(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of ``exp(-K n exp(-lambda s))``: K in closed form, lambda on a grid that is refined."""
    if not len(n):
        return 1.0, 1.0

    def fitted(rate: float) -> tuple[float, float]:
        weights = n * np.exp(-rate * best)
        k = len(n) / weights.sum()
        return float((np.log(rate * k * weights) - k * weights).sum()), k

    grid = np.linspace(0.2, 3.0, 57)
    for _ in range(3):
        rate = max(grid, key=lambda r: fitted(r)[0])
        grid = np.linspace(max(0.05, rate - (grid[1] - grid[0])), rate + (grid[1] - grid[0]), 21)
    return float(rate), float(fitted(rate)[1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """One slope and an intercept by Newton steps with a small ridge on the slope."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.array([w[0], 0])
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, passages)``: the significant passages as character spans with their calibrated scores."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(passage))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        scores = _Scores(fitted)
        for batch in batches:
            values, spans = [], []
            for text in batch.column("text"):
                text = text.as_py()
                n, found = _segments(text, scores)
                value, evidence = _score(n, found, fitted) if n else (_chance(fitted.intercept), [])
                values.append(value)
                strong = [(a, b, e) for (a, b, _), e in zip(found, evidence, strict=True) if e >= SIGNIFICANT]
                if strong:
                    at = [m.span() for m in WORD.finditer(text.lower())]
                    strong = [{"start": at[a][0], "end": at[b - 1][1], "evidence": e} for a, b, e in strong]
                spans.append(strong)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64()), pa.array(spans, pa.list_(passage))], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(score), "doc_id long, score double, passages array<struct<start:int,end:int,evidence:double>>")


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(3))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out third."""
    return table(spark, sf_dir, "labels").where(remainder() != 1).select("doc_id", "toxic")


THRESHOLD = 0.7


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns; rows are judged where they are read."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    text_at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        scores = _Scores(fitted)
        for batch in batches:
            found = (_segments(text.as_py(), scores) for text in batch.column(text_at))
            values = [_score(n, segments, fitted)[0] if n else _chance(fitted.intercept) for n, segments in found]
            yield batch.filter(pa.array([v < threshold for v in values], pa.bool_()))

    return documents.mapInArrow(trimmed(keep), documents.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learns from labels outside the held-out third."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, training_labels(spark, sf_dir))
    out = score_documents(documents, model)
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
