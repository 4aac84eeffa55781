"""Field similarities and their combination.

Levenshtein and Jaccard are built-in expressions.  Jaro-Winkler has no built-in; it
runs as an Arrow function.  :func:`score_pairs` scores distinct value pairs only, found
in one pass over the pairs, which a join then hands back to the record pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinlake.functions.text import clean, words
from kinlake.session import stash


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).when(longest == 0, F.lit(1.0))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(union > 0, F.size(F.array_intersect(words(a), words(b))) / union).otherwise(0.0))


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro similarity on code points, raised by a shared prefix of up to four when above 0.7."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == ch), None)
        if j is not None:
            taken[j] = True
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    shared = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + shared * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_value(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Similarities by name; each takes two cleaned columns and gives NULL when one is NULL.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {"lv": levenshtein, "jaccard": token_jaccard, "jw": jaro_winkler}
#: Those worth a table of distinct value pairs.
MEMOISED = {"jw", "jaccard", "lv"}
VALUE_ROWS = 500_000


def similarity(method: str, a: Column, b: Column) -> Column:
    if method not in SIMILARITIES:
        raise ValueError(f"unknown similarity: {method}; known: {', '.join(sorted(SIMILARITIES))}")
    return SIMILARITIES[method](a, b)


def combine(scores: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean over the scores that aren't NULL; 0 when there are none or their weights sum to 0."""
    weights = weights or [1.0] * len(scores)
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def pair_fields(pairs: DataFrame, records: DataFrame, fields: dict[str, str], rid: str = "rid") -> DataFrame:
    """``pairs(i, j, ...)`` with the cleaned fields of both ends, ``a_<field>`` and ``b_<field>``."""
    left = records.select(F.col(rid).alias("i"), *(clean(c).alias(f"a_{c}") for c in fields))
    right = records.select(F.col(rid).alias("j"), *(clean(c).alias(f"b_{c}") for c in fields))
    return pairs.join(left, "i").join(right, "j")


def _value_pairs(wide: DataFrame, names: list[str]) -> DataFrame:
    """``(field, x, y)``: the distinct unordered value pairs of some fields, found in one pass over the pairs."""
    each = [F.struct(F.lit(c).alias("field"), *(f(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(n) for n, f in (("x", F.least), ("y", F.greatest)))) for c in names]
    known = [F.when(F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull(), s) for c, s in zip(names, each, strict=True)]
    return stash(wide.select(F.explode(F.array(*known)).alias("v")).where("v IS NOT NULL").select("v.*").distinct(), "value-pairs")


def _with_memoised(wide: DataFrame, values: DataFrame, c: str, method: str) -> DataFrame:
    """Adds ``s_<c>`` from the scores of distinct value pairs (these similarities are symmetric), which
    are broadcast when their counted rows are within ``VALUE_ROWS``."""
    scored = stash(values.where(F.col("field") == c).select(F.col("x").alias("__x"), F.col("y").alias("__y"), similarity(method, F.col("x"), F.col("y")).alias(f"s_{c}")), "value-scores")
    a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
    both = a.isNotNull() & b.isNotNull()
    on = (F.when(both, F.least(a, b)) == F.col("__x")) & (F.when(both, F.greatest(a, b)) == F.col("__y"))
    return wide.join(F.broadcast(scored) if scored.count() <= VALUE_ROWS else scored, on, "left").drop("__x", "__y")


def score_pairs(pairs: DataFrame, records: DataFrame, fields: dict[str, str], weights: dict[str, float] | None = None, rid: str = "rid") -> DataFrame:
    """``(i, j, s_<field>..., score)``; a field that either end lacks is left out of the mean."""
    wide = pair_fields(pairs.select("i", "j"), records, fields, rid)
    memoised = [c for c, method in fields.items() if method in MEMOISED]
    values = _value_pairs(wide, memoised) if memoised else None
    for c, method in fields.items():
        if values is not None and c in memoised:
            wide = _with_memoised(wide, values, c, method)
        else:
            wide = wide.withColumn(f"s_{c}", similarity(method, F.col(f"a_{c}"), F.col(f"b_{c}")))
    scores = [F.col(f"s_{c}") for c in fields]
    return wide.select("i", "j", *scores, combine(scores, [(weights or {}).get(c, 1.0) for c in fields]).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; 0 when either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
