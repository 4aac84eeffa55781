"""Vector best-fit packing of token sequences.

A document's tokens are its ids and a closing 0.  Only documents longer than a
sequence are cut, into full pieces and a rest.  A sequence has three capacities: its
tokens, a number of documents and an attention cost (the sum of squared lengths), so
a piece is a vector that follows from its length alone.  Pieces are placed longest
first.  Each goes to the sequence, among those with room for it in every capacity,
whose residual vector (as shares of the capacities) has the smallest weighted norm once
the piece is in; a new sequence opens only when none has room.

Pieces of one length are alike, and so are sequences filled alike, so the packing is
planned for whole lengths and runs of sequences at once: the plan follows from the
histogram of lengths, which the sequence length bounds, and has a run for each
placement, not a row for each piece.  Each piece then finds its place by its rank among
pieces of its length.  Ranks are taken inside the written parts of the pieces and moved
by the counts of earlier parts, so a length that a third of all pieces share is no hot
key.

By default tokens are what runs out; documents and attention cost weigh in the choice
between sequences (``WEIGHTS``).  A smaller ``documents`` or ``cost`` bounds them, too.

Edge cases: null and empty texts are the id 0 alone; equal rows are packed each by
itself; null ids are rows like others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlake.session import small_batches, stash, table, trimmed

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
CACHE = 100_000
WEIGHTS = (1.0, 0.2, 0.2)
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weights of the residual norm (tokens, documents, attention cost)."""

    tokens: int = LENGTH
    documents: int = LENGTH
    cost: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = WEIGHTS


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# The tokenizer's own split, for texts of Latin-1 letters, ASCII digits, signs and white space.
_PLAIN = re.compile(r"[A-Za-zß-öø-ÿÀ-ÖØ-Þ0-9!-/:-@\[-`{-~ \t\n\r\x0b\x0c]*\Z")
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r\x0b\x0c]+")
_MARK = "<|"  # of special tokens
_PROBE = "It's a DON'T'll x1234,.;- 12-3 (Ünïted) ßtraße\t \n'' 're " + "".join(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


class _Words(dict):
    """Ids of words as bytes, in two generations of a bounded number each: words still in use move on."""

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokens = tokenizer.model.tokenize
        signs = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes_as_signs = {k: signs(chr(k))[0][0] for k in range(0xC0, 0x100)}  # the model reads a letter's bytes as signs

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = self.tokens(word if word.isascii() else word.translate(self.bytes_as_signs))
            ids = pack_ids(f"<{len(found)}I", *[t.id for t in found])
        if len(self) >= CACHE:
            self.older = self.copy()
            self.clear()
        self[word] = ids
        return ids


class WordIds:
    """Ids of texts, by a bounded cache of the ids of their words.

    This tokenizer splits a text into words before anything else.  Plain texts are
    split here in the same way, and only words not seen lately go to the tokenizer's
    model, each by itself.  All other texts go through the tokenizer whole, as all texts
    do with a tokenizer that gives a probe other ids than its words have.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(self.tokenizer)
        self.by_words = self.of_words(_PROBE) == self.whole(_PROBE).tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> bytes:
        if not self.by_words or _MARK in text or not _PLAIN.match(text):
            return self.whole(text).tobytes()
        return self.of_words(text)

    def of_words(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _UNIT.findall(text.lower())))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, whatever its tasks."""
    return WordIds(path)


def tokenize(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = (ids_of(text.as_py()) if text.is_valid else b"") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(read), PIECE_SCHEMA)


Places = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> tuple[int, Places]:
    """The number of sequences, and for each length the runs that take its pieces by rank: first
    rank, first sequence, pieces in each sequence, offset of the first of them.

    Sequences filled alike stand in one row ``(first, how many, tokens, documents, cost left)``.
    A placement fills up a row or uses up a length, so rows grow by two at most for each
    length, whatever the number of pieces.
    """
    scale = np.array([capacity.tokens, capacity.documents, capacity.cost], dtype=float)
    weights = np.array(capacity.weights)
    first, many = np.zeros(64, np.int64), np.zeros(64, np.int64)
    left = np.zeros((64, 3), np.int64)
    rows = sequences = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def add(start: int, n: int, residual: np.ndarray) -> None:
        nonlocal first, many, left, rows
        if n:
            if rows == len(first):
                first, many, left = (np.concatenate([x, np.zeros_like(x)]) for x in (first, many, left))
            first[rows], many[rows], left[rows] = start, n, residual
            rows += 1

    for value in sorted(counts, reverse=True):
        todo, rank = counts[value], 0
        demand = np.array([value, 1, value * value], np.int64)
        runs[value] = []
        while todo:
            open_ = np.flatnonzero((left[:rows] >= demand).all(1) & (many[:rows] > 0))
            if len(open_):
                norm = ((((left[open_] - demand) / scale) ** 2) * weights).sum(1)
                k = int(open_[np.argmin(norm)])
                n, each, start, offset = min(todo, int(many[k])), 1, int(first[k]), int(capacity.tokens - left[k, 0])
                residual = left[k].copy()
                first[k] += n
                many[k] -= n
            else:  # new sequences, each filled while this length lasts; a piece too large for a bound is alone
                each = max(1, int((np.array([capacity.tokens, capacity.documents, capacity.cost]) // demand).min()))
                each = min(each, todo)
                n, start, offset = todo // each, sequences, 0
                residual = np.array([capacity.tokens, capacity.documents, capacity.cost], np.int64)
                sequences += n
            add(start, n, residual - each * demand)
            runs[value].append((rank, start, each, offset))
            rank += n * each
            todo -= n * each
        if rows > 64 and (many[:rows] == 0).sum() > rows // 2:
            keep = np.flatnonzero(many[:rows] > 0)
            first[: len(keep)], many[: len(keep)], left[: len(keep)], rows = first[keep], many[keep], left[keep], len(keep)
    return sequences, {v: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for v, r in runs.items() if r}


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (with ``length``) and their ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    parts = stash(pieces.withColumn("__part", F.spark_partition_id()), "pack-pieces")
    per_part = stash(parts.groupBy("length", "__part").agg(F.count("*").alias("__n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most one row per length
    places = spark.sparkContext.broadcast(plan(counts, capacity)[1])
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("__rank", F.row_number().over(local) - 1).join(offsets.hint("merge"), ["length", "__part"])
    ranked = ranked.select(*pieces.columns, (F.col("__before") + F.col("__rank")).alias("__rank"))
    names = [*pieces.columns, "sequence_id", "offset"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
            order = np.argsort(value, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(order) else []:
                v = int(value[rows[0]])
                low, base, each, start = places.value[v]
                at = np.searchsorted(low, rank[rows], side="right") - 1
                inside = rank[rows] - low[at]
                sequence[rows] = base[at] + inside // each[at]
                offset[rows] = start[at] + inside % each[at] * v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(trimmed(assign), ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, capacity: Capacity = Capacity()) -> DataFrame:
    return pack(tokenize(documents, path, capacity.tokens), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
