"""Exact n-gram Jaccard self-join through a token-group matrix.

Sets of five-word shingles link when ``intersection / union >= 3/4``.  Documents with
equal sets are one set from the start.

1. A scan counts shingles in a fixed table of counters, which orders tokens from rare
   to common.  Any order is right; this one keeps common passages out of prefixes.
2. In that order two linked sets share a token among the first quarter of each (prefix
   filter).  Prefixes are exchanged packed into buckets; each bucket gives the lists of
   sets that share a token, equal lists once.
3. Sets that share lists are partitioned into groups (by the smallest set that leads
   one of their lists), large groups into chunks that meet two by two.  Sets whose
   bitmaps of hashed tokens bound all overlaps there below the threshold drop out.  For
   the rest every link is found from one token matrix, and a spanning forest is kept.
4. What is left are lists that hold several components and leads.  Query sets meet the
   other components' rows of the matrix: a bitmap of the token union bounds the overlap
   that any member can have, and only where the bound reaches the threshold are the
   members opened.  Members whose own bound reaches it are compared.
5. Links are joined into components.

No pairs of copies or of a group are made, nothing that grows with the corpus is
collected, and a task holds about twice ``BLOCK_TOKENS`` tokens, or two sets, at once.

Edge cases: a null, empty or blank text has an empty set, links with nothing and is its
own component; a text of fewer than five words is one shingle; equal rows share their
component; null ids never name a component (it is null when all its ids are); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.llm.shingles import mix, set_digests, set_ids, shingle_sets
from kinlake.operators.components import connected_components
from kinlake.session import BROADCAST_ROWS, drop_matching, small_batches, stash, table, trimmed

SKETCH_BITS = 20
SLICES = 16
FILTER_BITS = (16, 27)
SEEN = 200_000
SPLIT = 1024
ROOT_SALTS = 16
PIECE_BYTES = 1 << 19
BUCKET_POSTINGS = 1_000_000
FLUSH_POSTINGS = 500_000
BLOCK_TOKENS = 100_000
CHUNK = 256
MATRIX_COLUMNS = 1024


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes, so that working arrays stay small."""
    if not len(column):
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float))
    part = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(column)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of ``n`` has with any set it links to."""
    return -(-3 * n // 4)


def bitmap(tokens: np.ndarray) -> bytes:
    """Hashed positions of a set's tokens, in 4 to 8 bits for each; lengths are powers of two, so that maps can be folded."""
    if not len(tokens):
        return b""
    size = max(64, 4 << int(len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[((tokens >> np.uint64(13)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, length), axis=0) if len(bits) > length else bits


def overlap_bound(n: int, query: np.ndarray, other: np.ndarray) -> int:
    """At least the overlap of a set of ``n`` tokens with any set within ``other``, from their bitmaps."""
    length = min(len(query), len(other))
    query = _folded(query, length)
    return n - int(np.bitwise_count(query).sum()) + int(np.bitwise_count(query & _folded(other, length)).sum())


SCAN_SCHEMA = "doc_id long, text_a long, text_b long, n long, set_id long, other long, bitmap binary, slice int, counts binary"


def scan(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_a, text_b, n, set_id, other, bitmap)`` for each document - 128 bits of its text, and two
    digests of its set - and counter slices ``(slice, counts)``."""
    schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in SCAN_SCHEMA.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                h, at = shingle_sets(batch.column("text").slice(lo, hi - lo))
                counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_a", "text_b")]
                maps = pa.array([bitmap(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), *map(pa.array, set_digests(h, at)), maps, *(pa.nulls(hi - lo, f.type) for f in list(schema)[-2:])], schema=schema)
        if counts.any():
            blobs = [zlib.compress(part.tobytes(), 1) for part in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, f.type) for f in list(schema)[:-2]), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    named = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"))
    return named.mapInArrow(trimmed(read), SCAN_SCHEMA)


def clashing(docs: DataFrame) -> list[int]:
    """First digests that different sets share, told apart by the second: some ``n**2 / 2**65`` of ``n`` sets."""
    both = docs.where("n > 0").groupBy("set_id").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    return sorted(r["set_id"] for r in both.where("low != high").select("set_id").collect())


def counters(scanned: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up on the executors; ``2**SKETCH_BITS`` numbers whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
                total[k] = total[k] + got if k in total else got
        if total:
            yield pa.RecordBatch.from_pylist([{"slice": k, "counts": zlib.compress(v.tobytes(), 1)} for k, v in total.items()], pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    parts = scanned.where("slice IS NOT NULL").select("slice", "counts", (F.spark_partition_id() % 8).alias("salt"))
    for keys in (["slice", "salt"], ["slice"]):
        parts = parts.repartition(*keys).mapInArrow(trimmed(add), "slice int, counts binary").withColumn("salt", F.lit(0))
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    step = len(out) // SLICES
    for row in parts.select("slice", "counts").collect():
        out[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return out


def _ordered(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens as numbers that sort from rare to common."""
    seen = np.minimum(counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)
    return (seen << np.uint64(44)) | (h & np.uint64((1 << 44) - 1))


def prefix_postings(documents: DataFrame, counts, buckets: int, clashes: np.ndarray) -> DataFrame:
    """Prefix tokens of every set, packed: one row for each bucket and some texts."""
    schema = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("place", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary())])

    def flush(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        ids, sizes = (np.array(x, dtype=np.int64) for x in list(zip(*held, strict=True))[1:])
        m, row = mix(np.concatenate([k for k, _, _ in held])), np.repeat(np.arange(len(held)), [len(k) for k, _, _ in held])
        bucket, token = (m % np.uint64(buckets)).astype(np.int32), (m >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, token, row = bucket[order], token[order], row[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            own, place = np.unique(row[a:b], return_inverse=True)
            rows.append((int(bucket[a]), token[a:b].tobytes(), place.astype(np.uint32).tobytes(), ids[own].tobytes(), sizes[own].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of, held, size, seen = counts.value, [], 0, set()
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                h, at = shingle_sets(batch.column("text").slice(lo, hi - lo))
                ids, keys = set_ids(h, at, clashes), _ordered(h, table_of)
                n = np.diff(at)
                if len(seen) > SEEN:  # what comes again is dropped where it meets
                    seen.clear()
                take = n - needed(n) + 1
                for k in np.flatnonzero(n):
                    if (i := int(ids[k])) in seen:
                        continue
                    seen.add(i)
                    part = keys[at[k] : at[k + 1]]
                    part = np.partition(part, take[k] - 1)[: take[k]] if take[k] < len(part) else part
                    held.append((part, i, int(n[k])))
                    size += len(part)
                if size >= FLUSH_POSTINGS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return documents.select("text").mapInArrow(trimmed(read), "bucket int, token binary, place binary, sets binary, sizes binary")


def shared_lists(postings: DataFrame) -> DataFrame:
    """``(list_id, salt, salts, set_id, lead)``: sets that share a prefix token; equal lists once.

    A list of more than ``SPLIT`` sets is dealt over ``salts`` keys, so no join or sum by list sees it whole.
    """
    schema = pa.schema([("list_id", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("set_id", pa.int64()), ("lead", pa.int64())])

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["token"]])
        sets, n = (np.concatenate([np.frombuffer(s.as_buffer(), t)[np.frombuffer(p.as_buffer(), np.uint32)] for p, s in zip(rows["place"], rows[c], strict=True)]) for c, t in (("sets", np.int64), ("sizes", np.uint32)))
        n = n.astype(np.int64)
        order = np.lexsort((sets, n, token))
        token, sets, n = token[order], sets[order], n[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])
        token, sets, n = token[new], sets[new], n[new]
        # a list ends with its token, and where the next set is too large for any before it
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (4 * n[:-1] < 3 * n[1:])])
        size = np.diff(np.r_[start, len(token)])
        with np.errstate(over="ignore"):
            total = np.zeros(len(sets) + 1, dtype=np.uint64)
            np.cumsum(mix(sets.view(np.uint64)), out=total[1:])
            name = mix(total[start + size] - total[start] + size.astype(np.uint64)).view(np.int64)
        start, size, name = start[size > 1], size[size > 1], name[size > 1]
        name, first = np.unique(name, return_index=True)
        start, size = start[first], size[first]
        at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        members = sets[at]
        lead = np.minimum.reduceat(members, np.r_[0, np.cumsum(size)[:-1]]) if len(size) else members
        salts = np.repeat(-(-size // SPLIT), size)
        salt = (mix(members.view(np.uint64) ^ np.uint64(SPLIT)) % np.maximum(salts, 1).astype(np.uint64)).astype(np.int32)
        return pa.table([np.repeat(name, size), salt, salts.astype(np.int32), members, np.repeat(lead, size)], schema=schema)

    found = postings.groupBy("bucket").applyInArrow(gather, "list_id long, salt int, salts int, set_id long, lead long")
    return found.groupBy("list_id", "salt", "salts", "set_id").agg(F.min("lead").alias("lead"))


def _place(set_id, doc_id, size: int):
    """Where a document of a set stands in a bit set; the same for columns and for arrays."""
    return (set_id ^ (doc_id << 7) ^ doc_id) & (size - 1)


def _owner_filter(owners: DataFrame) -> np.ndarray:
    """A bit set of ``owners(set_id, doc_id)``, made on the executors; it may let others through.  Its size
    follows their number, up to ``2**FILTER_BITS[1]`` bits."""
    size = 1 << min(max((16 * owners.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.expr(f"(set_id ^ shiftleft(doc_id, 7) ^ doc_id) & {size - 1}L")
    words = owners.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    out = np.zeros(size >> 6, dtype=np.int64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def tokens_of(documents: DataFrame, wanted: DataFrame, sets: DataFrame, clashes: np.ndarray) -> DataFrame:
    """``wanted(set_id, ...)`` with the sets' ``tokens``; ``sets(set_id, first)`` names a document of each set.

    Only that document's row gives the tokens, so copies aren't moved: a bit set of
    bounded size tells which rows may be meant, and the rest is a join.
    """
    owners = wanted.select("set_id").distinct().join(sets.select("set_id", F.coalesce("first", F.lit(0)).alias("doc_id")), "set_id")
    shared = documents.sparkSession.sparkContext.broadcast(_owner_filter(stash(owners, "jaccard-owners")))
    schema = pa.schema([("set_id", pa.int64()), ("tokens", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            docs = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
            for lo, hi in pieces(batch.column("text")):
                h, at = shingle_sets(batch.column("text").slice(lo, hi - lo))
                ids = set_ids(h, at, clashes)
                p = _place(ids, docs[lo:hi], len(shared.value) << 6)
                want = ((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)) > 0
                rows = []
                if len(seen) > SEEN:
                    seen.clear()
                for k in np.flatnonzero(want & (np.diff(at) > 0)):
                    if (i := int(ids[k])) not in seen:
                        seen.add(i)
                        rows.append((i, h[at[k] : at[k + 1]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(read), "set_id long, tokens binary")
    return found.groupBy("set_id").agg(F.first("tokens").alias("tokens")).join(wanted, "set_id")


def _overlaps(query: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many tokens of each of the sets laid end to end are in the sorted ``query``."""
    place = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    return np.add.reduceat((query[place] == tokens).astype(np.int64), at[:-1])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], value: str, kind: type) -> Iterator[tuple[tuple, dict[int, tuple[int, np.ndarray]]]]:
    """Consecutive rows with equal keys of a sorted stream: the keys, and by set its chunk and an array."""
    now: tuple | None = None
    sets: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        for row, i, chunk, blob in zip(zip(*columns, strict=True), batch.column("set_id").to_pylist(), batch.column("chunk").to_pylist(), batch.column(value), strict=True):
            if row != now:
                if now is not None:
                    yield now, sets
                now, sets = row, {}
            sets[i] = (chunk, np.frombuffer(blob.as_buffer(), kind))
    if now is not None:
        yield now, sets


def _shared_tokens(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right (with ``None``: with each other)."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(a) for a in both])
    _, token, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    often = seen > 1
    number = np.cumsum(often) - 1
    keep = often[token]
    owner, token = owner[keep], number[token[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    m = len(left)
    out = np.zeros((m, len(right) if right else m), dtype=np.float32)
    for low in range(0, int(often.sum()), MATRIX_COLUMNS):
        a, b = np.searchsorted(token, [low, low + MATRIX_COLUMNS])
        dense = np.zeros((len(both), MATRIX_COLUMNS), dtype=np.float32)
        dense[owner[a:b], token[a:b] - low] = 1
        out += dense[:m] @ (dense[m:] if right else dense).T
    return out.astype(np.int64)


def _components(linked: np.ndarray) -> np.ndarray:
    """The first member of each node's component, from a symmetric matrix."""
    comp = np.full(len(linked), -1)
    for first in range(len(linked)):
        if comp[first] < 0:
            front = np.array([first])
            while len(front):
                comp[front] = first
                front = np.flatnonzero(linked[front].any(0) & (comp < 0))
    return comp


def _may_link(sizes: np.ndarray, chunk: np.ndarray, maps: list[np.ndarray], apart: bool) -> np.ndarray:
    """Which sets have another (of the other chunk, when ``apart``) whose bound reaches the threshold."""
    out = np.zeros(len(maps), dtype=bool)
    lengths = np.array([len(m) for m in maps])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        rows = np.stack([maps[k] for k in at])
        for i in np.flatnonzero((lengths == length) | (lengths == 2 * length)):
            bound = _bounds(int(sizes[i]), maps[i], rows)
            hit = (7 * bound >= 3 * (sizes[i] + sizes[at])) & (4 * np.minimum(sizes[i], sizes[at]) >= 3 * np.maximum(sizes[i], sizes[at])) & (at != i)
            if apart:
                hit &= chunk[at] != chunk[i]
            if hit.any():
                out[i] = True
                out[at[hit]] = True
    return out


def worth_opening(members: DataFrame) -> DataFrame:
    """``(set_id, a, b)`` of the sets of ``(set_id, a, b, n, bitmap)`` that may link inside their block."""
    schema = pa.schema([("set_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            keep = []
            if len(held) > 1:
                ids, n, maps = {}, [], []
                for i, size, b, bits in held:
                    if i not in ids:
                        ids[i] = (len(n), b)
                        n.append(size)
                        maps.append(bits)
                chunk = np.array([b & 0xFFFFF for _, b in ids.values()])
                may = _may_link(np.array(n), chunk, maps, now[1] >> 20 != now[1] & 0xFFFFF)
                keep = [(i, now[0], b) for i, (k, b) in ids.items() if may[k]]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in keep], pa.int64()) for k in range(3)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "tile", "set_id", "n", "b")]
            for a, tile, i, n, b, bits in zip(*columns, batch.column("bitmap"), strict=True):
                if (a, tile) != now:
                    yield found()
                    now, held = (a, tile), []
                held.append((i, n, b, np.frombuffer(bits.as_buffer(), np.uint8)))
        yield found()

    tiled = members.withColumn("tile", F.shiftright("b", 20))
    return tiled.repartition("a", "tile").sortWithinPartitions("a", "tile").mapInArrow(trimmed(look), "set_id long, a long, b long")


def block_links(members: DataFrame) -> DataFrame:
    """A spanning forest ``(src, dst)`` of the links inside blocks of ``(a, b, set_id, tokens)``.

    ``a`` is a group's lead; ``b`` holds two chunks of it, that meet here, and the set's own.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), sets in _groups(batches, ["a", "tile"], "tokens", np.uint64):
            p, q = block >> 20, block & 0xFFFFF
            ids = sorted(sets, key=lambda i: (sets[i][0], i))
            arrays, chunk = [sets[i][1] for i in ids], [sets[i][0] for i in ids]
            n = np.array([len(x) for x in arrays])
            m = sum(c == p for c in chunk)
            if len(ids) < 2 or (p < q and (m == 0 or m == len(ids))):
                continue
            linked = np.zeros((len(ids), len(ids)), dtype=bool)
            if p == q:
                shared = _shared_tokens(arrays, None)
                linked = 100 * shared >= 75 * (n[:, None] + n[None, :] - shared)
            else:
                shared = _shared_tokens(arrays[:m], arrays[m:])
                linked[:m, m:] = 100 * shared >= 75 * (n[:m, None] + n[None, m:] - shared)
                linked[m:, :m] = linked[:m, m:].T
            found = [(ids[k], ids[c]) for k, c in enumerate(_components(linked).tolist()) if c != k]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    tiled = members.withColumns({"tile": F.shiftright("b", 20), "chunk": F.col("b").bitwiseAND(F.lit((1 << 20) - 1))})
    return tiled.repartition("a", "tile").sortWithinPartitions("a", "tile").select("a", "tile", "chunk", "set_id", "tokens").mapInArrow(trimmed(solve), "src long, dst long")


def _bounds(n: int, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """:func:`overlap_bound` of a query against bitmaps of one length, at most as long as its own."""
    query = _folded(query, rows.shape[1])
    return n - int(np.bitwise_count(query).sum()) + np.bitwise_count(rows & query).sum(1, dtype=np.int64)


def open_groups(tile: list[tuple[int, int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Pairs of sets of a tile, of different groups, whose overlap may reach the threshold.

    A tile has ``(set_id, comp, lead, n, bitmap)``.  Its rows of the token-group matrix are
    the token unions of groups (sets of one component and lead): a query is held against
    those, and the members of a group are opened only where the bound lets one of them
    link.  Sets of one lead have met before.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, comp, lead, _, _) in enumerate(tile):
        groups.setdefault((lead, comp), []).append(k)
    if len({lead for lead, _ in groups}) < 2:
        return []
    by_length: dict[int, tuple[list[tuple[int, int]], list[np.ndarray]]] = {}
    for name, members in groups.items():
        length = min(len(tile[k][4]) for k in members)
        names, rows = by_length.setdefault(length, ([], []))
        names.append(name)
        rows.append(np.bitwise_or.reduce([_folded(tile[k][4], length) for k in members], axis=0))
    matrix = [(length, np.array(names), np.stack(rows)) for length, (names, rows) in by_length.items()]
    out = []
    for i, comp, lead, n, bits in tile:
        for length, names, rows in matrix:
            others = np.flatnonzero((names[:, 0] > lead) & (names[:, 1] != comp))
            if length > 2 * len(bits) or not len(others):
                continue  # all its sets are too large, or have met this one
            rows = rows[others]
            bound = _bounds(n, bits, rows) if length <= len(bits) else np.array([overlap_bound(n, bits, r) for r in rows])
            for k in (k for name in names[others[bound >= needed(n)]] for k in groups[int(name[0]), int(name[1])]):
                j, _, their_lead, m, theirs = tile[k]
                if i != their_lead and j != lead and 4 * min(n, m) >= 3 * max(n, m) and 7 * overlap_bound(n, bits, theirs) >= 3 * (n + m):
                    out.append((i, j))
    return out


def open_lists(rows: DataFrame) -> DataFrame:
    """``(src, dst)`` worth comparing, from ``(list_id, size, set_id, comp, lead, n, bitmap)``; lists above
    ``CHUNK`` sets are met chunk by chunk."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    placed = rows.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64("set_id"), "chunks").cast("int"))
    tiles = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list_id", F.least("c", "x").alias("p"), F.greatest("c", "x").alias("q"), "set_id", "comp", "lead", "n", "bitmap")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, seen = None, [], set()

        def found() -> pa.RecordBatch:
            new = [pair for pair in open_groups(tile) if pair not in seen]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("list_id", "p", "q", "set_id", "comp", "lead", "n")]
            for *key, i, comp, lead, n, bits in zip(*columns, batch.column("bitmap"), strict=True):
                if key != now:
                    yield found()
                    now, tile = key, []
                tile.append((i, comp, lead, n, np.frombuffer(bits.as_buffer(), np.uint8)))
        yield found()

    keys = ["list_id", "p", "q"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(look), "src long, dst long").distinct()


def verified(pairs: DataFrame) -> DataFrame:
    """The linked ones of ``(src, dst, tokens_a, tokens_b)``."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = int(_overlaps(x, y, np.array([0, len(y)]))[0])
                keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(pa.array(keep, pa.bool_())), batch.column("dst").filter(pa.array(keep, pa.bool_()))], schema=schema)

    return pairs.mapInArrow(trimmed(check), "src long, dst long")


def _joined(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_a, text_b, n, set_id)`` of every row, and the root of every set that isn't empty: ``(set_id, root)``."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    scanned = stash(scan(documents), "jaccard-scan")
    docs = scanned.where("slice IS NULL").select("doc_id", "text_a", "text_b", "n", "set_id", "other", "bitmap")
    total = scanned.agg(F.sum("n").alias("n")).first()["n"] or 0
    clashes = clashing(docs)
    if clashes:
        docs = docs.withColumn("set_id", F.when(F.col("set_id").isin(clashes) & (F.col("n") > 0), F.col("other")).otherwise(F.col("set_id")))
    docs, clashes = docs.drop("other"), np.array(clashes, np.int64)
    counts = sc.broadcast(counters(scanned))
    buckets = max(64, -(-total // (4 * BUCKET_POSTINGS)))
    lists = stash(shared_lists(prefix_postings(documents, counts, buckets, clashes)), "jaccard-lists")

    # groups: each set goes to the smallest lead among its lists; blocks of a group all hold the lead
    sets = stash(docs.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min("doc_id").alias("first")), "jaccard-sets")
    lead = stash(lists.groupBy("set_id").agg(F.min("lead").alias("lead")).join(sets.drop("first"), "set_id"), "jaccard-leads")
    members = lead.select("set_id", "lead").unionByName(lead.select(F.col("lead").alias("set_id"), "lead")).distinct()
    wide = F.when(F.ceil(F.sum("n") / BLOCK_TOKENS) < 1 << 20, F.ceil(F.sum("n") / BLOCK_TOKENS)).otherwise(F.raise_error(F.lit("a group of the n-gram Jaccard join has too many chunks: raise BLOCK_TOKENS")))
    chunks = lead.groupBy("lead").agg(wide.cast("long").alias("chunks"))
    placed = members.join(chunks, "lead").withColumn("c", F.pmod(F.xxhash64("set_id"), "chunks")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    both = F.shiftleft(F.least("c", "x"), 40).bitwiseOR(F.shiftleft(F.greatest("c", "x"), 20)).bitwiseOR(F.col("c"))
    placed = placed.select("set_id", F.col("lead").alias("a"), both.alias("b")).join(lead.select("set_id", "n", "bitmap"), "set_id")
    inside = stash(block_links(tokens_of(documents, stash(worth_opening(placed), "jaccard-placed"), sets, clashes)), "jaccard-inside")
    near = connected_components(inside)
    solved = stash(lead.join(near, F.col("set_id") == F.col("node"), "left").select("set_id", "lead", F.coalesce("component", "set_id").alias("comp")), "jaccard-solved")

    # lists that still hold several components, of sets that haven't met
    rows = stash(lists.select("list_id", "salt", "salts", "set_id").join(solved, "set_id"), "jaccard-listed")
    ends = [(n, f, c) for n, f, c in (("a", F.min, "comp"), ("b", F.max, "comp"), ("c", F.min, "lead"), ("d", F.max, "lead"))]
    parts = rows.groupBy("list_id", "salt").agg(*(f(c).alias(n) for n, f, c in ends), F.max("salts").alias("salts"), F.count("*").alias("size"))
    several = parts.groupBy("list_id").agg(*(f(n).alias(n) for n, f, _ in ends), F.max("salts").alias("salts"), F.sum("size").alias("size")).where("a != b AND c != d")
    several = several.select("list_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "size")
    rows = stash(rows.drop("salts").join(several, ["list_id", "salt"]), "jaccard-rows")
    pairs = stash(open_lists(rows.join(lead.select("set_id", "n", "bitmap"), "set_id")), "jaccard-pairs")

    # those that pass the bound are compared
    ends = stash(pairs.select(F.explode(F.array("src", "dst")).alias("set_id")).distinct(), "jaccard-ends")
    tokens = stash(tokens_of(documents, ends, sets, clashes), "jaccard-tokens")
    links = verified(
        pairs.join(tokens.select(F.col("set_id").alias("src"), F.col("tokens").alias("tokens_a")), "src").join(tokens.select(F.col("set_id").alias("dst"), F.col("tokens").alias("tokens_b")), "dst")
    )

    joined = solved.where("set_id != comp").select(F.col("set_id").alias("src"), F.col("comp").alias("dst")).unionByName(inside).unionByName(links)
    roots = connected_components(joined)
    rooted = sets.select("set_id").join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "set_id").alias("root"))
    return docs.drop("bitmap"), stash(rooted, "jaccard-roots")


def _least_of_component(least: DataFrame) -> DataFrame:
    """``(__set, least)``: the least ``own`` in the component of each set of ``(set_id, own, root)``; a component's
    sets are dealt over ``ROOT_SALTS`` keys."""
    several = least.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1")
    several = several.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))).alias("salt"))
    salted = least.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(ROOT_SALTS)).cast("int"))
    return salted.join(several, ["root", "salt"], "left").select(F.col("set_id").alias("__set"), F.when(F.col("least").isNull(), F.col("own")).otherwise(F.col("least")).alias("least"))


def ngram_jaccard_components(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``documents(doc_id, text)``."""
    docs, roots = _joined(documents)
    least = docs.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("own")).join(roots, "set_id")
    return docs.join(_least_of_component(least), (F.col("set_id") == F.col("__set")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (rows without one come
    last) and, of different texts with that id, of the smallest hash.

    Rows count by themselves: texts of different components that share an id all stay.
    Rows with an empty set are kept.  Of rows equal in id and text one is kept, that of
    the smallest hash of its columns.
    """
    docs, roots = _joined(documents)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    full = docs.where("n > 0")
    least = full.groupBy("set_id").agg(F.min(own).alias("own")).join(roots, "set_id")
    of_set = _least_of_component(least).withColumnRenamed("least", "lead")
    key = ["doc_id", "text_a", "text_b"]
    renamed = [F.col(c).alias(f"__{c}") for c in key]
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_a")) & (F.xxhash64(F.lit(1), "text") == F.col("__text_b"))
    others = full.withColumn("own", own).join(of_set, F.col("set_id") == F.col("__set")).where(~F.col("own").eqNullSafe(F.col("lead")))
    kept = drop_matching(documents, others.select(*renamed).distinct(), same)
    again = stash(full.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*renamed), "jaccard-again")
    n = again.count()
    if not n:
        return kept
    names = kept.columns
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, t in kept.dtypes if "map<" not in t and "variant" not in t))
    several = kept.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, same, "left_semi")
    one = several.groupBy("doc_id", *[F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(1), "text").alias("__b")]).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), hashed).alias("__one"))
    return drop_matching(kept, again, same).unionByName(one.select("__one.*"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against each other."""
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d JOIN c ON d.doc_id = c.a LEFT JOIN n ON d.doc_id = n.doc_id
"""
