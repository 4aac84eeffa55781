"""Vectorised word shingles over Arrow string batches.

Words are runs of bytes outside ASCII white space, lower-cased on A-Z only, so
everything works on UTF-8 bytes without decoding.  A word's hash is a wrapping
polynomial over mixed byte values; a shingle's hash mixes the hashes of its
words with their places.  All hashes are 64 bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[_FOLD]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets into them; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each text the place of its first word (n + 1 places)."""
    space = _SPACE[raw]
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= space[1:]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(start):  # pieces that the tables of powers cover; a longer word is folded by itself
            base = start[lo]
            hi = max(lo + 1, int(np.searchsorted(end, base + _CHUNK, side="right")))
            if end[hi - 1] - base > _CHUNK:
                h = np.uint64(0)
                for k in range(base, end[lo], _CHUNK):
                    part = _BYTES[raw[k : min(k + _CHUNK, end[lo])]]
                    h = mix(np.array([h + (part * _POW[: len(part)]).sum(dtype=np.uint64)], dtype=np.uint64))[0]
                hashes[lo] = h
            else:
                part = _BYTES[raw[base : end[hi - 1]]]
                total = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part * _POW[: len(part)], out=total[1:])
                a, b = start[lo:hi] - base, end[lo:hi] - base
                hashes[lo:hi] = (total[b] - total[a]) * _INV[a]
            lo = hi
        hashes = mix(hashes + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return hashes, np.searchsorted(start, at)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text, in order, with repeats; a text of fewer words is one shingle, one without words none."""
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=at[1:])
    head = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    have = np.repeat(np.minimum(n_words, width), n)
    h = np.zeros(at[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            step = mix(np.array([k + 1], dtype=np.uint64))[0] | np.uint64(1)
            if len(words):
                part = words[np.minimum(head + k, len(words) - 1)] * step
                h += part if (have > k).all() else np.where(have > k, part, 0)
        h = mix(h ^ (have.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
    return h, at


def shingle_sets(column: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, ascending within a text, and n + 1 offsets."""
    raw, at = text_buffer(column)
    words, first = word_hashes(raw, at)
    h, begin = shingle_hashes(words, first, width)
    if not len(h):
        return h, begin
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    sizes = np.bincount(text[keep], minlength=len(begin) - 1)
    out = np.zeros(len(begin), dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return h[keep], out


def set_digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit digests of each set: equal sets get equal digests; an empty one gets 0."""
    n = np.diff(at)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
            total = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
            digest = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
            digest[n == 0] = 0
            out.append(digest.view(np.int64))
    return out[0], out[1]


def set_ids(hashes: np.ndarray, at: np.ndarray, clashes: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:
    """A number for each set: its first digest or, where different sets share that (``clashes``, ascending), the second."""
    first, second = set_digests(hashes, at)
    return np.where(np.isin(first, clashes), second, first) if len(clashes) else first
