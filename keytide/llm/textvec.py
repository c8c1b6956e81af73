"""Whole columns of text as byte arrays: words are found and hashed without a Python object per word.

A word's 64-bit hash is a polynomial over random byte values, read off prefix sums and then mixed. A-Z count as a-z.
White space is [\\x20\\x09-\\x0D], as in the operators' contracts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once: bounds memory (about 40 bytes a byte of text) and stays in the cache. A longer text is a chunk alone.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hash(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, in order."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("pow", ())) < n:
        m = max(n, CHUNK)
        for key, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _cache[key] = np.cumprod(p, dtype=np.uint64)
    return _cache["pow"], _cache["inv"]


def _byte_values() -> np.ndarray:
    if "bytes" not in _cache:
        _cache["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[LOWER]
    return _cache["bytes"]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts of the rows in them and their end) for runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    big = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, for each row the number of its first word and, last, the number of all words)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    gap = white[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[off[off < n]] = True
    ends_at = off[1:][off[1:] > 0] - 1
    after[ends_at] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    pw, inv = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values()[data] * pw[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
