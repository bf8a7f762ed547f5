"""Vectorised text helpers used inside Arrow tasks: words, rolling hashes, window seeds.

All functions work on the UTF-8 bytes of a slice of a column, never on prefixes of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_PRIME = (1 << 61) - 1     # byte ranges are hashed modulo this; modulo 2 ** 64 some long texts would collide for any base
_ROOT = 0x1C6EF372FE94F82B % _PRIME
_EXACT_BYTES = 1 << 23     # bytes whose sums stay below 2 ** 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {base: np.ones(1, np.uint64) for base in (_ROOT, pow(_ROOT, -1, _PRIME))}


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, below the prime plus 8."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(61))


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2 ** 31 modulo the prime, for x below 2 ** 61."""
    return ((x << np.uint64(31)) & np.uint64(_PRIME)) | (x >> np.uint64(30))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for both below 2 ** 61."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    cross = _reduced(a1 * b0 + a0 * b1)
    return _reduced(a1 * b1 * np.uint64(2) + _shifted(cross) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = _fold(x)
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime."""
    known = _powers[base]
    while len(known) < n:
        known = np.concatenate([known, _times(known, np.uint64(pow(base, len(known), _PRIME)))])
    _powers[base] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` bytes of a text column: first row, end row, bytes, row offsets.

    Null is an empty text. A text is never split, so a very long one is a slice of its own.
    """
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi
    del column, data
    pa.default_memory_pool().release_unused()   # what the copy took


def range_hash(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that hashes the byte ranges [start, end) of ``data``: polynomials modulo a prime, so that two different
    ranges of n bytes have equal hashes for n of 2 ** 61 bases at most."""
    power = powers(_ROOT, len(data))
    low = np.uint64((1 << 31) - 1)
    sums = []
    for part in (power >> np.uint64(31), power & low):
        out = np.zeros(len(data) + 1, np.uint64)
        for lo in range(0, len(data), _EXACT_BYTES):
            hi = min(lo + _EXACT_BYTES, len(data))
            np.cumsum(part[lo:hi] * (data[lo:hi].astype(np.uint64) + np.uint64(1)), out=out[lo + 1:hi + 1])
            if lo:
                out[lo + 1:hi + 1] = _fold(out[lo + 1:hi + 1] + _fold(out[lo]))
        sums.append(out)
    # beyond the first stretch the sums are folded and may fall; a multiple of the prime keeps differences positive
    more = np.uint64(2 * _PRIME if len(data) > _EXACT_BYTES else 0)

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, rest = (_reduced(_fold(s[end]) + more - _fold(s[start]) if more else s[end] - s[start]) for s in sums)
        value = _reduced(_shifted(high) + rest)
        return mixed(_times(value, powers(pow(_ROOT, -1, _PRIME), len(data) + 1)[start]))
    return hashed


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])))
    end = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    return start, end, np.searchsorted(start, offsets)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (k - 1 entries shorter than ``h``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size, step = None, 0, h, 1, int(_STEP)
    while True:
        if k & size:
            piece = part[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(step) + piece
            done += size
        size *= 2
        if size > k:
            return mixed(out)
        part, step = part[:-(size // 2)] * np.uint64(step) + part[size // 2:], step * step % 2**64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:])


def window_seeds(grams: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of windows that share their smallest gram: its hash, first window, number of windows.

    A window holds ``width`` grams (less than 128) and takes the leftmost smallest one, so equal
    windows have equal seeds at equal places. ``valid`` says which windows lie inside one text.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(grams), dtype=np.uint64)
    high = grams & ~np.uint64(255)
    # the low byte orders equal grams by place; one of the two countings does not wrap inside a window
    even = _sliding_min(high | (at & np.uint64(255)), width)
    odd = _sliding_min(high | ((at + np.uint64(128)) & np.uint64(255)), width)
    start = np.arange(n, dtype=np.int64)
    use_odd = (start & 255) >= 128
    place = np.where(use_odd, odd.astype(np.int64) - 128, even.astype(np.int64)) & 255
    place = start + ((place - start) & 255)
    key = np.where(use_odd, odd, even) >> np.uint64(8)
    ok = valid[:n]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(change)
    length = np.diff(np.append(first, n))
    keep = ok[first]
    return key[first][keep], first[keep], length[keep]


def inside(offsets: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which starts in 0 .. total - 1 have ``size`` entries left in their own row."""
    left = np.zeros(total, np.int64)
    counts = np.diff(offsets)
    left[:] = np.repeat(offsets[1:], counts)
    return left - np.arange(total) >= size


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Key, ``text_hash`` (tells rows apart that repeat a key) and ``text`` of every row."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
