"""Vectorised words and word shingles of Arrow text columns.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r; A-Z is lower-cased. Both
rules touch ASCII only, so they hold on UTF-8 bytes as on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, CHUNK_BYTES * 2), base, U64)
        factors[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(factors)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, row offsets) of runs of rows of about `limit` bytes; null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_bounds(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR):
    """Starts and ends of the words, and the first word of each row (one more at the end)."""
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True, base: int = BASE, inverse: int = BASE_INVERSE) -> np.ndarray:
    low = (LOWER[raw] if lower else raw).astype(U64) + U64(1)
    low *= _powers(base, len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(low, out=total[1:])
    return mix((total[e] - total[s]) * _powers(inverse, len(raw) + 1)[s] + (e - s).astype(U64))


def shingle_sets(column: pa.Array, width: int):
    """For each row its sorted distinct hashes of `width`-word shingles.

    A text of fewer words is one shingle, its whole word sequence; one without words has none.
    """
    factors = [U64(pow(BASE, 2 * k + 3, 1 << 64)) for k in range(width)]
    for _, raw, offs in text_chunks(column):
        s, e, first = word_bounds(raw, offs)
        if not len(s):
            for _ in range(len(offs) - 1):
                yield np.zeros(0, U64)
            continue
        w = word_hashes(raw, s, e)
        m = max(0, len(w) - width + 1)
        full = np.zeros(m, U64)
        for k, f in enumerate(factors):
            full += w[k : k + m] * f
        full = mix(full)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                acc = U64(b - a)
                with np.errstate(over="ignore"):
                    for k in range(b - a):
                        acc = acc + w[a + k] * factors[k]
                yield mix(np.array([acc ^ U64(0xA5A5A5A5)], U64))
            else:
                yield np.zeros(0, U64)
