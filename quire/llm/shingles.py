"""Word and shingle hashes of many texts at once, for use inside tasks.

Texts come as one byte buffer with bounds, as Arrow holds them. Words are runs
other than ``[\\x20\\x09-\\x0D]``, A-Z in lower case. A word's hash is a
polynomial over random byte values modulo 2**64, taken from running sums, so no
Python code runs for a single word. Hashes have 64 bits: two given different
shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]] if data is not None \
        else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = 1 << 18):
    """Ranges of rows of at most ``most`` bytes together; a longer row alone.

    A slice's arrays take up to 40 times its bytes."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, bounds: np.ndarray, most: int = 4 << 20):
    """(hash, row, start, end) of every word, in order; start and end in bytes.

    A row longer than ``most`` bytes is worked through in pieces that end at
    white space, so the tables stay small.
    """
    n = len(data)
    if n > most:
        parts, at = [], 0
        while at < n:
            end = min(n, at + most)
            if end < n:
                spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:
                    later = np.flatnonzero(_IS_SPACE[data[end:]])
                    end = end + int(later[0]) + 1 if len(later) else n
            inner = np.clip(bounds, at, end) - at
            h, row, s, e = _words(data[at:end], inner)
            parts.append((h, row, s + at, e + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _words(data, bounds)


def _words(data, bounds):
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    word = ~_IS_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    up, down = _power_tables(n)
    run = np.empty(n + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=run[1:])
    h = mix((run[ends] - run[starts]) * down[starts])
    row = np.searchsorted(bounds, starts, "right") - 1
    return h, row, starts, ends


def shingle_hashes(h: np.ndarray, row: np.ndarray, rows: int, k: int = 5):
    """(hash, row, first word) of every ``k``-word shingle, in order.

    A row with 1 to ``k``-1 words has one shingle, its whole sequence.
    """
    n = len(h)
    if n >= k:
        s = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            s += h[i:n - k + 1 + i] * _PLACE[i]
        ok = row[:n - k + 1] == row[k - 1:]
        s, at = mix(s[ok]), np.flatnonzero(ok)
        own = row[:n - k + 1][ok]
    else:
        s, at, own = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += h[begin[has] + i] * _PLACE[i]
        extra = mix(extra + counts[short].astype(np.uint64) * _PLACE[k])
        s, own, at = (np.concatenate(x) for x in ((s, extra), (own, short), (at, begin)))
        order = np.argsort(own, kind="stable")
        s, own, at = s[order], own[order], at[order]
    return s, own, at


def distinct(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ordered by row and hash."""
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], row[new]


def set_keys(s: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 128-bit key as two int64 columns) of each row's set of hashes."""
    size = np.bincount(row, minlength=rows)
    a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(s):
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        own = row[begin]
        a[own] = mix(np.add.reduceat(mix(s ^ _PLACE[20]), begin))
        b[own] = mix(np.add.reduceat(mix(s ^ _PLACE[21]), begin) ^ _PLACE[22])
    return size, np.stack([a, b], axis=1).view(np.int64)
