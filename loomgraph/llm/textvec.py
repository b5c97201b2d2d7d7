"""Vectorised text work on Arrow string columns: words, shingles, n-gram counts.

Everything here looks at the UTF-8 bytes of a whole batch at once. ASCII
letters are folded and ASCII white space split by table; other bytes pass
unchanged, so a multi-byte code point is never cut by a word boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes whose runs are counted at a time, of a text of any length.
GRAM_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What parts words where only digits, letters and characters beyond ASCII count.
WORD_GAPS = np.ones(256, bool)
WORD_GAPS[48:58] = WORD_GAPS[65:91] = WORD_GAPS[97:123] = WORD_GAPS[128:] = False
#: Code points, [from, to) and so on: scripts that are written without blanks, and punctuation beyond ASCII.
_UNSPACED = np.array([0x0E00, 0x0F00, 0x1000, 0x10A0, 0x1780, 0x1800, 0x3040, 0x3100, 0x3400, 0xA000, 0xF900, 0xFB00, 0x20000, 0x40000])
_MARKS = np.array([0x2010, 0x205F, 0x3000, 0x3040, 0xFF01, 0xFF10, 0xFF1A, 0xFF21, 0xFF3B, 0xFF41, 0xFF5B, 0xFF66])
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.RandomState(20240229).randint(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.ones(n, np.uint64)
            out[1:] = np.uint64(b)
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def _unspaced(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of scripts without blanks begin and end; inside is cleared at punctuation beyond ASCII."""
    lead = np.flatnonzero(raw >= 0xE0)
    head = raw[lead].astype(np.int64)
    one, two, three = (raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 63 for k in (1, 2, 3))
    wide = head >= 0xF0
    code = np.where(wide, (head & 7) << 18 | one << 12 | two << 6 | three, (head & 15) << 12 | one << 6 | two)
    marks = lead[np.searchsorted(_MARKS, code, "right") % 2 == 1]
    for k in range(3):
        inside[marks + k] = False
    own = np.searchsorted(_UNSPACED, code, "right") % 2 == 1
    return lead[own], lead[own] + np.where(wide[own], 4, 3)


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names of the words (runs without a byte of gaps, by default ASCII
    white space; A-Z folded), the first word of each row, and where each starts in data.
    pairs: in scripts that are written without blanks every two characters in a
    row are a word, or one that stands alone; punctuation beyond ASCII is a gap."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    inside = ~gaps[raw]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1] - lo] = True
    joined = np.zeros(0, np.int64)
    if pairs:
        own, after = _unspaced(raw, inside)
        joined = own[1:][(own[1:] == after[:-1]) & ~begins[own[1:]]]
        begins[own] = begins[after] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(joined):
        second = np.searchsorted(starts, joined)
        ends[second - 1] = ends[second]
        single = np.ones(len(starts), bool)
        single[second] = False  # the last of a run is in the pair before it
        single[second - 1] = True
        starts, ends = starts[single], ends[single]
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[:n], out=total[1:])
    names = mix((total[ends] - total[starts]) * down[starts])
    return names, np.searchsorted(starts, offsets - lo), starts + lo


def shingles(names: np.ndarray, rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the names of its runs of width words, in order and with
    repeats; a row of fewer words has its whole sequence as one."""
    if len(names) >= width:
        n = len(names) - width + 1
        runs = names[:n].copy()
        for k in range(1, width):
            runs = runs * _STEP[0] + names[k : k + n] * _STEP[k % 5]
        runs = mix(runs)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            yield runs[a : b - width + 1]
        elif b > a:
            h = np.uint64(b - a)
            for x in names[a:b]:
                h = np.uint64((int(h) * int(_STEP[1]) + int(x)) & _MASK)
            yield mix(np.array([h], np.uint64))
        else:
            yield names[:0]


def gram_counts(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int, fold: bool) -> np.ndarray:
    """Rows by buckets: how often each hashed run of bytes occurs in each row.
    Runs do not cross rows. fold: A-Z count as a-z and digits and white space as a blank."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros((rows, buckets), np.float32)
    if fold:
        raw = _LOWER[raw]
        raw = np.where(_SPACE[raw] | ((raw >= 48) & (raw < 58)), np.uint8(32), raw)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    out = np.zeros(rows * buckets, np.int64)
    for begin in range(0, len(raw), GRAM_BYTES):
        part = raw[begin : begin + GRAM_BYTES + max(sizes) - 1].astype(np.uint32)
        own = row[begin : begin + len(part)]
        for size in sizes:
            n = min(GRAM_BYTES, len(part) - size + 1)
            if n <= 0:
                continue
            h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(size):
                h = (h ^ part[k : k + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            at = own[:n].astype(np.int64) * buckets + (h & np.uint32(buckets - 1))
            if rows > 1:
                at = at[own[:n] == own[size - 1 : size - 1 + n]]
            out += np.bincount(at, minlength=rows * buckets)
    return out.reshape(rows, buckets).astype(np.float32)
