"""Columnar text primitives over Arrow buffers: word boundaries, word hashes, window hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is exactly the
pattern ``[^\\x20\\x09-\\x0D]+``.  Nothing here builds a Python object per word, so one core handles
tens of megabytes a second.  Hashes are 64-bit polynomials with an odd base over a random byte
table, mixed at the end; they are functions of the bytes alone, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken apart so many bytes at a time, or one text: what a worker's arrays grow with.
SLICE_BYTES = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


#: Odd 64-bit values, one for each byte.
BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte table under which A-Z hash like a-z.
BYTE_TABLE_LOWER = BYTE_TABLE[LOWER]
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to 2**20 of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            done = 1
            step = _U(base & _M64)
            while done < size:  # doubling: b^k..b^2k-1 = b^0..b^k-1 * b^k
                have[done : 2 * done] = have[:done] * step
                step = step * step
                done *= 2
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
    """A hash for each span of bytes; spans are in order and don't overlap; empty spans hash to one value."""
    out = np.zeros(len(start), np.uint64)
    length = end - start
    total = np.cumsum(length)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
            n = length[lo:hi]
            full = np.flatnonzero(n)
            if len(full):
                n = n[full]
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                inside = np.arange(int(n.sum())) - np.repeat(first, n)
                at = inside + np.repeat(start[lo:hi][full], n)
                values = table[buf[at]] * powers(_BASE, int(n.max()))[inside]
                out[lo + full] = np.add.reduceat(values, first)
            lo = hi
        return mix(out + length.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


@dataclass
class Words:
    """Words of rows lo..hi-1 of an Arrow string array; row is relative to lo."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, its first word; one more entry at the end
    row_bytes: np.ndarray  # byte offsets of rows in buf, one more entry at the end

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end, table)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows that ``offsets`` bound."""
    base = int(offsets[0])
    own = buf[base : int(offsets[-1])]
    rel = offsets - base
    solid = ~_SPACE[own]
    edge = np.empty(len(own) + 1, bool)
    edge[0] = len(own) > 0 and solid[0]
    edge[-1] = len(own) > 0 and solid[-1]
    edge[1:-1] = solid[1:] != solid[:-1]
    inner = rel[1:-1]  # a word ends where its row does
    inner = np.unique(inner[(inner > 0) & (inner < len(own))])
    split = inner[solid[inner] & solid[inner - 1]]
    marks = np.flatnonzero(edge)
    if len(split):
        marks = np.sort(np.concatenate((marks, split, split)))
    start, end = marks[0::2], marks[1::2]
    first = np.searchsorted(start, rel)
    first[-1] = len(start)
    row = np.repeat(np.arange(len(rel) - 1), np.diff(first))
    return Words(own, start, end, row, first, rel)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of at most ``most`` bytes (one row at least) with their words."""
    buf, offsets = raw(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, words(buf, offsets[lo : hi + 1])
        lo = hi


_INV = {b: pow(b, -1, 1 << 64) for b in (_WORD_BASE, _BASE)}


def windows(h: np.ndarray, width: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hashes of the windows of ``width`` consecutive entries of ``h`` (across rows too: mask those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(base, len(h)), out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * powers(_INV[base], n))


def inside(w: Words, width: int) -> np.ndarray:
    """Which of the windows of ``width`` words lie in one row."""
    n = len(w.row) - width + 1
    return w.row[: max(n, 0)] == w.row[width - 1 :] if n > 0 else np.zeros(0, bool)
