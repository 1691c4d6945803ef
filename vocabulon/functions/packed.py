"""Stretches of numbers as bytes in one row, so that a row of a shuffle carries many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def stretches(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``values``, from ``bounds[k]`` to ``bounds[k + 1]``, as one row of bytes each."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds) * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def numbers(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """The numbers of all rows, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(column.buffers()[2], kind, (hi - lo) // np.dtype(kind).itemsize, lo) if hi > lo else np.zeros(0, kind)


def counts(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """How many numbers each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets) // np.dtype(kind).itemsize


def planes(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of all numbers of an array, compressed: small and repeated ones take next to nothing."""
    head, raw = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a, np.min_scalar_type(int(a.max(initial=0))))
        head += [len(a), a.itemsize]
        raw.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    body = np.array(head, np.int64).tobytes() + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unplaned(b: bytes | memoryview) -> list[np.ndarray]:
    """The arrays of ``planes``, each in the narrowest kind that holds it."""
    b = memoryview(b)
    body = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    shapes, at, out = np.frombuffer(body, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for length, size in shapes.tolist():
        out.append(np.frombuffer(body, np.uint8, length * size, at).reshape(size, length).T.copy().view(f"u{size}").reshape(length))
        at += length * size
    return out
