"""MD5 of many short keys at once: the draws of ``scalars.uniform`` without a text, and a digest's text, for each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
#: Keys that are digested together, so that a step's numbers stay in a core's cache; bytes of a message of one block.
TOGETHER, ONE_BLOCK = 8192, 55


def leading(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first eight hexadecimal digits of the MD5 of ``n`` messages of one block, as numbers.

    A block is given by its sixteen little-endian words, each for all messages, or one number for all.
    """
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f = np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't reach the digest's first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        if isinstance(words[g], np.ndarray):
            a += words[g]
            a += _SINES[i]
        else:
            a += np.uint32((int(_SINES[i]) + words[g]) & 0xFFFFFFFF)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=f)
        a <<= _TURNS[i]
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def numbered_draws(keys: np.ndarray, own: np.ndarray, pos: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Draws in [0, 2**32) of the keys ``keys[own] + pos + "|" + j`` for j < ``k``; the rows of ``keys`` are bytes of one length."""
    digits = np.maximum(1, np.searchsorted(10 ** np.arange(1, 19), pos, "right") + 1)
    for count in np.unique(digits):
        at = np.flatnonzero(digits == count)
        for lo in range(0, len(at), TOGETHER):
            part = at[lo : lo + TOGETHER]
            head = keys.shape[1] + int(count)
            text = np.zeros((len(part), max(64, -(-(head + 24) // 4) * 4)), np.uint8)
            text[:, : keys.shape[1]] = keys[own[part]]
            rest = pos[part]
            for place in range(head - 1, keys.shape[1] - 1, -1):
                text[:, place] = 48 + rest % 10
                rest = rest // 10
            whole = [text.view("<u4")[:, j].copy() for j in range(min(16, head // 4))]
            for j in range(k):
                tail = np.frombuffer(f"|{j}".encode(), np.uint8)
                end = head + len(tail)
                text[:, head:end] = tail
                if end > ONE_BLOCK:
                    yield np.array([int.from_bytes(hashlib.md5(x[:end].tobytes()).digest()[:4], "big") for x in text], np.uint32)
                    continue
                text[:, end] = 0x80
                text[:, end + 1 : 56] = 0
                yield leading([*whole, *(text.view("<u4")[:, w].copy() if 4 * w <= end else 0 for w in range(len(whole), 14)), 8 * end, 0], len(part))


def draws_of(keys: Sequence[bytes], own: np.ndarray, pos: np.ndarray, tails: Sequence[bytes]) -> np.ndarray:
    """Draws in [0, 2**32) of ``keys[own] + pos + tail``: a row for each of ``tails``, a column for each place."""
    out = np.empty((len(tails), len(pos)), np.uint32)
    lengths = np.array([len(x) for x in keys], np.int64)
    digits = np.maximum(1, np.searchsorted(10 ** np.arange(1, 19), pos, "right") + 1)
    shape = lengths[own] * 32 + digits
    order = np.argsort(shape, kind="stable")
    cuts = np.flatnonzero(np.diff(shape[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        width, count = int(lengths[own[group[0]]]), int(digits[group[0]])
        head, longest = width + count, max(len(x) for x in tails)
        which, place = np.unique(own[group], return_inverse=True)
        texts = np.frombuffer(b"".join(keys[i] for i in which), np.uint8).reshape(len(which), width)
        for lo in range(0, len(group), TOGETHER):
            part = group[lo : lo + TOGETHER]
            text = np.zeros((len(part), max(64, -(-(head + longest + 1) // 4) * 4)), np.uint8)
            text[:, :width] = texts[place[lo : lo + TOGETHER]]
            rest = pos[part]
            for at in range(head - 1, width - 1, -1):
                text[:, at] = 48 + rest % 10
                rest = rest // 10
            whole = [text.view("<u4")[:, j].copy() for j in range(min(16, head // 4))]
            for row, tail in enumerate(tails):
                end = head + len(tail)
                text[:, head:end] = np.frombuffer(tail, np.uint8)
                if end > ONE_BLOCK:
                    out[row, part] = [int.from_bytes(hashlib.md5(x[:end].tobytes()).digest()[:4], "big") for x in text]
                    continue
                text[:, end] = 0x80
                text[:, end + 1 : 56] = 0
                out[row, part] = leading([*whole, *(text.view("<u4")[:, w].copy() if 4 * w <= end else 0 for w in range(len(whole), 14)), 8 * end, 0], len(part))
    return out
