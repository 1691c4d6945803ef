"""Substring deduplication by level-wise doubling.

Level one looks at windows of half the deciding width.  Of every stretch of that width it takes the
window with the least hash, so two documents that share a stretch share its chosen window, and one
window in thirteen is moved instead of all.  Only those that occur in two different documents are
extended to twice the length; of these, again only repeated ones survive, and they decide which
words go.  Survivors go on: a window of twice the length is made of two neighbours that survived, and
its hash of theirs, so no text is read again; until a level has no survivor.  The levels beyond the
deciding width remove no further word, they tell how long a document's repeated passages are.

Whole documents that equal an earlier one need no windows: all their words go, if they have enough
of them, and what they repeat is repeated by the earliest copy as well.  So a group of copies that
fills a third of the table costs one row per copy.

Defined cases: null text has no words; rows with a null id neither remove nor lose words; rows that
share an id don't remove each other's words; texts shorter than the width stay; documents of any
length are read whole; repeated rows share their id; extra columns aren't looked at; empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textkernel as tk
from .durable import dropped, released, written

WIDTH, BLOOM_BLOCKS = 50, 1 << 17
_SECOND_BASE = 0x8CB92BA72F3D8DD7
tk._INV[_SECOND_BASE] = pow(_SECOND_BASE, -1, 1 << 64)


#: Rows that are equal in id and text share it, and everything else about them.
KEY = ["doc_id", "rk"]


def row_key() -> Column:
    """Tells the rows of one id apart."""
    return F.xxhash64("doc_id", "text")


def least_windows(h: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least entry of every ``span`` consecutive ones (the first of equals)."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros((0,), np.int64)
    value, at, width = h, np.arange(len(h)), 1
    while 2 * width <= span:
        take = value[width:] < value[:-width]
        at = np.where(take, at[width:], at[:-width])
        value = np.where(take, value[width:], value[:-width])
        width *= 2
    if width < span:
        step = span - width
        take = value[step:] < value[:-step]
        at = np.where(take, at[step:], at[:-step])
    return at[:n]


def _anchors(w: tk.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions (in the slice) and hashes of the chosen half-width windows."""
    half = width // 2
    h = tk.windows(w.hashes(), half)
    at = least_windows(h, width - half + 1)
    at = np.unique(at[: len(tk.inside(w, width))][tk.inside(w, width)])
    return w.row[at], at, h[at].view(np.int64)


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def heads(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, rk, n_words, seq (SHA-256 of the words joined by spaces), anchors (distinct) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in tk.slices(b.column("text")):
                n = hi - lo
                rows, _, h = _anchors(w, width)
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
                seq = [hashlib.sha256(b" ".join(bytes(w.buf[s:e]).split())).digest() for s, e in zip(w.row_bytes[:-1], w.row_bytes[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi], b.column("rk")[lo:hi], pa.array(w.n_words, pa.int64()), pa.array(seq, pa.binary()), _lists(rows[new], n, h[new])],
                    ["doc_id", "rk", "n_words", "seq", "anchors"],
                )

    picked = docs.select("doc_id", row_key().alias("rk"), "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, rk long, n_words long, seq binary, anchors array<long>")


def _wide(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows of ``width`` words around the live anchors of each row, with 128 bits of hash."""
    for b in batches:
        for lo, hi, w in tk.slices(b.column("text")):
            live = b.column("live")[lo:hi]
            rows, at, h = _anchors(w, width)
            own = live.flatten().to_numpy()
            own_row = np.repeat(np.arange(hi - lo), np.diff(live.offsets.to_numpy()))
            salt = tk.mix(np.arange(1, hi - lo + 1, dtype=np.uint64))
            with np.errstate(over="ignore"):
                keep = np.isin(h.view(np.uint64) + salt[rows], own.view(np.uint64) + salt[own_row])
            at = at[keep]
            fit = tk.inside(w, width)
            near = np.zeros(len(fit) + 1, np.int64)
            np.add.at(near, np.maximum(at - (width - width // 2), 0), 1)
            np.subtract.at(near, np.minimum(at + 1, len(fit)), 1)
            pos = np.flatnonzero((np.cumsum(near[:-1]) > 0) & fit)
            words = w.hashes()
            a, c = tk.windows(words, width)[pos].view(np.int64), tk.windows(words, width, _SECOND_BASE)[pos].view(np.int64)
            row = w.row[pos]
            start = (pos - w.first[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[lo:hi], b.column("rk")[lo:hi], *(_lists(row, hi - lo, x) for x in (start, a, c))], ["doc_id", "rk", "start", "a", "b"]
            )


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, sha = [], []
        for t, starts in zip(b.column("text"), b.column("starts"), strict=True):
            words = (t.as_py() or "").encode().split()
            cover = np.zeros(len(words) + 1, np.int64)
            at = starts.values.to_numpy()
            np.add.at(cover, at, 1)
            np.subtract.at(cover, np.minimum(at + width, len(words)), 1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(removed, pa.int64()), pa.array(sha, pa.binary())], [*KEY, "n_removed", "kept"])


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, rk, text) of the documents whose key is in ``rows`` (doc_id, rk), and few others: filtered before they move."""
    return bloom.filtered(docs.select("doc_id", row_key().alias("rk"), "text"), "rk", rows.select("rk"), "rk", rows.count(), BLOOM_BLOCKS)


def _blocks(n: int) -> int:
    """Blocks of a filter of ``n`` windows, a power of two, so their number is a mask of the hash."""
    return 1 << (bloom.blocks_for(n, BLOOM_BLOCKS) - 1).bit_length()


def _filter_of(shared: DataFrame) -> np.ndarray:
    """The Bloom filter of shared windows (a, b), 8 MB at most: ``a`` has the block, ``b`` the bits."""
    blocks = _blocks(shared.count())
    place = F.struct(F.col("a").bitwiseAND(F.lit(blocks - 1)).alias("block"), F.col("b").alias("bits"))
    return np.array(bloom.build(shared, place, blocks).first()["bloom"], np.int64).view(np.uint64)


def _may_hold(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    slot = (a & np.uint64(len(bits) // bloom.BLOCK_LONGS - 1)) * np.uint64(bloom.BLOCK_LONGS)
    hit = np.ones(len(a), bool)
    for i in range(bloom.HASHES):
        bit = (b >> np.uint64(9 * i)) & np.uint64(64 * bloom.BLOCK_LONGS - 1)
        hit &= (bits[slot + (bit >> np.uint64(6))] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _doubled(batches: Iterator[pa.RecordBatch], width: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of windows of ``width`` words become rows of windows of twice as many: two neighbours, with a hash of their hashes.

    Windows that the filter ``bits`` of the shared ones doesn't know are left out first.
    """
    for batch in batches:
        lists = [batch.column(c) for c in ("start", "a", "b")]
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
        start, a, b = (x.flatten().to_numpy() for x in lists)
        a, b = a.view(np.uint64), b.view(np.uint64)
        if bits is not None:
            keep = _may_hold(bits, a, b)
            row, start, a, b = row[keep], start[keep], a[keep], b[keep]
        place = (row << 32) + start  # sorted, as starts are in a row
        after = np.searchsorted(place, place + width)
        first = np.flatnonzero((after < len(place)) & (place[np.minimum(after, len(place) - 1)] == place + width)) if len(place) else np.zeros(0, np.int64)
        second = after[first]
        with np.errstate(over="ignore"):
            a2 = tk.mix(a[first] + tk.mix(a[second] ^ np.uint64(width)))
            b2 = tk.mix(b[first] ^ tk.mix(b[second] + np.uint64(2 * width + 1)))
        rows, counts = np.unique(row[first], return_counts=True)
        bounds = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        new = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (start[first], a2.view(np.int64), b2.view(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in KEY] + new, [*KEY, "start", "a", "b"])


def _one_each(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each row one window that the filter knows."""
    for batch in batches:
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("a").offsets.to_numpy()))
        a, b = (batch.column(c).flatten().to_numpy().view(np.uint64) for c in ("a", "b"))
        at = np.flatnonzero(_may_hold(bits, a, b))
        rows, first = np.unique(row[at], return_index=True)
        values = [pa.array(x[at[first]].view(np.int64)) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in KEY] + values, [*KEY, "a", "b"])


def levels(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads with ``first_id`` and ``last_id`` (smallest and largest id with the same words); per row (doc_id, rk) the starts of
    its windows of ``width`` words that start in a document with a smaller id too; and per row the level, the longest of
    width, 2 * width, 4 * width, ... words that it has a window of which another document has as well."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = written(heads(docs, width), "heads")
    copies = written(own.where("doc_id is not null").groupBy("seq").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")), "copies")
    head = own.join(copies, "seq", "left")
    anchors = written(head.where("doc_id = first_id").select(*KEY, F.explode("anchors").alias("h")), "anchors")
    shared = written(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "shared")
    live = written(anchors.join(shared, "h").groupBy(*KEY).agg(F.collect_set("h").alias("live")), "live")
    dropped(anchors, shared)
    wide = (
        _texts_of(docs, live).join(live.hint("shuffle_hash"), KEY)
        .mapInArrow(lambda it: _wide(it, width), f"doc_id {kind}, rk long, start array<int>, a array<long>, b array<long>")
        .select(*KEY, F.explode(F.arrays_zip("start", "a", "b")).alias("w")).select(*KEY, "w.start", "w.a", "w.b")
    )
    windows = written(wide, "windows")
    bounds = windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b", "lo")
    bounds = written(bounds, "shared")  # before the join, so both sides are plain shuffles and a window of very many documents is split
    released(docs.sparkSession)
    kept = windows.join(bounds, ["a", "b"]).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "a", "b", "lo"))).alias("w"))
    kept = written(kept, "repeated")
    dropped(windows, bounds)
    starts = kept.select(*KEY, F.expr("transform(filter(w, x -> x.lo < doc_id), x -> x.start)").alias("starts")).where("size(starts) > 0")
    reached = [kept.select(*KEY, F.lit(width).alias("level"))]
    rows, bits = kept.select(*KEY, *[F.col(f"w.{c}").alias(c) for c in ("start", "a", "b")]), None
    schema = f"doc_id {kind}, rk long, start array<int>, a array<long>, b array<long>"
    before = None
    while True:
        candidates = written(rows.mapInArrow(lambda it, w=width, f=bits: _doubled(it, w, f), schema), "doubled")
        if before is not None:
            dropped(before)
        each = candidates.select("doc_id", F.explode(F.arrays_zip("a", "b")).alias("w")).select("doc_id", "w.a", "w.b")
        repeated = written(each.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b"), "shared")
        width *= 2
        if repeated.isEmpty():
            break
        bits = _filter_of(repeated)
        # one window a row is enough to tell that the row is on this level; where it was a false hit of the filter, all are looked at
        one = written(candidates.mapInArrow(lambda it, f=bits: _one_each(it, f), f"doc_id {kind}, rk long, a long, b long"), "one")
        sure = written(one.join(repeated, ["a", "b"]).select(*KEY).distinct(), "sure")
        rest = candidates.join(one.select(*KEY).join(sure, KEY, "left_anti"), KEY, "left_semi").select(*KEY, F.explode(F.arrays_zip("a", "b")).alias("w"))
        more = rest.select(*KEY, "w.a", "w.b").join(repeated, ["a", "b"]).select(*KEY).distinct()
        reached.append(written(sure.unionByName(more).select(*KEY, F.lit(width).alias("level")), "level"))
        dropped(one, sure, repeated)
        rows = before = candidates
    level = reduce(DataFrame.unionByName, reached).groupBy(*KEY).agg(F.max("level").alias("level"))
    return head.drop("anchors"), starts, level


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, level (words of its longest windows that another document has; 0: none)."""
    head, starts, level = levels(docs, width)
    cut = (
        _texts_of(docs, starts).join(starts, KEY).select(*KEY, "text", "starts")
        .mapInArrow(lambda it: _cut(it, width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rk long, n_removed long, kept binary")
        .groupBy(*KEY).agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    )
    found = head.join(cut, KEY, "left").join(level, KEY, "left")
    whole = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= width), F.lit(False))
    copied = F.coalesce((F.col("first_id") < F.col("last_id")) & (F.col("n_words") >= width), F.lit(False))
    doubling = F.lit(width) * F.expr(f"shiftleft(1, length(bin(greatest(n_words, {width}) div {width})) - 1)")
    return found.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "seq")))).alias("kept_sha256"),
        F.when(copied, doubling).otherwise(F.coalesce("level", F.lit(0))).cast("long").alias("level"),
    )
