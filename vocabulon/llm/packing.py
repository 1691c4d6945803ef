"""Best-fit packing by hierarchical residual merging.

A document is its token ids and an end id; only longer ones are cut, into full pieces and a rest.
Every partition packs its pieces best-fit, longest first.  Bins that are nearly full are final.  The
others become items, as long as what they hold, of the next round, in which groups of partitions
merge, until one round in groups of bounded size removes hardly a bin any more.

Words repeat, so each worker keeps the ids of the words it has met and asks the tokenizer only for
new ones: words are cut at ASCII white space, which the tokenizer drops and never joins across.

Defined cases: null text counts as empty and gives the end id alone; repeated rows are packed each;
a text of any length is tokenised whole; of pieces of one length it doesn't matter which goes first,
and which bins they share follows the order of rows in the partitions, so reruns over other partitions
may pack other, equally full, sequences; extra columns aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .durable import written

CAPACITY, END_ID = 4096, 1
NEARLY_FULL = 0.99
GROUP_ITEMS = 100_000
#: Words and parts of words whose ids a worker keeps, and bytes of what it keeps of the words; beyond any, it starts anew.
KEPT_WORDS, KEPT_PARTS, KEPT_BYTES = 1_000_000, 100_000, 64 << 20
#: Words of these characters alone are composed, have plain lower case and no white space, so they can be cut by
#: the tokenizer's own pattern here and need its merges only; all others go through the whole tokenizer.
_PLAIN = re.compile("[\\x21-\\x7e\u00a1-\u012f\u0131-\u0148\u014a-\u017e]+")
# Fixed value: the split pattern of the tokenizer's file, and what it says of lower-case printable ASCII.
_PART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level BPE writes bytes as: printable ones as themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class HashTable:
    """64-bit keys to places, open addressing, whole arrays at a time; doubles when half full."""

    def __init__(self):
        self.keys, self.place, self.count = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the keys; -1 for those that are missing."""
        out = np.full(len(h), -1, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        todo, slot = np.arange(len(h)), h & mask
        while len(todo):
            there = self.keys[slot]
            hit = there == h[todo]
            out[todo[hit]] = self.place[slot[hit]]
            more = ~hit & (there != 0)
            todo, slot = todo[more], (slot[more] + np.uint64(1)) & mask
        return out

    def add(self, h: np.ndarray, place: np.ndarray) -> None:
        """Distinct keys that are not in the table; none is 0."""
        if 2 * (self.count + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            h, place = np.concatenate((self.keys[used], h)), np.concatenate((self.place[used], place))
            n = 1 << int(2 * len(h)).bit_length()
            self.keys, self.place, self.count = np.zeros(n, np.uint64), np.zeros(n, np.int32), 0
        mask = np.uint64(len(self.keys) - 1)
        self.count += len(h)
        slot = h & mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several keys for one slot the last gets it
            won = self.keys[slot] == h
            self.place[slot[won]] = place[won]
            lost = ~won
            h, place, slot = h[lost], place[lost], (slot[lost] + np.uint64(1)) & mask


class WordIds:
    """Token ids of words, found by their 64-bit hash and compared."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cut = self.tokenizer.model, regex.compile(_PART)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.parts: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.table, self.n_ids, self.n_bytes = HashTable(), 0, 0
        self.lo, self.n, self.at, self.size = (np.zeros(1 << 16, t) for t in (np.int32, np.int32, np.int32, np.int32))
        self.head, self.tail = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.ids, self.bytes = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint8)

    def word(self, text: str) -> list[int]:
        if text.isascii() and text.isprintable() and "<|" not in text:
            lower = text.lower()
            return self._part(lower) if lower.isalpha() else [i for part in _ASCII_PART.findall(lower) for i in self._part(part)]
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [i for part in self.cut.findall(text.lower()) for i in self._part(part.encode().decode("latin-1").translate(self.letters))]

    def _part(self, letters: str) -> list[int]:
        """Ids of a part of a word, in the letters that stand for its bytes (printable ASCII stands for itself)."""
        ids = self.parts.get(letters)
        if ids is None:
            if len(self.parts) >= KEPT_PARTS:
                self.parts.clear()
            ids = self.parts[letters] = [t.id for t in self.model.tokenize(letters)]
        return ids

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        """``a`` with room for ``n`` entries; new pages stay untouched until they are used."""
        if n <= len(a):
            return a
        more = np.zeros(2 * n, a.dtype)
        more[: len(a)] = a
        return more

    def _learn(self, keys: np.ndarray, words: list[bytes], head: np.ndarray, tail: np.ndarray) -> None:
        found = [self.word(x) for x in b" ".join(words).decode().split(" ")]  # words hold no blanks
        n = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        size = np.fromiter(map(len, words), np.int32, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        at, end = self.table.count, self.table.count + len(keys)
        for name in ("lo", "n", "at", "size", "head", "tail"):
            setattr(self, name, self._room(getattr(self, name), end))
        self.ids, self.bytes = self._room(self.ids, self.n_ids + len(new)), self._room(self.bytes, self.n_bytes + len(text))
        self.lo[at:end] = self.n_ids + np.cumsum(n, dtype=np.int64) - n
        self.at[at:end] = self.n_bytes + np.cumsum(size, dtype=np.int64) - size
        self.n[at:end], self.size[at:end], self.head[at:end], self.tail[at:end] = n, size, head, tail
        self.ids[self.n_ids : self.n_ids + len(new)] = new
        self.bytes[self.n_bytes : self.n_bytes + len(text)] = text
        self.n_ids += len(new)
        self.n_bytes += len(text)
        self.table.add(keys, np.arange(at, end, dtype=np.int32))

    @staticmethod
    def _ends(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size, first eight and last eight bytes of each word, which tell words of up to sixteen bytes apart."""
        padded = np.zeros(len(w.buf) + 16, np.uint8)
        padded[8:-8] = w.buf
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        size = (w.end - w.start).astype(np.int32)
        spare = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        return size, eight[w.start + 8] << spare, eight[w.end] >> spare

    def _others(self, w: tk.Words, place: np.ndarray, size: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Words of ``w`` that aren't the word kept at their ``place``: two words of one hash."""
        same = (size == self.size[place]) & (head == self.head[place]) & (tail == self.tail[place])
        for i in np.flatnonzero(same & (size > 16)).tolist():
            k = self.at[place[i]]
            same[i] = np.array_equal(w.buf[w.start[i] : w.end[i]], self.bytes[k : k + size[i]])
        return np.flatnonzero(~same)

    def encode(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of ``w``, END_ID after each row, and the rows' bounds.

        Words are looked up by hash and then compared; of two words of one hash the one that isn't kept is encoded by itself.
        """
        h = w.hashes() | np.uint64(1)
        size, head, tail = self._ends(w)
        place = self.table.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            first = new[first]
            if self.table.count + len(first) > KEPT_WORDS or self.n_bytes + int(size[first].sum()) > KEPT_BYTES:
                self._clear()
                keys, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
            whole = w.buf.tobytes()
            self._learn(keys, [whole[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], head[first], tail[first])
            place[new] = self.table.find(h[new])
        each, lo = self.n[place], self.lo[place]
        kept, others = self.ids, self._others(w, place, size, head, tail)
        if len(others):
            own = [self.word(bytes(w.buf[w.start[i] : w.end[i]]).decode()) for i in others.tolist()]
            each[others] = [len(x) for x in own]
            lo[others] = self.n_ids + np.cumsum(each[others]) - each[others]
            kept = np.concatenate((self.ids[: self.n_ids], np.array([i for x in own for i in x], np.uint32)))
        total = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        bounds = total[w.first] + np.arange(len(w.first))
        out = np.full(int(bounds[-1]), END_ID, np.uint32)
        ids = np.ones(len(out), bool)
        ids[bounds[1:] - 1] = False
        out[ids] = kept[np.arange(int(total[-1]), dtype=np.int32) - np.repeat((total[:-1] - lo).astype(np.int32), each)]
        return out, bounds


_encoders: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for the pieces of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordIds(tokenizer)
        encoder = _encoders[tokenizer]
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for lo, hi, w in tk.slices(b.column("text")):
                ids, bounds = encoder.encode(w)
                for i in range(hi - lo):
                    for k, s in enumerate(range(int(bounds[i]), int(bounds[i + 1]), capacity)):
                        e = min(s + capacity, int(bounds[i + 1]))
                        row.append(lo + i)
                        piece.append(k)
                        start.append(k * capacity)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e].astype("<u4", copy=False).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(free, (n, -1))
        if at == len(free):
            b, left = len(bins), capacity - n
            bins.append([])
        else:
            left, b = free.pop(at)
            left -= n
        bins[b].append(int(i))
        if left:
            insort(free, (left, b))
    return bins


MEMBER = "struct<doc_id:{id},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"


def pack(parts: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``parts`` (of pieces()) with sequence_id and offset."""
    member = MEMBER.format(id=parts.schema["doc_id"].dataType.simpleString())
    schema = f"length bigint, members array<{member}>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's items, in runs of at most GROUP_ITEMS, packed best-fit."""
        kind, held, rows = None, [], 0
        for b in batches:
            kind = b.schema
            held.append(b)
            rows += b.num_rows
            if rows >= GROUP_ITEMS:
                yield from emit(held, kind)
                held, rows = [], 0
        if held:
            yield from emit(held, kind)

    def emit(held: list[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        members, lengths = pa.concat_arrays(table.column("members").chunks), table.column("length").to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
        moved = members.take(pa.array(order))
        counts = np.diff(moved.offsets.to_numpy())
        ends = np.cumsum([len(b) for b in bins])
        bounds = np.concatenate(([0], np.cumsum(counts)[ends - 1])).astype(np.int32)
        total = pa.array(np.add.reduceat(lengths[order], np.concatenate(([0], ends[:-1]))), pa.int64())
        flat = moved.flatten()
        before = np.concatenate(([0], np.cumsum(flat.field("length").to_numpy())))[:-1]
        offset = pa.array(before - np.repeat(before[bounds[:-1]], np.diff(bounds)), pa.int64())
        own = flat.type
        flat = pa.StructArray.from_arrays([flat.field(f.name) if f.name != "offset" else offset for f in own], fields=list(own))
        out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
        yield from pa.table([total, out.cast(kind.field("members").type)], names=["length", "members"]).to_batches(max_chunksize=2000)

    items = parts.select("length", F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")).cast(member)).alias("members"))
    done: list[DataFrame] = []
    before = None
    while True:
        packed = written(items.mapInArrow(local, schema), "bins")
        full = F.col("length") >= nearly_full * capacity
        under = packed.where(~full)
        count = under.count()
        groups = -(-count // GROUP_ITEMS)
        if count == 0 or (before is not None and (groups == before[1] == 1 or count > 0.98 * before[0])):
            done.append(packed)
            break
        done.append(packed.where(full))
        before = (count, groups)
        items = under.coalesce(1) if groups <= 1 else under.repartition(groups, F.xxhash64("members"))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    numbered = bins.withColumn("sequence_id", F.monotonically_increasing_id())  # of bins, so before they are taken apart
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id")
