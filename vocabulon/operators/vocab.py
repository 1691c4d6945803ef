"""Vocabulary, ids, subsampling and the negative-sampling distribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import draws_of
from ..functions.packed import planes, stretches, unplaned
from ..functions.scalars import below
from ..sources.scratch import written
from ..sources.ship import ship
from .ordered import BLOCK, ranked, running, running_max

#: Words, and bytes, of the documents that share a dictionary; a document that is many times as long is cut.
CHUNK, CHUNK_BYTES, LONG = 1 << 20, 64 << 20, 4
#: Tokens that are counted together: the more, the fewer rows a frequent word has.
TALLY = 1 << 21


def _tally(t: pa.Table, few: int) -> pa.RecordBatch:
    """A row a word of ``t`` (doc_id, pos, word), and with ``few`` a row a document: what ``_tallies`` has."""
    runs = pc.run_end_encode(pa.concat_arrays(t.column("doc_id").chunks))
    pos, starts = t.column("pos").to_numpy(), np.zeros(t.num_rows, bool)
    starts[np.append(0, runs.run_ends.to_numpy()[:-1])] = True
    v = runs.values
    if v.null_count or not pc.all(pc.less(v[:-1], v[1:]), min_count=0).as_py() or not (starts[1:] | (pos[1:] > pos[:-1])).all():
        t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("pos", "ascending")], null_placement="at_end"))
        runs, pos = pc.run_end_encode(pa.concat_arrays(t.column("doc_id").chunks)), t.column("pos").to_numpy()
    docs, ends = pa.concat_arrays(t.column("doc_id").chunks), runs.run_ends.to_numpy()
    coded = pa.concat_arrays(t.column("word").chunks).dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(coded.dictionary)
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]  # the earliest place is written last
    cnt = np.bincount(codes, minlength=n)
    rare = cnt < few
    at = np.flatnonzero(rare[codes])
    at = at[np.argsort(codes[at], kind="stable")]
    more = len(ends) if few else 0
    offsets = np.concatenate(([0], np.cumsum(np.append(np.where(rare, cnt, 0), np.zeros(more, np.int64)))))
    with_nulls = lambda x, after: pa.concat_arrays([x, pa.nulls(more, x.type)] if after else [pa.nulls(n, x.type), x])
    of = runs.values[:more]
    return pa.RecordBatch.from_arrays(
        [
            with_nulls(coded.dictionary, True), with_nulls(of, False), pa.array(np.arange(n + more) >= n), pa.array(np.append(cnt, np.diff(ends, prepend=0)[:more])), with_nulls(docs.take(pa.array(first)), True),
            with_nulls(pa.array(pos[first]), True), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), docs.take(pa.array(at))),
        ],
        ["word", "of", "whole", "cnt", "doc_id", "pos", "docs"],
    )


def _tallies(tokens: DataFrame, few: int = 0, size: int = TALLY) -> DataFrame:
    """What chunks of about ``size`` tokens hold, so that a token isn't sorted, or shuffled, by its word.

    A row a word and chunk: its count there and where it is first; if the count is below ``few``, docs has the documents of all its tokens.
    With ``few`` also a row a document and chunk (``whole``, its id in ``of``): how many tokens it has there.
    """
    ship(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size_ = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n, size_ = n + b.num_rows, size_ + b.nbytes
            if n >= size or size_ >= CHUNK_BYTES:
                yield _tally(pa.Table.from_batches(held), few)
                held, n, size_ = [], 0, 0
        if held:
            yield _tally(pa.Table.from_batches(held), few)

    rows = tokens.where("word is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), "word")
    return rows.mapInArrow(run, f"word string, of {kind}, whole boolean, cnt long, doc_id {kind}, pos long, docs array<{kind}>")


def _first() -> Column:
    """Where a word is first; tokens without a document count, but aren't first."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first")


def word_counts(tokens: DataFrame, size: int = TALLY) -> DataFrame:
    """word, cnt, first: how often and where first, combined before the shuffle."""
    return _tallies(tokens, 0, size).select("word", "cnt", "doc_id", "pos").groupBy("word").agg(F.sum("cnt").alias("cnt"), _first())


def _tallied(tokens: DataFrame, min_count: int, size: int, first: bool) -> DataFrame:
    """word, of, whole, cnt, docs, with ``first`` first, of all chunks together: docs is that of words out of the vocabulary, and null for others."""
    rows = _tallies(tokens, min_count, size).select("word", "of", "whole", "cnt", *(("doc_id", "pos") if first else ()), "docs").repartition("word", "of", "whole")  # chunks are combined already
    found = rows.groupBy("word", "of", "whole").agg(F.sum("cnt").alias("cnt"), F.flatten(F.collect_list("docs")).alias("docs"), *([_first()] if first else []))
    rare = ~F.col("whole") & (F.col("cnt") < min_count)
    return found.select(F.when(~rare, F.col("word")).alias("word"), "of", "whole", "cnt", *(["first"] if first else []), F.when(rare, F.col("docs")).alias("docs"))


def _lengths(tallied: DataFrame) -> DataFrame:
    """All of a document's tokens, less those of words out of the vocabulary; these are few, and listed with their words."""
    row = lambda doc, n: F.struct(doc.alias("doc_id"), n.cast("long").alias("n"))
    rows = F.when(F.col("whole"), F.array(row(F.col("of"), F.col("cnt")))).otherwise(F.transform("docs", lambda d: row(d, F.lit(-1))))
    return tallied.select(F.explode(rows).alias("x")).groupBy("x.doc_id").agg(F.sum("x.n").alias("n")).where("n > 0")


def known_lengths(tokens: DataFrame, min_count: int = 5, size: int = TALLY) -> DataFrame:
    """doc_id, n: how many words of the vocabulary each document has, if any; no token is encoded for that."""
    return _lengths(_tallied(tokens, min_count, size, False))


def vocab_and_lengths(tokens: DataFrame, min_count: int = 5, size: int = TALLY, width: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``build_vocab`` and ``known_lengths`` from one reading of the text."""
    t = written(_tallied(tokens, min_count, size, True), "tallied")
    known = t.where(~F.col("whole") & F.col("docs").isNull()).select("word", "cnt", "first")
    return written(_placed(known, width), "vocab"), written(_lengths(t), "lengths")


def build_vocab(tokens: DataFrame, min_count: int = 5, width: int = BLOCK) -> DataFrame:
    """id, word, cnt: by falling count, ties as first seen.

    A word's id is the number of words with a higher count plus its rank among its own count, so no
    task sorts the whole vocabulary: only the distinct counts meet in one window, and the words of one
    count are ranked by ranges of ``width`` documents.
    """
    return _placed(written(word_counts(tokens).where(F.col("cnt") >= min_count), "words"), width)  # read three times; the text once


def _placed(counted: DataFrame, width: int) -> DataFrame:
    """id, word, cnt of ``counted`` (word, cnt, first)."""
    sizes = counted.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("cnt", F.coalesce(above, F.lit(0)).alias("above"))
    placed = ranked(counted, "cnt", F.col("first.doc_id"), ["first"], "rank", width)
    return placed.join(offsets, "cnt").select((F.col("above") + F.col("rank") - 1).cast("long").alias("id"), "word", "cnt")


def _chunks(tokens: DataFrame, size: int) -> DataFrame:
    """``tokens`` by chunks of whole documents: a chunk's words once, and for its tokens their numbers and places, packed.

    docs and ends are the runs of tokens of one document; pos holds the steps from one place to the next.
    """

    def chunk(t: pa.Table, key: int) -> pa.RecordBatch:
        runs = pc.run_end_encode(pa.concat_arrays(t.column("doc_id").chunks))
        coded = pa.concat_arrays(t.column("word").chunks).dictionary_encode()
        codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int32)
        pos = t.column("pos").to_numpy().astype(np.int64)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        raw = lambda x: pa.array([planes(x)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([key]), one(coded.dictionary), one(runs.values), raw(runs.run_ends.to_numpy()), raw(np.diff(pos, prepend=0).view(np.uint64)), raw(codes)], ["chunk", "words", "docs", "ends", "pos", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, size_ = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            held.append(b)
            n, size_ = n + b.num_rows, size_ + b.nbytes
            share = max(n / size, size_ / CHUNK_BYTES)
            if share < 1:
                continue
            t = pa.Table.from_batches(held)
            ends = pc.run_end_encode(pa.concat_arrays(t.column("doc_id").chunks)).run_ends.to_numpy()
            cut = n if share >= LONG else int(ends[-2]) if len(ends) > 1 else 0  # the last document may go on
            if cut:
                yield chunk(t.slice(0, cut), key)
                rest = t.slice(cut).combine_chunks()
                key, held, n, size_ = key + 1, rest.to_batches(), n - cut, rest.nbytes
        if n:
            yield chunk(pa.Table.from_batches(held), key)

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.select("doc_id", F.col("pos").cast("long").alias("pos"), "word").mapInArrow(run, f"chunk long, words array<string>, docs array<{kind}>, ends binary, pos binary, codes binary")
    return written(rows, "chunks")


@dataclass
class Chunk:
    """Words of the vocabulary of whole documents, in their order."""

    docs: pa.Array  # the documents' ids
    own: np.ndarray  # a word's document, as a place in ``docs``
    pos: np.ndarray  # its place in the text
    word: np.ndarray  # which word it is, as a place in ``ids``
    ids: np.ndarray  # the distinct words' ids, rising
    more: dict[str, np.ndarray]  # further columns of the vocabulary, by ``ids``

    def closed(self) -> np.ndarray:
        """Places where words out of the vocabulary don't count."""
        return np.arange(len(self.own)) - np.searchsorted(self.own, self.own)


class Encoded:
    """``tokens`` in chunks of about ``size`` words: the vocabulary meets a chunk's distinct words, not its tokens.

    ``whole``: no document is in two chunks, so what a chunk says of its documents holds.
    """

    def __init__(self, tokens: DataFrame, vocab: DataFrame, size: int = CHUNK):
        ship(tokens.sparkSession)
        self.vocab, self.kind = vocab, tokens.schema["doc_id"].dataType.simpleString()
        self.chunks = _chunks(tokens, size)
        self.whole = self.chunks.select(F.explode("docs").alias("doc_id")).groupBy("doc_id").count().where("count > 1").isEmpty()

    def mapped(self, f: Callable[[Chunk], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
        """``f`` of every chunk; ``more`` (id, further columns of numbers) goes with its words, 0 where it lacks one."""
        names = [c for c in more.columns if c != "id"] if more is not None else []
        known = self.vocab.select("word", "id")
        known = known.join(more, "id", "left") if more is not None else known
        words = self.chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("code", "word"))
        ids = words.join(known, "word").select("of", "code", "id", *names)

        def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
            ends, steps, codes = (unplaned(left.column(c)[0].as_buffer())[0] for c in ("ends", "pos", "codes"))
            ends, steps = ends.astype(np.int64), steps.astype(np.uint64).view(np.int64)  # a step back, to a document's first word, is a large number
            right = right.sort_by("id")
            table = np.full(int(codes.max()) + 1, -1, np.int32)
            table[right.column("code").to_numpy()] = np.arange(right.num_rows, dtype=np.int32)
            word = table[codes]
            known = word >= 0
            own = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))[known]
            out = f(Chunk(left.column("docs")[0].values, own, np.cumsum(steps)[known], word[known], right.column("id").to_numpy(), {c: right.column(c).fill_null(0).to_numpy() for c in names}))
            pa.default_memory_pool().release_unused()  # the worker waits beside later stages
            return out

        return self.chunks.drop("words").groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(looked_up, schema)

    def rows(self, close: bool) -> DataFrame:
        """doc_id, pos, id; with ``close`` places close up."""
        whole = self.whole

        def tokens(c: Chunk) -> pa.Table:
            return pa.table([c.docs.take(pa.array(c.own)), pa.array(c.closed() if close and whole else c.pos), pa.array(c.ids[c.word])], ["doc_id", "pos", "id"])

        rows = self.mapped(tokens, f"doc_id {self.kind}, pos long, id long")
        if whole:
            return rows
        if close:
            place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
            return rows.select("doc_id", place.cast("long").alias("pos"), "id")
        return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos")


class Stream:
    """An encoded ``text`` as chunks of the one stream of all documents, which are read like its own chunks.

    A document travels as one row of its ids, to meet its start, and as a piece for each chunk that it is in.
    """

    def __init__(self, text: Encoded, chunk: int, width: int = BLOCK):
        self.text, self.chunk, self.width, self.whole, self.vocab = text, chunk, width, text.whole, text.vocab

    def mapped(self, f: Callable[[Chunk], pa.Table], schema: str) -> DataFrame:
        def packed(c: Chunk) -> pa.Table:
            own, first = np.unique(c.own, return_index=True)
            bounds = np.append(first, len(c.own))
            return pa.table([c.docs.take(pa.array(own)), pa.array(np.diff(bounds)), stretches(c.ids[c.word], bounds)], ["doc_id", "n", "a"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for start, a in zip(b.column("start").to_pylist(), b.column("a"), strict=True):
                    ids = np.frombuffer(a.as_buffer(), np.int64)
                    for lo in range(start // chunk * chunk, start + len(ids), chunk):
                        out.append((lo // chunk, max(lo, start), planes(ids[max(lo - start, 0) : lo + chunk - start])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["chunk", "place", "a"])

        def met(held: list[np.ndarray]) -> pa.Table:
            ids, word = np.unique(np.concatenate(held).astype(np.int64), return_inverse=True)
            return f(Chunk(pa.array([0]), np.zeros(len(word), np.int32), np.arange(len(word)), word.astype(np.int32), ids, {}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                for at, a in zip(b.column("chunk").to_pylist(), b.column("a"), strict=True):
                    if at != now and held:
                        yield from met(held).to_batches()
                        held = []
                    now = at
                    held.append(unplaned(a.as_buffer())[0])
            if held:
                yield from met(held).to_batches()
            pa.default_memory_pool().release_unused()

        chunk = self.chunk
        docs = written(self.text.mapped(packed, f"doc_id {self.text.kind}, n long, a binary"), "docs")
        placed = docs.select("doc_id", "a").join(_starts(docs.select("doc_id", "n"), self.width).select("doc_id", "start"), "doc_id")
        pieces = placed.select("start", "a").mapInArrow(cut, "chunk long, place long, a binary")
        return pieces.repartition("chunk").sortWithinPartitions("chunk", "place").select("chunk", "a").mapInArrow(run, schema)

    def rows(self, close: bool) -> DataFrame:
        """doc_id, pos, id: a chunk and the place in it."""
        rows = chunked(self.text.rows(True), self.chunk, width=self.width)
        return rows if close else rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos")


def _known(tokens: DataFrame, vocab: DataFrame, close: bool, size: int) -> DataFrame:
    return Encoded(tokens, vocab, size).rows(close)


def known_words(tokens: DataFrame, vocab: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, pos, id: words of the vocabulary where they stand; a document's stand together and in their order.

    Documents travel in chunks of ``size`` words: the vocabulary meets a chunk's distinct words, not its tokens.
    """
    return _known(tokens, vocab, False, size)


def encode(tokens: DataFrame, vocab: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, pos, id: words out of the vocabulary go, and positions close up."""
    return _known(tokens, vocab, True, size)


def keep_probabilities(vocab: DataFrame, threshold: float = 1e-5) -> DataFrame:
    """``vocab`` with keep_prob; the total is over in-vocabulary words."""
    total = vocab.agg(F.sum("cnt").alias("total")).scalar()
    ratio = F.lit(threshold) / (F.col("cnt") / total)
    return vocab.withColumn("keep_prob", F.least(F.sqrt(ratio) + ratio, F.lit(1.0)))


def subsample(ids: DataFrame, kept: DataFrame, seed: int = 1, epoch: int = 0) -> DataFrame:
    """Tokens that their word's keep probability lets through; positions close up."""
    drawn = ids.join(kept.select("id", "keep_prob"), "id").where(below(F.col("keep_prob"), seed, "=sub", epoch, "doc_id", "pos"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return drawn.select("doc_id", place.cast("long").alias("pos"), "id")


def subsampled(text: Encoded, kept: DataFrame, seed: int = 1, epoch: int = 0) -> DataFrame:
    """``subsample`` of an encoded text: a chunk draws for its words where they are, and only what is kept becomes rows."""
    if not text.whole:
        return subsample(text.rows(True), kept, seed, epoch)

    def run(c: Chunk) -> pa.Table:
        drawn = draws_of(draw_keys(c.docs, seed, "sub", epoch), c.own, c.closed(), [b""])[0]
        at = np.flatnonzero(drawn < np.ceil(c.more["keep_prob"] * 4294967296.0)[c.word])
        own = c.own[at]
        return pa.table([c.docs.take(pa.array(own)), pa.array(np.arange(len(own)) - np.searchsorted(own, own)), pa.array(c.ids[c.word[at]])], ["doc_id", "pos", "id"])

    return text.mapped(run, f"doc_id {text.kind}, pos long, id long", kept.select("id", "keep_prob"))


def draw_keys(docs: pa.Array, seed: int, purpose: str, epoch: int) -> list[bytes]:
    """What the keys of ``scalars.uniform`` begin with, up to the place; a document without an id leaves it out."""
    return ["|".join([str(seed), purpose, str(epoch), *([] if d is None else [d]), ""]).encode() for d in docs.cast(pa.string()).to_pylist()]


def negative_table(vocab: DataFrame, size: int = 10_000_000, power: float = 0.75, width: int = BLOCK) -> DataFrame:
    """id, lo, hi: slots lo <= r < hi of a table of ``size`` draw the id; it is never materialised.

    The cumulative weight is an exact decimal sum in id order, by blocks of ``width`` ids, so neither partitions nor the number of words
    move a slot; its share rounds half to even.
    """
    weight = F.pow(F.col("cnt").cast("double"), F.lit(power)).cast("decimal(28,16)")
    total = vocab.agg(F.sum(weight).cast("double").alias("total")).scalar()
    shares = running(vocab.select("id", weight.alias("p")), "id", F.col("p"), "c", width)
    end = F.least(F.bround(F.col("c").cast("double") * F.lit(size) / total).cast("long"), F.lit(size).cast("long"))
    ends = running_max(shares.select("id", end.alias("end")), "id", "end", "hi", "lo", width)
    last = vocab.agg(F.max("id").alias("last")).scalar()
    return ends.select("id", F.coalesce("lo", F.lit(0).cast("long")).alias("lo"), F.when(F.col("id") == last, F.lit(size).cast("long")).otherwise(F.col("hi")).alias("hi"))


def draw_negatives(slots: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """``slots`` (any columns, r in [0, size)) with the id whose interval holds r.

    The interval join is an equi-join on a grid of ``size`` / 4096 slots: an interval is listed in each
    grid cell it meets, a draw in its own.
    """
    step = max(1, size // 4096)
    cells = table.where("hi > lo").select("id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("_cell"))
    drawn = slots.withColumn("_cell", F.floor(F.col("r") / step))
    return drawn.join(cells, "_cell").where("r >= lo and r < hi").drop("_cell", "lo", "hi")


def _starts(tokens_per_doc: DataFrame, width: int) -> DataFrame:
    """(doc_id, n) with start: where a document begins in the one stream of all documents in id order."""
    return running(tokens_per_doc.where("n > 0"), "doc_id", F.col("n"), "start", width, inclusive=False)


def chunk_sizes(tokens_per_doc: DataFrame, chunk: int, drop_tail: bool = False, width: int = BLOCK) -> DataFrame:
    """chunk_id, n of the one stream that all documents form in id order (doc_id, n).

    Only one row a document is ordered, by blocks of ``width`` ids; its tokens' global positions are its start and what follows.
    """
    docs = _starts(tokens_per_doc, width)
    last = F.floor((F.col("start") + F.col("n") - 1) / chunk)
    met = docs.select("start", "n", F.explode(F.sequence(F.floor(F.col("start") / chunk), last)).alias("chunk_id"))
    part = F.least(F.col("start") + F.col("n"), (F.col("chunk_id") + 1) * chunk) - F.greatest("start", F.col("chunk_id") * chunk)
    sizes = met.groupBy("chunk_id").agg(F.sum(part).alias("n"))
    return sizes.where(F.col("n") == chunk) if drop_tail else sizes


def chunked(ids: DataFrame, chunk: int, drop_tail: bool = False, width: int = BLOCK) -> DataFrame:
    """``ids`` (doc_id, pos, id) as chunks of the one stream: doc_id is the chunk, pos the place in it.

    Pairs, co-occurrence and training read the result like documents, and then look across the documents' bounds.
    """
    sizes = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("start") + F.col("pos")
    placed = ids.join(_starts(sizes, width).select("doc_id", "start"), "doc_id").select(F.floor(at / chunk).alias("doc_id"), (at % chunk).alias("pos"), "id")
    if not drop_tail:
        return placed
    total = sizes.agg(F.sum("n").alias("total")).scalar()
    return placed.where(F.col("doc_id") < F.floor(total / chunk))
