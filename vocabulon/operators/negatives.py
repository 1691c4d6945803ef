"""Draws from the negative table, counted by slots before they meet its intervals: what is shuffled doesn't grow with the draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import numbered_draws
from ..functions.packed import stretches
from ..sources.ship import ship

#: Places of a document that are drawn for together, of all documents at once; draws that are counted at once; cells of the table.
STRETCH, PLACES, HELD, CELLS = 1 << 16, 1 << 18, 1 << 22, 4096
#: Draws that are worth a task, and those of one where all cores have some.
LEAST_DRAWS, TASK_DRAWS = 2_000_000, 100_000_000


def drawn_counts(lengths: DataFrame, table: DataFrame, size: int, k: int, seed: int = 1, epoch: int = 0, tasks: int | None = None) -> DataFrame:
    """id, draws, slots: how often, and the sum of the slots with which, ``k`` draws for each place of documents (doc_id, n) meet the ids of ``table`` (id, lo, hi).

    A draw is floor(uniform(seed, "=neg", epoch, doc_id, pos, k) * size).  A task counts its draws by slot, and passes the counts on by
    cells of the table: at most ``size`` small numbers a task, however many it draws.
    """
    spark = lengths.sparkSession
    ship(spark)
    step = max(1, -(-size // CELLS))
    if tasks is None:
        draws = k * (lengths.agg(F.sum("n")).first()[0] or 0)
        tasks = max(1, min(draws // LEAST_DRAWS, max(2 * spark.sparkContext.defaultParallelism, draws // TASK_DRAWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(size, np.int64), [], 0
        for b in batches:
            for drawn in _draws(b, k):
                held.append((drawn / 4294967296.0 * size).astype(np.int32))
                waiting += len(drawn)
                if waiting >= HELD:
                    counts += np.bincount(np.concatenate(held), minlength=size)
                    held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        bounds = np.append(np.arange(0, size, step), size)
        met = np.flatnonzero(np.add.reduceat(counts, bounds[:-1]))
        small = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met), stretches(small, bounds).take(pa.array(met))], ["cell", "counts"])

    parts = lengths.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))).alias("s"))
    key = F.concat(F.concat_ws("|", F.lit(str(seed)), F.lit("neg"), F.lit(str(epoch)), F.col("doc_id").cast("string")), F.lit("|"))
    rows = parts.select(key.alias("key"), (F.col("s") * STRETCH).alias("lo"), F.least(F.col("n") - F.col("s") * STRETCH, F.lit(STRETCH)).cast("long").alias("n"))
    counted = rows.repartition(int(tasks)).mapInArrow(run, "cell long, counts binary")
    intervals = table.where("hi > lo").select("id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("cell"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "draws": pa.array([], pa.int64()), "slots": pa.array([], pa.int64())})
        lo = left.column("cell")[0].as_py() * step
        n = min(step, size - lo)
        total = np.zeros(n, np.int64)
        for x in left.column("counts"):
            bytes_ = x.as_buffer()
            total += np.frombuffer(bytes_, f"u{bytes_.size // n}")
        before = lambda x: np.concatenate(([0], np.cumsum(x)))
        draws, slots = before(total), before(total * (lo + np.arange(n)))
        a, b = (np.clip(right.column(c).to_numpy() - lo, 0, n) for c in ("lo", "hi"))
        return pa.table({"id": right.column("id"), "draws": draws[b] - draws[a], "slots": slots[b] - slots[a]})

    found = counted.groupBy("cell").cogroup(intervals.groupBy("cell")).applyInArrow(met, "id long, draws long, slots long")
    return found.groupBy("id").agg(F.sum("draws").alias("draws"), F.sum("slots").alias("slots")).where("draws > 0")


def _draws(b: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """``k`` draws of 32 bits for each place from lo, n of them, of the rows (key, lo, n); PLACES places at once, or one row's."""
    width = pc.binary_length(b.column("key")).to_numpy()
    for w in np.unique(width):
        own = b.take(pa.array(np.flatnonzero(width == w)))
        keys = np.frombuffer("".join(own.column("key").to_pylist()).encode(), np.uint8).reshape(-1, w)
        lo, n = own.column("lo").to_numpy(), own.column("n").to_numpy()
        turn = np.cumsum(n) // PLACES
        for at in np.split(np.arange(len(n)), np.flatnonzero(np.diff(turn)) + 1):
            which = np.repeat(at, n[at])
            pos = np.arange(len(which)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + lo[which]
            yield from numbered_draws(keys, which, pos, k)
