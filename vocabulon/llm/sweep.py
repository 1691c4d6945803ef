"""How many intervals are open at every moment, and what they are worth: step functions merged in a tree.

1. Every task turns the intervals it happens to hold into compact step functions, one for each key and
   range of ``width`` moments: the moments at which something changes, and by how much.  A function has
   ``width`` steps at most, however many intervals it stands for.
2. The functions of one key and range are added in pairs, and their sums in pairs again, until each
   range has one function.  A hot key only fills its functions: it never meets in one place as rows.
3. A scan over the ranges' totals, by blocks of ranges and then over the blocks, carries what is open at
   a range's begin, the highest count before it and the first moment after it, and stitches the ranges.
   It sees a row for each key and range, never a step.

Defined cases: intervals with a null key or start, or an end not after the start, take no part; a null
end is never reached; a null amount is 0; repeated rows count as often; moments whose starts and ends
cancel out are no steps, so a key whose every moment cancels has no rows; extra columns are not read; an
empty table gives no rows.  Sums are whole numbers; Spark raises an error where one leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import dropped, written

#: Moments a range has (a week of minutes: long enough that a task's functions aren't crumbs, a fifth of a megabyte at most);
#: ranges a block of the carry scan has; events a task holds before it sums them up.
WIDTH, BLOCK, HELD = 10_080, 256, 500_000
_PART = "key long, range long, part long, at array<int>, n array<long>, amount array<long>"


def _summed(events: list[np.ndarray]) -> np.ndarray:
    """``events`` (key, moment, n, amount: a column each) with equal keys and moments added up, in order."""
    every = np.concatenate(events, axis=1)
    every = every[:, np.lexsort((every[1], every[0]))]
    new = np.ones(every.shape[1], bool)
    new[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return np.concatenate((every[:2, first], np.add.reduceat(every[2:], first, axis=1))) if len(first) else every


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values, kind))


def local_functions(intervals: DataFrame, width: int = WIDTH, total: int | None = None) -> DataFrame:
    """key, range, part, at, n, amount: the step functions of each task's own ``intervals`` (key, start, end, amount).

    With ``total``, every interval counts for that key too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, count = TaskContext.get().partitionId(), [], 0
        for b in batches:
            key, start, end, amount = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("key", "start", "end", "amount"))
            ends = ~b.column("end").is_null().to_numpy(zero_copy_only=False)
            one = np.ones(len(key), np.int64)
            events = np.concatenate((np.stack((key, start, one, amount)), np.stack((key, end, -one, -amount))[:, ends]), axis=1)
            if total is not None:
                events = np.concatenate((events, np.concatenate((np.full((1, events.shape[1]), total), events[1:]))), axis=1)
            held.append(events)
            count += events.shape[1]
            if count > HELD:
                held = [_summed(held)]
                count = held[0].shape[1] // 2  # grows with the moments there are, not with the rows
        if not held:
            return
        key, moment, n, amount = _summed(held)
        cut = moment // width
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cut[1:] != cut[:-1])))) if len(key) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[first]), pa.array(cut[first]), pa.array(np.full(len(first), part)), _lists(first, (moment - cut * width).astype(np.int32), pa.int32()), _lists(first, n, pa.int64()), _lists(first, amount, pa.int64())],
            ["key", "range", "part", "at", "n", "amount"],
        )

    taking = intervals.where(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    return taking.select(*[F.col(c).cast("long").alias(c) for c in ("key", "start", "end", "amount")]).mapInArrow(run, _PART)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all lists, and the row that each is of."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def added_in_pairs(functions: DataFrame) -> DataFrame:
    """One round of the tree: the functions of parts 2 p and 2 p + 1 of each key and range become part p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = b.column("both")
            entries = both.flatten()
            at, of = _flat(entries.field("at"))
            n, amount = entries.field("n").flatten().to_numpy(), entries.field("amount").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), both.value_lengths().to_numpy(zero_copy_only=False))[of]
            row, at, n, amount = _summed([np.stack((row, at, n, amount))])
            first = np.searchsorted(row, np.arange(b.num_rows))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "range", "part")), _lists(first, at.astype(np.int32), pa.int32()), _lists(first, n, pa.int64()), _lists(first, amount, pa.int64())], ["key", "range", "part", "at", "n", "amount"])

    pairs = functions.groupBy("key", "range", F.shiftright("part", 1).alias("part")).agg(F.collect_list(F.struct("at", "n", "amount")).alias("both"))
    return pairs.mapInArrow(run, _PART)


def _running(functions: DataFrame) -> DataFrame:
    """Each function without its empty steps as running sums from the range's begin, with the figures that the scan needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (at, of), (n, _), (amount, _) = (_flat(b.column(c)) for c in ("at", "n", "amount"))
            full = (n != 0) | (amount != 0)
            at, of, n, amount = at[full], of[full], n[full], amount[full]
            rows, first = np.unique(of, return_index=True)
            ends = np.append(first[1:], len(of))
            upto = []
            for x in (n, amount):
                sums = np.cumsum(x)
                upto.append(sums - np.repeat((sums - x)[first], ends - first))
            n, amount = upto
            high = np.concatenate([np.maximum.accumulate(n[lo:hi]) for lo, hi in zip(first, ends, strict=True)]) if len(rows) else n
            last = np.zeros(len(at), bool)
            last[ends - 1] = True
            after = pa.array(np.append(at[1:], 0)[: len(at)], pa.int32(), mask=last)
            kept = b.take(pa.array(rows))
            to = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), after)
            facts = [at[first].astype(np.int64), n[ends - 1], amount[ends - 1], np.maximum.reduceat(n, first) if len(rows) else n, np.maximum.reduceat(amount, first) if len(rows) else amount]
            yield pa.RecordBatch.from_arrays(
                [kept.column("key"), kept.column("range"), _lists(first, at, pa.int32()), to, _lists(first, n, pa.int64()), _lists(first, amount, pa.int64()), _lists(first, high, pa.int64()), *map(pa.array, facts)],
                ["key", "range", "at", "to", "n", "amount", "high", "first_at", "end_n", "end_amount", "most_n", "most_amount"],
            )

    lists = "at array<int>, to array<int>, n array<long>, amount array<long>, high array<long>"
    return functions.mapInArrow(run, f"key long, range long, {lists}, first_at long, end_n long, end_amount long, most_n long, most_amount long")


def _carried(facts: DataFrame, block: int, width: int) -> DataFrame:
    """key, range, n0 and amount0 (open at its begin), high0 (highest count before it), next (first moment after it), peak (of the key)."""
    zero, facts = F.lit(0).cast("long"), facts.withColumn("block", F.floor(F.col("range") / block))
    inside = Window.partitionBy("key", "block").orderBy("range")
    across = Window.partitionBy("key").orderBy("block")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w, c: F.coalesce(F.sum(c).over(before(w)), zero)
    own = facts.select("key", "block", "range", (F.col("range") * width + F.col("first_at")).alias("first"), "most_n", "most_amount", upto(inside, "end_n").alias("n1"), upto(inside, "end_amount").alias("amount1"), "end_n", "end_amount")
    blocks = own.groupBy("key", "block").agg(
        F.sum("end_n").alias("end_n"), F.sum("end_amount").alias("end_amount"), F.min("first").alias("first"),
        F.max(F.col("n1") + F.col("most_n")).alias("most_n"), F.max(F.col("amount1") + F.col("most_amount")).alias("most_amount"),
    )
    blocks = blocks.select("key", "block", upto(across, "end_n").alias("n2"), upto(across, "end_amount").alias("amount2"), "most_n", "most_amount", F.lead("first").over(across).alias("next2"))
    most = F.max(F.col("n2") + F.col("most_n"))
    whole = Window.partitionBy("key")
    blocks = blocks.select("key", "block", "n2", "amount2", "next2", F.coalesce(most.over(before(across)), zero).alias("high2"), F.max(F.col("amount2") + F.col("most_amount")).over(whole).alias("peak"))
    joined = own.hint("merge").join(blocks.hint("merge"), ["key", "block"])
    n0 = F.col("n1") + F.col("n2")
    high1 = F.max(n0 + F.col("most_n")).over(before(inside))
    return joined.select("key", "range", n0.alias("n0"), (F.col("amount1") + F.col("amount2")).alias("amount0"), F.greatest("high2", F.coalesce(high1, zero)).alias("high0"), F.coalesce(F.lead("first").over(inside), "next2").alias("next"), "peak")


def stepped(intervals: DataFrame, width: int = WIDTH, total: int | None = None, block: int = BLOCK) -> DataFrame:
    """key, since, until (null for the last), n_open, amount_open, high (largest n_open so far), is_peak (of amount_open).

    ``intervals`` has key, start (included), end (excluded, null: never) and amount, in whole moments.  A key has a row for each
    moment at which starts and ends together change what is open.
    """
    leaves = written(local_functions(intervals, width, total), "leaves")
    parts = leaves.agg(F.max("part").alias("last")).first()["last"]  # one number
    functions = leaves
    for _ in range(int(parts or 0).bit_length()):
        functions = added_in_pairs(functions)
    running = written(_running(functions), "running")
    dropped(leaves)
    carried = _carried(running.drop("at", "to", "n", "amount", "high"), block, width)
    steps = running.select("key", "range", F.arrays_zip("at", "to", "n", "amount", "high").alias("steps"))
    each = steps.hint("merge").join(carried.hint("merge"), ["key", "range"]).select("*", F.explode("steps").alias("s"))
    base = F.col("range") * width
    amount = F.col("amount0") + F.col("s.amount")
    return each.select(
        "key", (base + F.col("s.at")).alias("since"), F.coalesce(base + F.col("s.to"), "next").alias("until"), (F.col("n0") + F.col("s.n")).alias("n_open"),
        amount.alias("amount_open"), F.greatest("high0", F.col("n0") + F.col("s.high")).alias("high"), (amount == F.col("peak")).alias("is_peak"),
    )


# --- a shop's sales -------------------------------------------------------------------------------


def minutes(table: DataFrame, column: str) -> Column:
    """Whole minutes since 1970 of a timestamp column; one without a zone counts as UTC, whatever the session's zone is."""
    c = F.col(column)
    if table.schema[column].dataType.simpleString() == "timestamp_ntz":
        return F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return F.floor(F.unix_seconds(c) / 60)


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 7) -> DataFrame:
    """key (the client's nation, -1 without one), start, end (``days`` after the first shipment), amount (cents), in minutes.

    A client that is there several times counts by its smallest nation.  Totals that are null, infinite or no number are 0 cents.
    Sales meet their lines' minimum, one row a sale.  The clients' homes are written, so that both sides of the second join are
    plain exchanges: only then does Spark split a hot client's partition as it runs.
    """
    shipped = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.min(minutes(lines, "shipped_at")).alias("shipped"))
    homes = written(clients.where("client_id is not null").groupBy("client_id").agg(F.min("nation_id").alias("nation_id")), "homes")
    cents = F.floor(F.col("total") * 100 + 0.5)
    finite = F.col("total").isNotNull() & ~F.isnan("total") & (F.abs("total") < float("inf"))
    sold = sales.where("sold_at is not null").select("sale_id", "client_id", minutes(sales, "sold_at").alias("start"), F.when(finite, cents).otherwise(F.lit(0)).alias("amount"))
    ends = sold.join(shipped, "sale_id", "left").select("client_id", "start", (F.col("shipped") + 1440 * days).alias("end"), "amount").where("end is null or end > start")
    return ends.join(homes, "client_id", "left").select(F.coalesce("nation_id", F.lit(-1)).alias("key"), "start", "end", "amount")
