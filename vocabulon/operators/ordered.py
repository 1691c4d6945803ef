"""Running sums and ranks over one order of all rows, without a task that sees them all.

Rows are cut into blocks by ranges of a whole-number key.  Blocks are summed, the small table of
blocks gets its offsets in one window, and each block continues from its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _blocks(rows: DataFrame, key: str, width: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(key) / width))


def running(rows: DataFrame, key: str, value: Column, name: str, width: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to this one by ``key``, or before it."""
    cut = _blocks(rows.withColumn("_value", value), key, width)
    before = F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy("_block").agg(F.sum("_value").alias("_sum")).select("_block", before.alias("_before"))
    frame = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0).cast(cut.schema["_value"].dataType)
    total = F.coalesce("_before", zero) + F.coalesce(F.sum("_value").over(frame), zero)
    return cut.join(offsets, "_block").select(*rows.columns, total.alias(name))


def running_max(rows: DataFrame, key: str, value: str, name: str, lagged: str, width: int = BLOCK) -> DataFrame:
    """``rows`` with the largest ``value`` so far by ``key``, and the one before this row (null for the first)."""
    cut = _blocks(rows, key, width)
    before = F.max("_max").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy("_block").agg(F.max(value).alias("_max")).select("_block", before.alias("_before"))
    order = Window.partitionBy("_block").orderBy(key)
    so_far = F.greatest(F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_before")
    earlier = F.greatest(F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_before")
    return cut.join(offsets, "_block").select(*rows.columns, so_far.alias(name), earlier.alias(lagged))


def ranked(rows: DataFrame, group: str, key: Column, order: list[Column | str], name: str, width: int = BLOCK) -> DataFrame:
    """``rows`` with their place from 1 in their ``group`` by ``order``, whose leading whole number is ``key``.

    A group that holds a large share of all rows is cut by ranges of ``key``; only its blocks meet.
    """
    cut = rows.withColumn("_block", F.floor(key / width))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n")).select(group, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order))
    placed = cut.withColumn("_own", own)
    return placed.join(offsets, [group, "_block"]).select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
