"""A blocked Bloom filter made and probed by DataFrame functions alone.

A key picks one 64-byte block and six bits in it.  The filter is a single row with an array of at
most ``max_blocks`` blocks, however many keys there are; with more than ``KEYS_PER_BLOCK`` keys a
block it only lets more false hits through, so whoever probes it must still join exactly.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_LONGS, HASHES, KEYS_PER_BLOCK, MAX_BLOCKS = 8, 6, 32, 1 << 14


def blocks_for(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-keys // KEYS_PER_BLOCK)))


def _place(key: Column, blocks: int) -> Column:
    """The block of a key, and the hash that its bits come from."""
    return F.struct(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.xxhash64(key, F.lit(17)).alias("bits"))


def _slots(place: Column) -> list[tuple[Column, Column]]:
    """(index of a long, bit in it) for each of the hashes of a key at ``place``."""
    every = [F.shiftrightunsigned(place["bits"], 9 * i).bitwiseAND(F.lit(64 * BLOCK_LONGS - 1)).cast("int") for i in range(HASHES)]
    return [((place["block"] * BLOCK_LONGS + F.shiftright(b, 6)).cast("int"), b.bitwiseAND(F.lit(63))) for b in every]


def build(df: DataFrame, key: str | Column, blocks: int) -> DataFrame:
    """One row with the array ``bloom`` of the keys of ``df``; a column gives their places itself."""
    placed = df.select((_place(F.col(key), blocks) if isinstance(key, str) else key).alias("place"))
    pairs = F.array(*[F.struct(s.alias("slot"), b.alias("bit")) for s, b in _slots(F.col("place"))])
    bits = placed.select(F.explode(pairs).alias("p")).select(F.col("p.slot").cast("long").alias("slot"), F.expr("shiftleft(1L, p.bit)").alias("bits"))
    every = df.sparkSession.range(blocks * BLOCK_LONGS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"))
    merged = bits.unionByName(every).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    return merged.agg(F.array_sort(F.collect_list(F.struct("slot", "bits"))).alias("all")).select(F.col("all.bits").alias("bloom"))


def filtered(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, listed_count: int, max_blocks: int = MAX_BLOCKS, keep: bool = True) -> DataFrame:
    """``rows`` whose ``key`` may be in ``listed``; those with a null key are not.  Without ``keep``, all others.

    The filter is made once, as the value of a session variable, which the plan holds as a literal.  The key, which may be a
    hash of a whole text, is computed once a row: an explode of one entry keeps it from being put into each of the tests.
    """
    spark, name = rows.sparkSession, f"bloom_{uuid.uuid4().hex}"
    blocks = blocks_for(listed_count, max_blocks)
    build(listed, listed_key, blocks).createOrReplaceTempView(name)
    spark.sql(f"declare or replace variable {name} array<bigint>")
    spark.sql(f"set var {name} = (select bloom from {name})")
    bits = F.expr(f"session.{name}")
    tests = [F.getbit(F.get(bits, slot), bit) == 1 for slot, bit in _slots(F.col("_place"))]
    placed = rows.select("*", F.explode(F.array(F.when(F.col(key).isNotNull(), _place(F.col(key), blocks)))).alias("_place"))
    hit = F.col("_place").isNotNull() & reduce(lambda a, b: a & b, tests)
    found = placed.where(hit if keep else ~F.coalesce(hit, F.lit(False))).select(*rows.columns)
    spark.sql(f"drop temporary variable {name}")
    spark.catalog.dropTempView(name)
    return found
