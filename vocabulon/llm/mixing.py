"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target divided by its size is how often each of its documents is wanted: so many whole
copies, and a fraction that is its inclusion probability.  The flight moves all probabilities of a
block along the null space of the two balancing constraints (documents and tokens), the longest
undecided document first and the others by what room they have, until no direction is left.  Blocks
are of bounded size and leave two documents undecided at most; those of a source's blocks meet in a
tree of further flights until one group a source is left.  Its last one or two documents, short
ones as a rule, are the landing: one draw decides both, so the source is off by less than one
document and by less than the longer of the two.  A source takes the same way whatever its size.

Rows that are equal in all that is looked at are one unit with a count: of so many rows a whole
number is taken for sure, and the fraction left is the unit's probability.  So a row that fills a
third of the table is one row here.  Every choice is drawn from a unit's own columns, so reruns
agree whatever the partitions.

Defined cases: null text has size 0, documents of size 0 are never taken; a null source is a source,
ordered last; repeated rows count and are taken each on its own; units of one size stand in the order
of a hash of their columns, so ties are settled alike in every run; a text of any length is counted
whole; extra columns, whatever their names, aren't looked at, and ``mixed`` returns them as they were;
empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import dropped, written

WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, FAN = 4096, 1024
#: So many equal rows come from one row of a table of counts.
CHUNK = 1000


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target): weights go to sources by code point, null last, repeating.

    Where a share exceeds ``most`` times the source, the excess is shared among the others by
    weight until none is above.  With sources by size over weight, the cut ones are the first few,
    and sums over those and the rest give each candidate level.  One row a source, so windows over
    all of them are small.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    named = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(named, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", most * F.col("source_size")).withColumn("bound", F.col("most") / F.col("weight"))
    order = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("bound").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    per = per.withColumn("weights", F.sum("weight").over(after)).withColumn("open", F.col("rest") / F.col("weights") <= F.col("bound"))
    first = F.min(F.when(F.col("open"), F.struct("bound", "rest", "weights"))).over(every)
    per = per.withColumn("level", first)
    target = F.when(F.col("bound") < F.col("level.bound"), F.col("most")).otherwise(F.col("weight") * F.col("level.rest") / F.col("level.weights"))
    return per.select("source", "source_size", "n", F.least(F.coalesce(target, F.lit(0.0)), F.col("most")).cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two of them are fractions; sums of p and of p * size stay.

    The direction lets the longest undecided unit that can move go by 1 and spreads what makes up for it over the others by their
    room p (1 - p): e - Q A' (A Q A')^-1 A e, which the constraints A map to 0.
    """
    p = p.astype(np.float64).copy()
    scale = size / max(1.0, float(size.mean())) if len(size) else size
    live = np.flatnonzero((p > 0) & (p < 1))
    live = live[np.argsort(-size[live], kind="stable")]
    lead = 0  # units before it can't move any more
    while lead < len(live):
        x, s = p[live], scale[live]
        q = x * (1 - x)
        s0, s1, s2 = q.sum(), (q * s).sum(), (q * s * s).sum()
        det = s0 * s2 - s1 * s1
        if det > 1e-12 * s0 * s2:
            u = -q * ((s2 - s1 * s[lead]) + (s0 * s[lead] - s1) * s) / det
        else:  # all of one size
            u = -q / s0
        u[lead] += 1
        if len(live) < 2 or u[lead] < 1e-7:
            lead += 1
            continue
        with np.errstate(divide="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, x / -u, np.inf)).min()
            down = np.where(u > 0, x / u, np.where(u < 0, (1 - x) / -u, np.inf)).min()
        x = x + (up if rng.random() * (up + down) < down else -down) * u
        x[x < 1e-9] = 0
        x[x > 1 - 1e-9] = 1
        p[live] = x
        live = live[(x > 0) & (x < 1)]
    return p


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whole decisions by one draw: as many as the probabilities' sum, rounded down or up."""
    ends = np.cumsum(p)
    draw = rng.random()
    return np.floor(ends - draw + 1) - np.floor(ends - p - draw + 1)


def taken(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The distinct rows of ``sized`` (doc_id, source, size, any others) with rows, source_size, target, whole, extra.

    Each of the ``rows`` equal rows is taken ``whole`` times, and ``extra`` of them once more.
    """
    columns = sized.columns
    units = written(sized.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")), "units")
    goals = written(targets(units, weights, most), "targets")
    rate = F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))
    wanted = F.col("rows") * (rate - F.floor(rate))
    some = F.col("size") > 0
    drawn = units.withColumn("key", F.xxhash64(*columns))
    rows = (
        drawn.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("whole", F.when(some, F.floor(rate)).otherwise(F.lit(0)).cast("long"))
        .withColumn("extra", F.when(some, F.floor(wanted)).otherwise(F.lit(0)).cast("long"))
        .withColumn("p", F.when(some, wanted - F.floor(wanted)).otherwise(F.lit(0.0)))
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit("cube")), F.ceil(F.col("n") / BLOCK))).drop("n")
    )
    schema, undecided = rows.schema, (F.col("p") > 0) & (F.col("p") < 1)

    def solve(level: int, last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "size", "doc_id"], kind="stable")
            rng = np.random.default_rng(zlib.crc32(f"{key[0]}|{key[1]}|{level}".encode()))
            p, at = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), rng), slice(None)
            if last:
                at = np.flatnonzero((p > 0) & (p < 1))
                p[at] = landing(p[at], rng)
            return pdf.assign(p=p)

        return run

    done, level = [rows.where(~undecided)], 0
    moved, blocks = rows.where(undecided), -(-(goals.agg(F.max("n")).first()[0] or 0) // BLOCK)
    while blocks > 1:
        moved = written(moved.groupBy("source", F.floor(F.col("block") / FAN**level).alias("_g")).applyInPandas(solve(level, False), schema), "flight")
        done.append(moved.where(~undecided))
        moved, blocks, level = moved.where(undecided), -(-blocks // FAN), level + 1
    out = moved.groupBy("source", F.lit(0).alias("_g")).applyInPandas(solve(level, True), schema)
    for d in done:
        out = out.unionByName(d)
    return written(out.select(*columns, "rows", "source_size", "target", "whole", (F.col("extra") + F.col("p").cast("long")).alias("extra")), "mix")


def _repeated(rows: DataFrame, count: str, number: str) -> DataFrame:
    """``rows`` as often as ``count`` says, up to CHUNK times, numbered from 0 on."""
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(number))


def _in_chunks(counted: DataFrame, count: str) -> DataFrame:
    """``counted`` cut into rows of at most CHUNK each: ``_from`` (the first's number) and ``_n``."""
    lo = F.col("_chunk") * CHUNK
    cut = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK))).alias("_chunk"))
    return cut.select(*counted.columns, lo.alias("_from"), F.least(F.lit(CHUNK).cast("long"), F.col(count) - lo).alias("_n"))


def per_row(mix: DataFrame) -> DataFrame:
    """``mix`` (of taken()) with a row for each row of the input, and how often that one is taken as ``copies``."""
    few, many = mix.where(f"rows <= {CHUNK}"), mix.where(f"rows > {CHUNK}")
    chunks = _in_chunks(few, "rows").unionByName(_in_chunks(many, "rows").repartition("_from"))
    more = (F.col("_from") + F.col("_i") < F.col("extra")).cast("long")
    return _repeated(chunks, "_n", "_i").select(*[c for c in mix.columns if c not in ("rows", "whole", "extra")], (F.col("whole") + more).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken.

    A row is known by 128 bits of all its columns.  Texts move once, equal rows as one, to meet their count.
    """
    row = F.md5(F.to_json(F.struct(*docs.columns))).alias("_row")
    mix = taken(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), row), weights, most)
    counts = written(mix.select("_row", (F.col("rows") * F.col("whole") + F.col("extra")).alias("copies")).where("copies > 0"), "copies")
    dropped(mix)
    once = docs.select(row, F.struct(*docs.columns).alias("doc")).groupBy("_row").agg(F.first("doc").alias("doc"))
    out = _repeated(once.join(counts.where(f"copies <= {CHUNK}"), "_row"), "copies", "_i").select("doc.*")
    many = counts.where(f"copies > {CHUNK}")
    if many.isEmpty():
        return out
    chunks = once.join(many, "_row").select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))).alias("_chunk"), "copies")
    spread = chunks.repartition("_chunk").withColumn("_n", F.least(F.lit(CHUNK).cast("long"), F.col("copies") - F.col("_chunk") * CHUNK))
    return out.unionByName(_repeated(spread, "_n", "_i").select("doc.*"))
