"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes nearest Euclidean distance on the unit sphere: rows go into bands by their norm
(each ``BAND`` of the one above), a row x of a band with largest norm M becomes x / M and one more entry
that fills it up to length 1, a query q / |q| and 0 there; the order of a band's rows by distance is that of
their inner products.  Each of ``tables`` hash tables cuts the sphere by ``functions`` projections on Gaussian
directions into cells of one width.  A query visits, beside its own cell, the cells reached by moving some
coordinates over their nearest walls, in the order of the success that the distances to those walls promise, in
every band.  Rows meet the queries that probe their cell; a cell that holds many rows is dealt to several
tasks and its queries to all of them.  Each task reranks exactly and passes on the nearest ``k`` of each query,
which merge over cells and tables.

Width, functions, tables and probes are fitted on at most ``SAMPLE`` rows, of which ``SAMPLE_QUERIES`` ask for their
``k`` nearest among all rows of the table, by exact search: of the candidates in ``SHAPES`` the one that visits the
least at a recall of ``RECALL`` is taken.  All rows are indexed.  A query that has met fewer than ``k`` rows is
answered again by exact search over all rows, in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those whose width is not the commonest; a query's own rows (its id) are never its neighbours;
rows equal in id and vector count once; ties go to the smaller id; extra columns are not read; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written

SAMPLE, SAMPLE_QUERIES, RECALL, TABLES, SEED = 4096, 64, 0.95, 2, 20240301
#: Norms of a band to those of the one above; bands, the last of which has all that is shorter.
BAND, BANDS = 0.9, 12
#: (width in standard deviations of a projection, functions) that are tried, and the most probes of a table.
SHAPES, MOST_PROBES = ((2.0, 1), (2.0, 3), (2.0, 5), (2.0, 8), (2.0, 11), (1.0, 3), (1.0, 5)), 256
#: What a probe of a cell costs, in rows visited: the query travels there.
PROBE_ROWS = 4
SPLIT_ROWS, HELD_ROWS = 8000, 400_000


class Hashing:
    """The hash functions and how to probe them."""

    def __init__(self, dim: int, functions: int, tables: int, width: float, norm: float, probes: int = 1):
        rng = np.random.default_rng(SEED)
        self.dim, self.functions, self.tables, self.width, self.norm, self.probes = dim, functions, tables, width, norm, probes
        self.recall = self.visited = None  # of the sample's queries, and the share of rows they visit
        self.a = rng.standard_normal((TABLES, functions, dim + 1))
        self.shift = rng.random((TABLES, functions)) * width

    def bands(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each row, and the rows on the unit sphere."""
        length = np.sqrt((x * x).sum(axis=1))
        with np.errstate(divide="ignore"):
            band = np.clip(np.floor(np.log(length / self.norm) / np.log(BAND) + 1e-9), 0, BANDS - 1).astype(np.int64)
        y = x / (self.norm * BAND**band)[:, None]
        return band, np.concatenate((y, np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))[:, None]), axis=1)

    def place(self, sphere: np.ndarray, table: int) -> np.ndarray:
        return (sphere @ self.a[table].T + self.shift[table]) / self.width

    def cells(self, coordinates: np.ndarray) -> np.ndarray:
        """One number for each row of whole coordinates."""
        h = np.zeros(len(coordinates), np.uint64)
        with np.errstate(over="ignore"):
            for c in coordinates.T:
                h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def in_band(self, cells: np.ndarray, band: np.ndarray | int) -> np.ndarray:
        return self.cells(np.stack(np.broadcast_arrays(cells, band), axis=-1).reshape(-1, 2))

    def index(self, x: np.ndarray, table: int) -> np.ndarray:
        band, sphere = self.bands(x)
        return self.in_band(self.cells(np.floor(self.place(sphere, table)).astype(np.int64)), band)

    def visits(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each query the cells to visit in each band, the likeliest first.

        Moving coordinate i over a wall at distance d costs d^2; a set of moves costs their sum.
        Sets come in order of cost from a heap, each grown from the one before by shifting or
        adding the next costly move; no set moves a coordinate both ways.
        """
        p = self.place(np.concatenate((x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))), axis=1), table)
        base = np.floor(p).astype(np.int64)
        low = p - base
        costs = np.concatenate((low**2, (1 - low) ** 2), axis=1)
        order = np.argsort(costs, axis=1, kind="stable")
        m, out = self.functions, []
        for i in range(len(x)):
            o, cost = order[i], costs[i][order[i]]
            seen = [base[i]]
            heap = [(cost[0], (0,))] if m else []
            while heap and len(seen) < self.probes:
                c, moves = heappop(heap)
                last = moves[-1]
                if last + 1 < 2 * m:
                    heappush(heap, (c - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
                    heappush(heap, (c + cost[last + 1], (*moves, last + 1)))
                at = o[list(moves)] % m
                if len(set(at.tolist())) == len(at):
                    cell = base[i].copy()
                    cell[at] += np.where(o[list(moves)] < m, -1, 1)
                    seen.append(cell)
            out.append(self.cells(np.array(seen)))
        return out

    def probe(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each query the cells to visit, of all bands."""
        return [np.unique(np.concatenate([self.in_band(c, b) for b in range(BANDS)])) for c in self.visits(x, table)]


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of its ``k`` largest inner products, ties to the smaller id, its own id left out.

    A matrix product finds those that may be among them; each of these is summed alone, from first to
    last component, so equal vectors get equal scores wherever they are.
    """
    out = []
    for lo in range(0, len(q), 256):
        rough = q[lo : lo + 256] @ x.T
        rough[q_ids[lo : lo + 256, None] == x_ids[None, :]] = -np.inf  # however many rows have the query's id
        kk = min(k, rough.shape[1])
        floor = np.partition(rough, rough.shape[1] - kk, axis=1)[:, rough.shape[1] - kk] - 1e-9
        for i in range(len(rough)):
            at = np.flatnonzero(rough[i] >= floor[i] - 1e-9 * abs(floor[i]))
            at = at[x_ids[at] != q_ids[lo + i]]
            score = np.add.accumulate(x[at] * q[lo + i], axis=1)[:, -1]
            best = np.lexsort((x_ids[at], -score))[:k]
            out.append((x_ids[at][best], score[best]))
    return out


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part, in double precision."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull()).select("vec_id", x.alias("x")).where(F.coalesce(fine, F.lit(False)))


def fit(vectors: DataFrame, k: int) -> Hashing | None:
    """Hash functions for ``vectors`` (vec_id, x), fitted on at most SAMPLE rows drawn by hash and the nearest that SAMPLE_QUERIES of them have in the table."""
    facts = vectors.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("m"))
    facts = facts.orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return None
    n, dim, norm = facts["n"], facts["dim"], float(np.sqrt(facts["m"])) * (1 + 1e-12)
    keep = vectors.where(F.size("x") == dim)
    bound = int(min(1.0, 1.2 * SAMPLE / n) * (1 << 30))
    order = F.xxhash64("vec_id", F.lit(SEED))
    drawn = keep.where(F.pmod(order, F.lit(1 << 30)) < bound).orderBy(order, "vec_id", "x").limit(SAMPLE).collect()
    x = np.array([r["x"] for r in drawn]).reshape(-1, dim)
    asking = list({r["vec_id"]: r["x"] for r in drawn[:SAMPLE_QUERIES]}.items())
    asked = vectors.sparkSession.createDataFrame(asking, keep.select("vec_id", "x").schema)
    near = exact(keep, asked, dim, k, n).join(keep.withColumnRenamed("x", "near"), "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("near").alias("near")).collect()  # k rows a query of the sample, however many share an id
    place = {v: i for i, (v, _) in enumerate(asking)}
    of, true = np.array([place[r["query_id"]] for r in near], np.int64), np.array([r["near"] for r in near]).reshape(-1, dim)
    queries = np.array([v for _, v in asking]).reshape(-1, dim)
    plain = Hashing(dim, 1, 1, 1.0, norm)
    sphere = plain.bands(x)[1]
    spread = max(float(np.sqrt(sphere.var(axis=0).sum())), 1e-9)  # a projection's standard deviation
    deep = int(np.clip(np.round(np.log2(max(n, 2) / 1000)), 1, 24))
    best = None
    for width, functions in (*SHAPES, *[(2.0, deep)] * (deep > 11)):
        for h in _probed(Hashing(dim, functions, TABLES, width * spread, norm, MOST_PROBES), x, queries, of, true):
            cost = h.visited * n + PROBE_ROWS * h.probes * h.tables
            better = (h.recall >= RECALL, -cost) if h.recall >= RECALL else (False, h.recall)
            if best is None or better > best[0]:
                best = better, h
    return best[1]


def _probed(h: Hashing, x: np.ndarray, queries: np.ndarray, of: np.ndarray, true: np.ndarray) -> Iterator[Hashing]:
    """``h`` with one table and with all, each with the fewest probes that find RECALL of the ``true`` neighbours of the queries ``of``, or all."""
    found = np.full(len(true), h.probes)  # the probe that meets a neighbour first
    share = np.zeros(h.probes)
    for t in range(h.tables):
        (names, counts), target = np.unique(h.index(x, t), return_counts=True), h.index(true, t)
        band = h.bands(true)[0]
        for i, cells in enumerate(h.visits(queries, t)):
            own = np.flatnonzero(of == i)
            hits = h.in_band(np.repeat(cells, len(own)), np.tile(band[own], len(cells))).reshape(len(cells), -1) == target[own]
            found[own] = np.minimum(found[own], np.where(hits.any(axis=0), hits.argmax(axis=0), h.probes))
            every = np.stack([h.in_band(cells, b) for b in range(BANDS)], axis=1)
            at = np.minimum(np.searchsorted(names, every), len(names) - 1)
            rows = np.where(names[at] == every, counts[at], 0).sum(axis=1)
            share[: len(rows)] += rows / (len(x) * len(queries))
        recall = np.cumsum(np.bincount(found, minlength=h.probes + 1)[: h.probes]) / max(1, len(true))
        enough = np.flatnonzero(recall >= RECALL)
        probes = int(enough[0]) + 1 if len(enough) else h.probes
        out = Hashing(h.dim, h.functions, t + 1, h.width, h.norm, probes)
        out.recall, out.visited = float(recall[probes - 1]) if len(true) else 1.0, float(share[:probes].sum())
        yield out


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim)


def _best(groups: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """What each place finds, merged within the task before it is shuffled: ``k`` rows a query at most.

    A task that serves very many queries passes on what it holds in between, so its memory is bounded.
    """
    held: list[np.ndarray] = []
    rows = 0

    def merged() -> np.ndarray:
        every = np.concatenate(held)
        every = np.unique(every)
        every = every[np.lexsort((every["vec_id"], -every["score"], every["query_id"]))]
        first = np.flatnonzero(np.concatenate(([True], every["query_id"][1:] != every["query_id"][:-1])))
        place = np.arange(len(every)) - np.repeat(first, np.diff(np.concatenate((first, [len(every)]))))
        return every[place < k]

    def batch(part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c])) for c in part.dtype.names], list(part.dtype.names))

    kind = [("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64)]
    for b in _by_place(groups, dim, k):
        part = np.empty(b.num_rows, kind)
        for c, _ in kind:
            part[c] = b.column(c).to_numpy()
        held.append(part)
        rows += len(part)
        if rows > HELD_ROWS:
            held = [merged()]
            rows = len(held[0])
            if rows > HELD_ROWS // 2:
                yield batch(held[0])
                held, rows = [], 0
    if held:
        yield batch(merged())


def _by_place(groups: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by place, rows before queries, the nearest of each query in each place."""
    held: list[pa.Table] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        query = table.column("query").to_numpy()
        x = table.column("x").combine_chunks()
        x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(-1, dim)
        ids = table.column("vec_id").to_numpy()
        place = np.stack([table.column(c).to_numpy() for c in ("table", "cell", "part")])
        cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(ids)])), strict=True):
            q = query[lo:hi]
            if q.all() or not q.any():
                continue
            there, there_ids = x[lo:hi][~q], ids[lo:hi][~q]
            if (there_ids[1:] == there_ids[:-1]).any():
                named = np.concatenate((there_ids[:, None].astype(np.int64).view(np.float64), there), axis=1)
                once = np.sort(np.unique(named.view([("", named.dtype)] * named.shape[1]), return_index=True)[1])
                there, there_ids = there[once], there_ids[once]
            near = nearest(x[lo:hi][q], ids[lo:hi][q], there, there_ids, k)
            n = [len(a) for a, _ in near]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[lo:hi][q], n)), pa.array(np.concatenate([a for a, _ in near])), pa.array(np.concatenate([s for _, s in near]))],
                ["query_id", "vec_id", "score"],
            )

    for b in groups:  # a place goes on over batches: its rows are held until the next begins
        t = pa.Table.from_batches([b])
        place = np.stack([t.column(c).to_numpy() for c in ("table", "cell", "part")])
        new = np.flatnonzero((place != place[:, -1:]).any(axis=0))
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and not len(new):
            last = held[-1]
            same = all(last.column(c)[-1].as_py() == t.column(c)[0].as_py() for c in ("table", "cell", "part"))
            if not same:
                yield from solve(pa.concat_tables(held))
                held = []
            held.append(t)
            continue
        if cut:
            yield from solve(pa.concat_tables([*held, t.slice(0, cut)]))
            held = []
        held.append(t.slice(cut))
    if held:
        yield from solve(pa.concat_tables(held))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of (query_id, vec_id, score) for each query."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(rows: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """Nearest of each query in each place: both sides have (table, cell, part, vec_id, x)."""
    both = rows.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True)))
    dealt = both.repartition("table", "cell", "part").sortWithinPartitions("table", "cell", "part", "query", "vec_id")
    kind = rows.schema["vec_id"].dataType.simpleString()
    return dealt.mapInArrow(lambda it: _best(it, dim, k), f"query_id {kind}, vec_id {kind}, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, hashing: Hashing | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of ``vectors`` (vec_id, embedding) for ``queries`` (the same)."""
    rows, asked = clean(vectors), clean(queries)
    h = hashing or fit(rows, k)
    if h is None:
        none = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return none.where("false")
    dim = h.dim
    rows, asked = rows.where(F.size("x") == dim), asked.where(F.size("x") == dim)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, dim)
            for t in range(h.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(h.index(x, t)), b.column("vec_id"), b.column("x")], ["table", "cell", "vec_id", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                x = _vectors(b, dim)
                for t in range(h.tables):
                    cells = h.probe(x, t)
                    n = np.array([len(c) for c in cells])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(n.sum()), t, np.int32)), pa.array(np.concatenate(cells)), b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), n)))], ["table", "cell", "vec_id"]
                    )

    where = rows.mapInArrow(index, f"table int, cell long, vec_id {kind}, x array<double>")
    sizes = written(where.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).cast("int").alias("parts")), "cells")
    row_part = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col("parts")).cast("int")
    split = sizes.where("parts > 1")  # few: each holds SPLIT_ROWS rows or more
    indexed = where.join(split, ["table", "cell"], "left").withColumn("part", F.coalesce(row_part, F.lit(0))).select("table", "cell", "part", "vec_id", "x")
    probes = asked.mapInArrow(probe, f"table int, cell long, vec_id {kind}").join(sizes, ["table", "cell"])
    probes = probes.select("table", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id")
    probing = probes.join(asked, "vec_id").select("table", "cell", "part", "vec_id", "x")
    near = _met(indexed, probing, dim, k)
    # a row found in several tables is one
    found = written(_merged(near, k), "near")
    total = rows.distinct().count()
    short = asked.select("vec_id").join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "vec_id", "left_anti")
    short = written(short.distinct(), "short")
    if short.isEmpty():
        return found
    again = exact(rows, asked.join(short, "vec_id"), dim, k, total)
    return found.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(again)


def _merged(near: DataFrame, k: int) -> DataFrame:
    return _ranked(near.distinct(), k)


def exact(rows: DataFrame, asked: DataFrame, dim: int, k: int, total: int) -> DataFrame:
    """Exact search of ``asked`` against all ``rows`` (vec_id, x), in blocks of rows that every query visits."""
    parts = max(1, -(-total // SPLIT_ROWS))
    zero = [F.lit(0).alias("table"), F.lit(0).cast("long").alias("cell")]
    placed = rows.select(*zero, F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(parts)).cast("int").alias("part"), "vec_id", "x")
    visiting = asked.select(*zero, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "x")
    return _merged(_met(placed, visiting, dim, k), k)
