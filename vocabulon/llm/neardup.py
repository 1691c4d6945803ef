"""Near-duplicates by bottom-k sketches from one hash function.

1. Of each document's shingle set the ``K`` least hashes are kept.  Equal sets form a class, which one
   document stands for from here on.
2. Retained values are looked up by runs: ``RUN`` values that follow each other in the sketch.  Where
   two sets of similarity 0.8 differ they break their common values into runs, one of which has
   four values or more, by counting for whole sets of 16 values or more (two, for smaller ones),
   and for sketches that leave values out but for a chance of 0.8 ** K, 2e-8.  A run of four is met by
   chance so rarely that lists stay short however many documents share a word pair or a passage.
3. Each class meets the hub of its longest list and that of its shortest, the member that stands in the
   longest lists: a group of near-copies costs a row or two a document, not a pair of each two.
4. Classes that still share a list with another component keep a wider sketch of ``WIDE`` values, the
   whole set for most.  Its values are ordered by how rare they are and only the rarest are listed:
   two sets above the threshold share so many values that one of them is among the first few of
   both, by counting for whole sets and but for a chance of 1e-8 for longer ones.  How many are few
   depends on both sizes, so a value is listed for each size of partner by that size's own bound, and the
   sizes are part of the key that lists meet on: documents of one template whose common part stays under
   the threshold list their own words alone and never meet, however many they are.  Who is in one
   component with most of a list meets the others of it only.
5. Candidates meet in cells: every group is dealt into blocks of bounded size, and a text goes once
   to each pair of blocks that it has a candidate in, not once a pair.  There the bottom-k sketch
   of the union drops what is far below the threshold, and the full sets decide the rest.

Similarity is exact for every link: intersection and union of the full sets of distinct shingles,
by 64-bit hashes.

Defined cases: null text and texts without words have empty sets and link with nothing; with fewer
words than a shingle has, the whole sequence is the one shingle; rows with a null id stay alone;
rows that share an id are one document, linked with whatever any of them links with; a text of any
length is read whole, one at a time if it is longer than a slice; extra columns, whatever their names,
aren't looked at, and ``first_of_each`` returns them as they were; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textkernel as tk
from .components import components
from .durable import dropped, written

WORDS, SIMILARITY, K, WIDE = 5, 80, 80, 1000
RUN, SHORT_RUN, SHORT_SET, ANY_RUN = 4, 2, 19, 16
#: A block holds so many shingles or one document; a cell meets two blocks.
BLOCK_VALUES = 100_000
SHARE = 0.56
SIGN = np.uint64(1 << 63)
BLOOM_BLOCKS = 1 << 17


def shingles(w: tk.Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row, then hash."""
    h = w.hashes(tk.BYTE_TABLE_LOWER)
    n = w.n_words
    ok = tk.inside(w, words)
    rows, values = w.row[: len(ok)][ok], tk.windows(h, words)[ok]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):  # the whole sequence, whatever its length
        with np.errstate(over="ignore"):
            place = np.arange(len(h)) - w.first[w.row]
            part = np.bincount(w.row, minlength=len(n)) < words
            part = part[w.row]
            mixed = tk.mix(h + tk.mix(place.astype(np.uint64) + np.uint64(11)))[part]
            sums = np.zeros(len(n), np.uint64)
            np.add.at(sums, w.row[part], mixed)
        rows, values = np.concatenate((rows, short)), np.concatenate((values, tk.mix(sums[short])))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted hashes of its shingles) of every row."""
    for lo, hi, w in tk.slices(texts):
        rows, h = shingles(w, words)
        yield from enumerate(np.split(h, np.searchsorted(rows, np.arange(1, hi - lo))), lo)


def _least(h: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> pa.ListArray:
    """Lists of hashes with the sign bit flipped, so that signed order is the order in which the least were chosen."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((h[kept] ^ SIGN).view(np.int64)))


def sketches(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, t (hash of the text), n (size of its set), set1, set2 (128 bits of the set), sketch (its k least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in tk.slices(b.column("text")):
                n = hi - lo
                rows, h = shingles(w, words)
                size = np.bincount(rows, minlength=n)
                first = np.concatenate(([0], np.cumsum(size)))
                sums = np.zeros((2, n), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    with np.errstate(over="ignore"):
                        sums[0, full] = np.add.reduceat(tk.mix(h), first[full])
                        sums[1, full] = np.bitwise_xor.reduceat(tk.mix(h + np.uint64(5)), first[full])
                kept = np.arange(len(h)) - first[rows] < k
                bounds = np.concatenate(([0], np.cumsum(np.minimum(size, k))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi], b.column("t")[lo:hi], pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in sums), _least(h, bounds, kept)],
                    ["doc_id", "t", "n", "set1", "set2", "sketch"],
                )

    picked = docs.select("doc_id", _text_hash(), "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, t long, n long, set1 long, set2 long, sketch array<long>")


def _text_hash() -> Column:
    return F.xxhash64("text").alias("t")


def _class() -> Column:
    """64 bits of a set; two sets that agree in it meet in vain, never take each other's place."""
    return F.xxhash64("n", "set1", "set2").alias("cls")


def runs(sketched: DataFrame) -> DataFrame:
    """(run, cls) for each run of values in each sketch; equal sets have one ``cls``.

    Sets of up to SHORT_SET values have short runs, sets from ANY_RUN values on long ones, so two sets that
    may be linked have one kind in common.
    """

    def windows(width: int) -> str:
        values = ", ".join(f"sketch[i + {j}]" for j in range(width))
        return f"transform(sequence(0, size(sketch) - {width}), i -> xxhash64({values}))"

    none = "cast(array() as array<bigint>)"
    keys = F.expr(f"concat(if(n between {SHORT_RUN} and {SHORT_SET}, {windows(SHORT_RUN)}, {none}), if(n >= {ANY_RUN}, {windows(RUN)}, {none}))")
    return sketched.where("doc_id is not null and n > 0").select(F.explode(keys).alias("run"), _class())


def lists_of(sketched: DataFrame) -> DataFrame:
    """(run, cls, m): the members of the lists that hold two classes or more, and how many rows name the list."""
    posts = runs(sketched)
    bounds = posts.groupBy("run").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("m"))
    shared = written(bounds.where("lo < hi").select("run", "m"), "shared")
    possible = bloom.filtered(posts, "run", shared.withColumnRenamed("run", "listed"), "listed", shared.count(), BLOOM_BLOCKS)
    members = written(possible.distinct().join(shared, "run"), "members")
    dropped(shared)
    return members


def _hubs(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, rep, t, n, block) of the classes in lists, and (hub, cls, cell): whom each meets, and where.

    A class picks its longest and its shortest list.  Of those that pick a list the one that stands in the longest lists is
    the hub.  The blocks of a hub's classes hold BLOCK_VALUES shingles or so.
    """
    picks = members.groupBy("cls").agg(F.max(F.struct("m", "run")).alias("longest"), F.min(F.struct("m", "run")).alias("shortest"), F.sum("m").alias("reach"))
    picks = written(picks.select("cls", "reach", F.col("longest.run").alias("longest"), F.col("shortest.run").alias("shortest")), "picks")

    def met(pick: str) -> DataFrame:
        hub = picks.groupBy(pick).agg(F.max(F.struct("reach", "cls")).alias("h")).select(pick, F.col("h.cls").alias("hub"))
        return picks.join(hub, pick).select("cls", "hub", F.lit(pick == "longest").alias("first"))

    rows = met("longest").unionByName(met("shortest")).join(classes.select("cls", "rep", "t", "n"), "cls")
    rows = written(rows, "hubs")
    blocks = rows.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_VALUES).alias("blocks"))
    placed = rows.join(blocks, "hub").withColumn("block", F.xxhash64("hub", F.pmod(F.xxhash64("cls", F.lit(1)), "blocks")))
    own = written(placed.where("first").select("cls", "rep", "t", "n", "block"), "own")
    stars = placed.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"), F.xxhash64("hub", "block").alias("cell"))
    stars = written(stars.distinct(), "stars")
    dropped(picks, rows)
    return own, stars


def _texts_of(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` (cls, rep, t, any others) with the text of each class: rows that can't be wanted are dropped before they move."""
    wanted = listed.withColumnRenamed("rep", "doc_id")
    rows = bloom.filtered(docs.select("doc_id", _text_hash(), "text"), "doc_id", wanted.select(F.col("doc_id").alias("listed")), "listed", wanted.count(), BLOOM_BLOCKS)
    once = rows.groupBy("doc_id", "t").agg(F.first("text").alias("text"))  # a row that is there many times
    return once.join(wanted, ["doc_id", "t"]).drop("t").withColumnRenamed("doc_id", "rep")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: int, k: int) -> DataFrame:
    """(a, b): the nodes of those ``pairs`` (a, b, cell: classes and where they meet) whose full sets reach the similarity.

    ``texts`` has cls, node, text.  A cell's texts of ``a`` are held, which are a block's at most, and those of ``b`` stream by.
    """
    held = pairs.select("cell", F.col("a").alias("cls")).distinct().select("cell", "cls", F.lit(None).cast("array<bigint>").alias("others"))
    others = pairs.groupBy("cell", F.col("b").alias("cls")).agg(F.collect_set("a").alias("others"))
    rows = held.unionByName(others).join(texts.select("cls", "node", "text"), "cls")
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = None, _Cell(similarity, k)
        for b in batches:
            cells, cls, nodes, lists = b.column("cell").to_pylist(), b.column("cls").to_pylist(), b.column("node").to_pylist(), b.column("others")
            left, right = [], []
            for i, h in _sets(b.column("text"), words):
                if cells[i] != cell:
                    cell, own = cells[i], _Cell(similarity, k)
                if not lists[i].is_valid:
                    own.hold(cls[i], nodes[i], h)
                else:
                    for other in own.linked(lists[i].as_py(), h):
                        left.append(other)
                        right.append(nodes[i])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, b.column("node").type), pa.array(right, b.column("node").type)], ["a", "b"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", F.col("others").isNotNull())
    return dealt.select("cell", "cls", "node", "others", "text").mapInArrow(run, f"a {kind}, b {kind}").where("a <> b").distinct()


class _Cell:
    """The sets held in a cell, and which of them a set that passes links with."""

    def __init__(self, similarity: int, k: int):
        self.similarity, self.k = similarity, k
        self.at: dict[int, list[int]] = {}
        self.nodes: list = []
        self.sets: list[np.ndarray] = []
        self.flat = None

    def hold(self, cls: int, node, h: np.ndarray) -> None:
        self.at.setdefault(cls, []).append(len(self.sets))
        self.nodes.append(node)
        self.sets.append(h)
        self.flat = None

    def _settle(self) -> None:
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)))[:-1]
        self.flat = np.concatenate(self.sets)
        last = np.minimum(self.start + self.k, self.start + self.n) - 1
        #: Up to here a sketch knows all values of its set; everything, where the sketch is the set.
        self.known = np.where(self.n > self.k, self.flat[last], np.uint64(2**64 - 1))

    def _values(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` values of the held sets ``x``, and where each set's begin."""
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.start[x] - first, n)], first

    @staticmethod
    def _among(values: np.ndarray, h: np.ndarray) -> np.ndarray:
        return h[np.minimum(np.searchsorted(h, values), len(h) - 1)] == values

    def linked(self, others: list[int], h: np.ndarray) -> list:
        if self.flat is None:
            if not self.sets:
                return []
            self._settle()
        x = np.array([i for c in others for i in self.at.get(c, ())], np.int64)
        ny, s = len(h), self.similarity
        x = x[100 * np.minimum(self.n[x], ny) >= s * np.maximum(self.n[x], ny)]
        if not len(x):
            return []
        # union sketch: the values of both up to where both sketches know all
        size = np.minimum(self.n[x], self.k)
        values, first = self._values(x, size)
        upto = np.minimum(self.known[x], h[self.k - 1] if ny > self.k else np.uint64(2**64 - 1))
        under = values <= np.repeat(upto, size)
        common = np.add.reduceat(under & self._among(values, h[: self.k]), first, dtype=np.int64)
        union = np.add.reduceat(under, first, dtype=np.int64) + np.searchsorted(h[: self.k], upto, "right") - common
        x = x[common >= SHARE * union]
        if not len(x):
            return []
        values, first = self._values(x, self.n[x])
        common = np.add.reduceat(self._among(values, h), first, dtype=np.int64)
        return [self.nodes[i] for i in x[100 * common >= s * (self.n[x] + ny - common)]]


def _wide(texts: DataFrame, words: int) -> DataFrame:
    """cls, n, root, block, values (the WIDE least hashes) of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [h for _, h in _sets(b.column("text"), words)]
            short = [h[:WIDE] for h in sets]
            bounds = np.concatenate(([0], np.cumsum([len(h) for h in short], dtype=np.int64)))
            flat = np.concatenate(short) if short else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("cls"), pa.array([len(h) for h in sets], pa.int64()), b.column("node"), b.column("block"), _least(flat, bounds, slice(None))],
                ["cls", "n", "root", "block", "values"],
            )

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("cls", "node", "block", "text").mapInArrow(run, f"cls long, n long, root {kind}, block long, values array<long>")


#: Sets longer than WIDE count as one size up to this factor.
SIZE_STEP = 1.02


def _rare_posts(wide: DataFrame, similarity: int) -> DataFrame:
    """(v, cls, root, block, n, size, minor, longer, shorter): who lists a rare value, and for partners of which sizes.

    In one order of all values, rare ones first, two sets that share c values and have x and y share one of
    the first x - c + 1 and y - c + 1.  For whole sets c is the least overlap at the threshold; where one
    is longer than WIDE, c is what two wide sketches share but for a chance of 1e-8 (5.6 standard deviations).
    Values of one document alone only count: they stand before all others.

    c depends on both sizes, so a value is listed for each size that its list holds by that size's own c: ``longer``
    has the sizes of partners that are no longer, ``shorter`` of those that are no shorter.  Sets of one template whose common
    values stay under the threshold list their own values alone, and none of them is left here.
    """
    s = similarity / 100
    least = math.floor(WIDE * s - 5.6 * math.sqrt(WIDE * s * (1 - s)))
    few = f"least(n, {WIDE})"
    posts = wide.select("cls", F.explode("values").alias("v"))
    twice = posts.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = posts.join(twice, "v").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("l"))
    # the most that any partner can ask for: one as small as can be, or one longer than WIDE
    most = f"if(n <= {WIDE}, greatest(n - ceil({similarity} * n / 100), n - {least}), {WIDE} - {least}) + 1"
    size = f"if(n <= {WIDE}, n, least(n, cast(floor({WIDE} * pow({SIZE_STEP}, floor(ln(n / {WIDE}) / ln({SIZE_STEP})))) as bigint)))"
    listed = (
        ranked.join(wide.select("cls", "n", "root", "block"), "cls").withColumn("alone", F.expr(f"{few} - size(l)"))
        .withColumn("l", F.expr(f"slice(l, 1, greatest(0, {most} - alone))"))
        .select("cls", "n", "root", "block", "alone", F.posexplode("l").alias("p", "e"))
        .select(F.col("e.v").alias("v"), "cls", "n", "root", "block", F.expr("alone + p").alias("p"), F.expr(size).alias("size"))
    )
    listed = written(listed, "listed")
    per_root = listed.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"))
    lists = per_root.groupBy("v").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("v", F.col("m.root").alias("most"))
    lists = lists.join(listed.groupBy("v").agg(F.collect_set("size").alias("sizes")), "v")
    overlap = f"ceil({similarity} * (n + z) / {100 + similarity})"
    # a size above WIDE stands for those up to a step more
    longer = f"filter(sizes, z -> z <= size and 100 * z * {SIZE_STEP} + 100 >= {similarity} * n and p <= if(n <= {WIDE}, n - {overlap}, {WIDE} - {least}))"
    shorter = f"filter(sizes, z -> z >= size and 100 * n >= {similarity} * z and p <= if(z <= {WIDE}, n - {overlap}, {few} - {least}))"
    own = listed.join(lists, "v").select("v", "cls", "root", "block", "n", "size", F.expr("root <> most").alias("minor"), F.expr(longer).alias("longer"), F.expr(shorter).alias("shorter"))
    live = written(own.where("size(longer) > 0 or size(shorter) > 0"), "live")
    dropped(listed)
    return live


def _meetings(live: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of sides that meet on (v, size, other): who is the longer one, who the shorter; members of a list's largest component meet the others only."""

    def side(x: str, partners: str, own: str, other: str) -> DataFrame:
        rows = live.select(*[F.col(c).alias(c + x) for c in ("cls", "root", "block", "n", "minor")], "v", F.col("size").alias(own), F.explode(partners).alias(other))
        return rows

    a, b = side("a", "longer", "long", "short"), side("b", "shorter", "short", "long")
    return [(a.where("minora"), b), (a.where("not minora"), b.where("minorb"))]


def _rare_pairs(wide: DataFrame, similarity: int) -> DataFrame:
    """(a, b, cell): pairs of different components that share a value which is rare for both (``_rare_posts``)."""
    live = _rare_posts(wide, similarity)
    fits = F.expr(f"roota <> rootb and (na > nb or (na = nb and clsa > clsb)) and 100 * nb >= {similarity} * na")
    met = reduce(DataFrame.unionByName, [a.join(b, ["v", "long", "short"]).where(fits) for a, b in _meetings(live)])
    pairs = met.select(F.col("clsa").alias("a"), F.col("clsb").alias("b"), F.xxhash64("blocka", "blockb").alias("cell")).distinct()
    found = written(pairs, "pairs")
    dropped(live)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    sketched = written(sketches(docs, words, k), "sketches")
    key = ["n", "set1", "set2"]
    per_set = sketched.where("doc_id is not null and n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("r"))
    classes = written(per_set.select(_class(), *key, F.col("r.doc_id").alias("rep"), F.col("r.t").alias("t")), "classes")
    own = written(sketched.select("doc_id", *key).join(classes.select(*key, "rep"), key, "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "own")
    several = own.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    one_id = own.join(several, "doc_id").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct()
    members = lists_of(sketched)
    dropped(sketched)
    listed, stars = _hubs(members, classes)
    texts = written(_texts_of(docs, listed), "texts")
    links = _verified(stars, texts.withColumn("node", F.col("rep")), words, similarity, k)
    first = written(components(links.unionByName(one_id)), "roots")
    dropped(stars, listed)
    known = texts.select("cls", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "rep", F.coalesce("root", "rep").alias("node"))
    known = written(known, "known")
    open_ = members.join(known.select("cls", "node"), "cls").groupBy("run").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("run")
    live = members.join(open_, "run").select("cls").distinct()
    apart = written(texts.join(live, "cls", "left_semi").join(known, ["cls", "rep"]), "apart")
    dropped(members, texts)
    wide = written(_wide(apart, words), "wide")
    more = components(_verified(_rare_pairs(wide, similarity), apart, words, similarity, k))
    dropped(wide, apart)
    second = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    # a class in no list is its own root; one that the hub left alone may be linked by the second step only
    alone = known.select(F.col("rep").alias("node"), F.col("node").alias("root")).unionByName(first.select("node", "root")).distinct()
    whole = written(alone.join(second, "root", "left").select(F.col("node").alias("rep"), F.coalesce("top", "root").alias("component")), "components")
    dropped(known, first, classes)
    return own.join(whole, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def row_key() -> Column:
    """Sorts as the id does, for whole numbers from 0 on, null last, and tells texts of one id apart."""
    return F.concat(F.coalesce(F.lpad(F.hex("doc_id"), 16, "0"), F.lit("null")), F.lit("-"), F.md5(F.to_json(F.struct("doc_id", "text"))))


def first_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, k: int = K) -> DataFrame:
    """One document of each group, the first by id, with its own columns.

    Here each text is a document, also where several have one id or none; rows with one id and one text are one document, so
    one of them stays.  Only rows that are to go or are there several times move, and the few that the filter lets through with them.
    """
    found = written(near_duplicates(docs.select(row_key().alias("doc_id"), "text"), words, similarity, k), "groups")
    per_row = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    moved = written(per_row.where("rows > 1 or doc_id <> component_id").select(F.col("doc_id").alias("key"), (F.col("doc_id") == F.col("component_id")).alias("stays")), "moved")
    dropped(found)
    rows = docs.withColumn("_key", row_key())
    count = moved.count()
    listed = moved.select(F.col("key").alias("listed"))
    suspects = bloom.filtered(rows, "_key", listed, "listed", count, BLOOM_BLOCKS)
    clear = bloom.filtered(rows, "_key", listed, "listed", count, BLOOM_BLOCKS, keep=False)
    once = suspects.groupBy("_key").agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("doc"))
    stay = once.join(moved.where("not stays").withColumnRenamed("key", "_key"), "_key", "left_anti").select("doc.*")
    return clear.select(*docs.columns).unionByName(stay)
