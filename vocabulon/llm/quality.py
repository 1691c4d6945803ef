"""Quality rules with risk-controlled thresholds.

A document's severity is the first level of a fixed path of ever stricter cutoffs at which some
rule fires.  Per stratum, labelled good documents test the levels in that order (fixed-sequence
testing), each by the exact binomial bound: level j is valid while P(Bin(n, alpha) <= rejected)
<= delta / strata, that is, while the Clopper-Pearson upper bound of its false-rejection rate is at
most ``alpha``.  The Bonferroni division covers the strata, the fixed order covers the levels, so
with probability 1 - delta no stratum rejects more than ``alpha`` of its good documents.  Among
valid levels the one with the best catch of bad documents is used; a stratum with too few labels to
prove anything rejects nothing.

Defined cases: null text counts as empty; a null stratum is a stratum of its own; a document
with several label rows is good only if all say so; null labels are ignored; repeated document rows
each get their own row, and all copies of a text in a stratum are one trial; a text of any length is
read whole, one at a time if it is longer than a slice; extra columns, whatever their names, aren't
looked at, and ``passing`` returns them as they were; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .durable import dropped, written

ALPHA, DELTA, REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT = 0.03, 0.05, 8, 20, 30
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Cutoffs per rule from lenient to strict; a rule fires above its cutoff.
LEVELS = {
    "symbols_per_100_words": (250, 200, 150, 100, 70, 50, 35, 25, 20, 15, 10, 7, 5, 3, 1),
    "repeat_per_100_words": (90, 80, 70, 60, 55, 50, 45, 40, 36, 33, 30, 27, 24, 22, 20),
    "dup_lines_per_100_words": (60, 50, 40, 35, 30, 25, 22, 20, 18, 16, 14, 12, 10, 9, 8),
    "chars_per_10_words": (200, 180, 160, 150, 140, 130, 125, 120, 116, 113, 110, 107, 104, 102, 100),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base figures of every text, whole."""
    out: dict[str, list] = {k: [] for k in FEATURES}
    for lo, hi, w in tk.slices(texts):
        n = hi - lo
        salt = tk.mix(np.arange(1, n + 1, dtype=np.uint64))
        in_word = np.zeros(len(w.buf) + 1, np.int8)
        in_word[w.start] += 1
        np.subtract.at(in_word, w.end, 1)
        in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        out["n_words"].append(w.n_words)
        out["word_chars"].append(_per_row(in_word & ((w.buf & 0xC0) != 0x80), w.row_bytes))
        out["n_symbols"].append(_per_row(_SYMBOL[w.buf], w.row_bytes))
        # lines: between newlines and row ends; those with a word are compared as they are
        breaks = np.flatnonzero(w.buf == 10)
        start = np.sort(np.concatenate((w.row_bytes[:-1], breaks + 1)))
        end = np.sort(np.concatenate((breaks, w.row_bytes[1:])))
        row = np.repeat(np.arange(n), 1 + _per_row(w.buf == 10, w.row_bytes))
        worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end, row = start[worded], end[worded], row[worded]
        with np.errstate(over="ignore"):
            keys = tk.hash_spans(w.buf, start, end) + salt[row] if len(row) else np.zeros(0, np.uint64)
            _, first = np.unique(keys, return_index=True)
            later = np.ones(len(keys), bool)
            later[first] = False
            out["n_dup_lines"].append(np.bincount(row[later], minlength=n))
            ok = np.flatnonzero(tk.inside(w, REPEAT_WINDOW))
            h = tk.windows(w.hashes(), REPEAT_WINDOW)[ok] + salt[w.row[ok]] if len(ok) else np.zeros(0, np.uint64)
        at = ok[_repeated(h)]
        cover = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + REPEAT_WINDOW, 1)
        out["n_repeat_words"].append(np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=n))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def with_features(docs: DataFrame, row: dict[str, Column]) -> DataFrame:
    """The columns ``row`` (name: expression) and the base figures of each document's ``text``."""
    picked = docs.select(F.struct(*[c.alias(k) for k, c in row.items()]).alias("row"), F.col("text").alias("text"))
    schema = picked.select("row").schema
    for k in FEATURES:
        schema = schema.add(k, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(f[k]) for k in FEATURES)], ["row", *FEATURES])

    return picked.mapInArrow(run, schema).select("row.*", *FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def severity() -> Column:
    """First level (from 1) at which a rule fires; one more than the last if none does."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    value = {
        "symbols_per_100_words": 100 * F.col("n_symbols") / words,
        "repeat_per_100_words": 100 * F.col("n_repeat_words") / words,
        "dup_lines_per_100_words": 100 * F.col("n_dup_lines") / words,
        "chars_per_10_words": 10 * F.col("word_chars") / words,
    }
    last = len(next(iter(LEVELS.values()))) + 1
    per_rule = []
    for rule, cuts in LEVELS.items():
        found = F.lit(last)
        for j in range(len(cuts), 0, -1):
            found = F.when(value[rule] > cuts[j - 1], F.lit(j)).otherwise(found)
        per_rule.append(found)
    return F.least(*per_rule)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), by the regularised incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def choose_level(good: np.ndarray, bad: np.ndarray, strata: int, alpha: float, delta: float) -> int:
    """Of the counts of good and bad documents per severity, the level up to which to reject (0: none)."""
    n, best, chosen = int(good.sum()), 0.0, 0
    if n == 0:
        return 0
    for j in range(1, len(good)):
        rejected = int(good[:j].sum())
        if binomial_cdf(rejected, n, alpha) > delta / strata:
            break
        gain = bad[:j].sum() / max(1, bad.sum()) - 10 * rejected / n
        if gain > best + 1e-12:
            best, chosen = gain, j
    return chosen


def calibrate(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level) from features (doc_id, stratum, content, base figures) and labels (doc_id, quality).

    A trial is a distinct content of a stratum, good if no label of any of its copies says otherwise: copies aren't
    independent, and the bound is exact for independent trials only.  Only counts by stratum and severity leave the join,
    so it holds at any number of labels.
    """
    last = len(next(iter(LEVELS.values()))) + 1
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    copies = features.where(~base_failed()).select("doc_id", "stratum", "content", severity().alias("severity")).join(truth, "doc_id")
    trials = copies.groupBy("stratum", "content").agg(F.min("severity").alias("severity"), F.min("quality").alias("quality"))
    counts = written(
        trials.groupBy("stratum", "severity").agg(F.count_if(F.col("quality") >= 1).alias("good"), F.count_if(F.col("quality") < 1).alias("bad")),
        "severity",
    )
    strata = max(1, counts.select("stratum").distinct().count())

    def pick(key, pdf):
        import pandas as pd

        good, bad = np.zeros(last + 1), np.zeros(last + 1)
        np.add.at(good, pdf["severity"].to_numpy(), pdf["good"].to_numpy())
        np.add.at(bad, pdf["severity"].to_numpy(), pdf["bad"].to_numpy())
        return pd.DataFrame({"stratum": [key[0]], "level": [choose_level(good[1:], bad[1:], strata, alpha, delta)]})

    return counts.groupBy("stratum").applyInPandas(pick, "stratum string, level int")


def verdicts(features: DataFrame, levels: DataFrame) -> DataFrame:
    """``features`` with base_failed, severity and kept."""
    cut = levels.where("level > 0").select(F.col("stratum").alias("_stratum"), F.col("level").alias("_level"))
    return (
        features.withColumn("base_failed", base_failed()).withColumn("severity", severity())
        .join(cut, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("severity") > F.coalesce(F.col("_level"), F.lit(0))))
        .drop("_stratum", "_level")
    )


def trial_row() -> dict[str, Column]:
    """What thresholds are fitted on, beside the figures; null texts are one content."""
    return {"doc_id": F.col("doc_id"), "stratum": F.col("lang"), "content": F.xxhash64("text")}


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, stratum (its language), base figures, base_failed, severity, kept."""
    features = written(with_features(docs, trial_row()), "features")
    return verdicts(features, calibrate(features, labels, alpha, delta)).drop("content")


def passing(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass, with their own columns.

    Figures are computed twice, once for the thresholds and once beside the rows, which costs less
    than moving whole texts to join verdicts to them.
    """
    features = written(with_features(docs, trial_row()), "features")
    levels = written(calibrate(features, labels, alpha, delta), "levels")
    dropped(features)
    rows = with_features(docs, {"stratum": F.col("lang"), "doc": F.struct(*[F.col(c) for c in docs.columns])})
    return verdicts(rows, levels).where("kept").select("doc.*")
