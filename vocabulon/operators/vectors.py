"""Embedding tables (id, vec): combining, blending, extending, centring, removing components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import add, as_double, norm, unit


def doubles(emb: DataFrame) -> DataFrame:
    return emb.select("id", as_double(F.col("vec")).alias("vec"))


def l2_normalized(emb: DataFrame) -> DataFrame:
    return doubles(emb).select("id", unit(F.col("vec")).alias("vec"))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two tables, id by id."""
    b = doubles(b).withColumnRenamed("vec", "other")
    return doubles(a).join(b, "id").select("id", add(F.col("vec"), F.col("other")).alias("vec"))


def blend(a: DataFrame, b: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * unit(a) + (1 - alpha) * unit(b), not normalised again."""
    b = l2_normalized(b).withColumnRenamed("vec", "other")
    mixed = F.zip_with("vec", "other", lambda x, y: alpha * x + (1 - alpha) * y)
    return l2_normalized(a).join(b, "id").select("id", mixed.alias("vec"))


def extend(short: DataFrame, full: DataFrame) -> DataFrame:
    """``short`` where it has the id, else the row of ``full`` brought to the mean norm of ``short``."""
    own = doubles(short).withColumnRenamed("vec", "own")
    mean = own.agg(F.avg(norm(F.col("own"))).alias("m")).scalar()
    rows = doubles(full).join(own, "id", "left").withColumn("mean", mean)
    scaled = F.transform(unit(F.col("vec")), lambda x: x * F.col("mean"))
    return rows.select("id", F.coalesce("own", scaled).alias("vec"))


def mean_vector(emb: DataFrame) -> DataFrame:
    """dim, mean over all rows."""
    return doubles(emb).select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def _gram(emb: DataFrame) -> DataFrame:
    """kind, r, c, x: sums of vectors (c = -1) and of their outer products, one block a partition before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        total = sums = None
        n = 0
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), np.float64)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
                sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
                n += len(x)
        if n:
            d = len(sums)
            r, c = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"r": np.concatenate((r, np.arange(d), [-1])), "c": np.concatenate((c, np.full(d, -1), [-1])), "x": np.concatenate((total.ravel(), sums, [float(n)]))})

    return doubles(emb).select("vec").mapInPandas(run, "r int, c int, x double").groupBy("r", "c").agg(F.sum("x").alias("x"))


def covariance(emb: DataFrame, centred: bool = True) -> DataFrame:
    """r, c, value: X'X / n of the rows, less their mean if ``centred``."""
    sums = _gram(emb)
    n = sums.where("r = -1").select("x").scalar()
    mean = sums.where("r >= 0 and c = -1").select("r", (F.col("x") / n).alias("m"))
    cells = sums.where("c >= 0").select("r", "c", (F.col("x") / n).alias("x"))
    if not centred:
        return cells.select("r", "c", F.col("x").alias("value"))
    return cells.join(mean, "r").join(mean.select(F.col("r").alias("c"), F.col("m").alias("mc")), "c").select("r", "c", (F.col("x") - F.col("m") * F.col("mc")).alias("value"))


def postprocess(emb: DataFrame, components: int = 2) -> DataFrame:
    """Unit rows, less their mean, less their projections on the ``components`` strongest directions.

    The driver sees one width x width matrix and the mean, whatever the number of rows.
    """
    rows = l2_normalized(emb)
    cells = covariance(rows).collect()
    if not cells:
        return rows
    d = 1 + max(r["r"] for r in cells)
    matrix = np.zeros((d, d))
    for r in cells:
        matrix[r["r"], r["c"]] = r["value"]
    mean = np.zeros(d)
    for r in mean_vector(rows).collect():
        mean[r["dim"]] = r["mean"]
    top = np.linalg.eigh((matrix + matrix.T) / 2)[1][:, d - components :] if components > 0 else np.zeros((d, 0))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), np.float64).reshape(-1, d) - mean
            x -= (x @ top) @ top.T
            yield pdf.assign(vec=list(x))

    return rows.mapInPandas(run, rows.schema)
