"""Whitening of embeddings on their leading principal components, by matrix-free block Lanczos.

The covariance is never formed: every step is one distributed pass that multiplies it with a thin block,
each task centring its rows and passing on (width x block) sums.  The basis is orthogonalised against
itself in full, twice a step; a block that loses rank (breakdown) goes on with new random directions
outside the basis; a basis of ``MOST`` columns restarts from its best Ritz vectors, whose products are
known.  Steps end when the residuals of the wanted vectors are ``TOLERANCE`` of the largest eigenvalue,
or when the basis spans all of space.  The driver holds (width x MOST) numbers, whatever the rows are.

Entries are whole numbers (``SCALE`` to 1, rounded down), so counts, sums and deviations are exact, and
the trace comes from the deviations: the sum of |n x - S|^2 over the fit list is n^3 times it.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do
those whose width is not the commonest (the least of equals); repeated rows are returned as often but
fitted once; a null id is an id like others; components without variance (fewer distinct vectors than
components, say) are left out, so a table of one vector has no rows, as has an empty one; equal
eigenvalues have any basis of their space; a component's largest entry is positive; extra columns are not
read.  A deviation beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written

COMPONENTS, SCALE, BLOCK, MOST, TOLERANCE, SEED = 4, 256, 8, 256, 1e-14, 20240607
#: Below this share of the largest eigenvalue a component has no variance but rounding.
NOISE = 1e-12


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x: ``vectors`` (vec_id, embedding) in whole numbers, those that take part."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0))
    widths = kept.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    first = widths.orderBy(F.desc("n"), "width").first()
    kept = kept.where(F.size("embedding") == first["width"]) if first else kept.where("false")
    return kept.select("vec_id", F.transform(c, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _gathered(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of ``part`` over batches of rows: summed in tasks, then by entry, so entries alone reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(_matrix(b))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["entry", "value"])

    rows = fit.mapInArrow(run, f"entry int, value {kind}").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["entry"]] = r["value"]
    return out


def orthonormal(w: np.ndarray, basis: np.ndarray, columns: int, floor: float, rng: np.random.Generator) -> np.ndarray:
    """Up to ``columns`` unit vectors outside ``basis``: those of ``w``, and random ones for what ``w`` lacks."""
    out = np.zeros((len(basis), 0))
    for source in (w, *(rng.standard_normal((len(basis), columns)) for _ in range(3))):
        need = columns - out.shape[1]
        if need <= 0:
            break
        known = np.concatenate((basis, out), axis=1)
        for _ in range(2):
            source = source - known @ (known.T @ source)
        u, s, _ = np.linalg.svd(source, full_matrices=False)
        u = u[:, s > floor][:, :need]
        u = u - known @ (known.T @ u)  # what scaling up left of the basis
        out = np.concatenate((out, np.linalg.qr(u)[0]), axis=1)
        floor = 1e-8
    return out


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = BLOCK, most: int = MOST, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors as columns, passes): the ``wanted`` largest of a symmetric map that ``times`` applies."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, width)
    block = min(width, max(block, wanted))
    most = max(most, wanted + 2 * block)
    basis = image = np.zeros((width, 0))
    q, passes = orthonormal(np.zeros((width, 0)), basis, block, 0.0, rng), 0
    while True:
        w = times(q)
        passes += 1
        basis, image = np.concatenate((basis, q), axis=1), np.concatenate((image, w), axis=1)
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        ritz, moved = basis @ y[:, :wanted], image @ y[:, :wanted]
        largest = max(float(e[0]), 0.0)
        residual = np.linalg.norm(moved - ritz * e[:wanted], axis=0)
        if basis.shape[1] >= width or (residual <= tolerance * largest).all():
            return e[:wanted], ritz / np.linalg.norm(ritz, axis=0), passes
        q = orthonormal(w, basis, min(block, width - basis.shape[1]), 1e-10 * largest, rng)
        if basis.shape[1] + q.shape[1] > most:  # restart: the best Ritz vectors and their products stay
            keep = wanted + block
            basis, image = basis @ y[:, :keep], image @ y[:, :keep]


@dataclass
class Whitener:
    """What whitens a vector: z = (x - sums / n) @ components / sqrt(values)."""

    n: int
    sums: np.ndarray  # of the fit list, whole numbers
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # unit eigenvectors, columns
    trace: float
    identity_error: float
    passes: int

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        kind = np.int64 if most * most * max(1, len(self.sums)) < 1 << 63 else object  # whole numbers of any size where 64 bits could run over
        away = x.astype(kind) * self.n - self.sums.astype(kind)
        return pa.array((away * away).sum(axis=1), pa.int64())

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.components / np.sqrt(self.values)


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fitted on the distinct vectors of ``rows`` (x); None if nothing varies."""
    fit = written(rows.select("x").distinct(), "fit")
    facts = _gathered(fit, lambda x: np.concatenate(([len(x)], x.sum(axis=0))), "long")
    if not len(facts):
        return None
    n, sums = int(facts[0]), facts[1:]
    width, mean = len(sums), sums / n

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _gathered(fit, part, "double").reshape(q.shape) / n

    values, vectors, passes = block_lanczos(times, width, components)
    varies = values > NOISE * max(values[0], 0)
    if not varies.any():
        return None
    values, vectors = values[varies], vectors[:, varies]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    found = Whitener(n, sums, values, vectors, 0.0, 0.0, passes)

    def spread(x: np.ndarray) -> np.ndarray:
        z = found.apply(x)
        return z.T @ z

    k = len(values)
    found.identity_error = float(np.abs(_gathered(fit, spread, "double").reshape(k, k) / n - np.eye(k)).max())
    total = _measured(fit.select(F.lit(0).alias("vec_id"), "x"), found).agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0]
    found.trace = float(total) / float(n) ** 3
    return found


def _measured(rows: DataFrame, w: Whitener) -> DataFrame:
    """vec_id, deviation, z of ``rows`` (vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                z = w.apply(x)
                bounds = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), w.deviations(x), pa.ListArray.from_arrays(pa.array(bounds), pa.array(z.ravel()))], ["vec_id", "deviation", "z"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, z array<double>")


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained (share of the variance), identity_error."""
    rows = whole(vectors, scale)
    w = fitted(rows, components)
    if w is None:
        none = F.lit(0.0)
        return rows.where("false").select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), none.alias("whitened"), none.alias("explained"), none.alias("identity_error"))
    shares = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
    each = _measured(rows, w).select("vec_id", "deviation", F.posexplode("z").alias("p", "whitened"))
    return each.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("p")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
