"""Column functions: stable logistic functions, vector arithmetic, keyed uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 10.0


def clipped(x: Column, bound: float = CLIP) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def norm(a: Column) -> Column:
    """L2 norm, kept off zero."""
    return F.sqrt(dot(a, a)) + F.lit(1e-8)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def uniform(*key: Column | str | int) -> Column:
    """A draw in [0, 1) that depends on the key alone, so any engine and any partitioning agree on it."""
    return F.conv(F.substring(_digest(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def below(share: Column, *key: Column | str | int) -> Column:
    """``uniform`` < ``share``, told by the digest's text: a draw is its first eight digits, which as a number cost most of it."""
    bound = F.ceil(share * F.lit(4294967296.0))
    return (bound >= 4294967296) | (_digest(key) < F.lpad(F.lower(F.hex(bound)), 8, "0"))


def _digest(key: tuple[Column | str | int, ...]) -> Column:
    parts = [F.col(k) if isinstance(k, str) and not k.startswith("=") else F.lit(k[1:]) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def position_weight(dist: Column, power: float = 1.0) -> Column:
    return F.pow(dist.cast("double"), F.lit(-power))
