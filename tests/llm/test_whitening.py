"""Whitening against a dense decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocabulon.llm import whitening
from vocabulon.llm.ship import ship

KIND = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def dense(vectors):
    """n, S, mean, eigenvalues, eigenvectors, trace of the distinct whole vectors."""
    x = np.unique(np.floor(256 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64), axis=0)
    centred = x - x.mean(axis=0)
    v = centred.T @ centred / len(x)
    e, u = np.linalg.eigh(v)
    return len(x), x.sum(axis=0), x.mean(axis=0), e[::-1], u[:, ::-1], np.trace(v)


def compare(rows, vectors_by_id, components=4):
    n, s, mean, e, u, trace = dense(list(vectors_by_id.values()))
    whole = {k: np.floor(256 * np.asarray(v, np.float32).astype(np.float64)) for k, v in vectors_by_id.items()}
    signs = {}
    for r in rows:
        x, j = whole[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        want = (x - mean) @ u[:, j] / np.sqrt(e[j])
        sign = signs.setdefault(j, np.sign(want * r["whitened"]) if abs(want) > 1e-3 else None) or signs.pop(j, None)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8 and (sign is None or abs(want) < 1e-3 or sign == np.sign(want * r["whitened"]))
        assert r["explained"] == pytest.approx(e[j] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len(signs) == components


def test_components_equal_a_dense_decomposition(sp):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((500, 24)) * np.linspace(1, 0.2, 24) @ np.linalg.qr(rng.standard_normal((24, 24)))[0] * 0.2 + 0.3).astype(np.float32)
    x[100:300] = x[0]  # copies are fitted once
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    bad = [(900, None), (901, [None] * 24), (902, [float("nan")] * 24), (903, [float("inf")] + [0.0] * 23), (904, []), (905, [1.0, 2.0])]
    rows = [*vectors.items(), *bad, (7, vectors[7])]
    df = sp.createDataFrame(rows, KIND).withColumn("x", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = whitening.whitened(df).collect()
    assert len(got) == 4 * 501
    compare(got, vectors)


def test_few_vectors_have_few_components_and_none_no_rows(sp):
    two = {1: [0.5, 0.25, 0.0], 2: [0.25, 0.5, 1.0], 3: [0.5, 0.25, 0.0]}
    got = whitening.whitened(sp.createDataFrame(list(two.items()), KIND)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1)]
    compare(got, two, 1)
    assert whitening.whitened(sp.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], KIND)).collect() == []
    assert whitening.whitened(sp.createDataFrame([], KIND)).collect() == []


def test_negative_entries_are_rounded_down(sp):
    got = whitening.whole(sp.createDataFrame([(None, [-0.001, 0.0, -0.0, 0.00390625])], KIND)).first()
    assert got["vec_id"] is None and got["x"] == [-1, 0, 0, 1]


@pytest.mark.parametrize("case", ["breakdown", "restart", "equal", "wide"])
def test_lanczos_breaks_down_and_restarts(case):
    rng = np.random.default_rng(5)
    d = 300 if case == "wide" else 60
    u = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"breakdown": np.array([9.0, 4.0, 4.0, 1.0] + [0.0] * (d - 4)), "restart": np.linspace(2, 1, d), "equal": np.full(d, 3.0), "wide": 0.97 ** np.arange(d)}[case]
    a = (u * e) @ u.T
    values, vectors, passes = whitening.block_lanczos(lambda q: a @ q, d, 4, 8, 24 if case == "restart" else 160, 1e-13)
    assert np.allclose(values, np.sort(e)[::-1][:4], atol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-10) and np.abs(a @ vectors - vectors * values).max() < 1e-9
    assert passes <= (3 if case in ("breakdown", "equal") else 200)


def test_deviations_beyond_64_bits_are_not_wrapped():
    w = whitening.Whitener(3_000_000_000, np.array([0, 0]), np.ones(1), np.ones((2, 1)), 1.0, 0.0, 1)
    assert w.deviations(np.array([[1, 0]])).to_pylist() == [9 * 10**18]
    with pytest.raises((OverflowError, Exception)):
        w.deviations(np.array([[2, 0]]))
