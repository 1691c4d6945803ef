"""Hand-worked cases of the embedding engine."""

import hashlib
import math
import os
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabulon.config import Settings
from vocabulon.functions import digests, scalars
from vocabulon.operators import analogy, cooc, negatives, pairs, sgns, svd, training, vectors, vocab
from vocabulon.plans import catalogue
from vocabulon.sources import corpus, questions, scratch, store

os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(spark, *sequences):
    rows = [(d, p, i) for d, s in enumerate(sequences) for p, i in enumerate(s)]
    return spark.createDataFrame(rows, "doc_id long, pos long, id long")


def words(spark, *rows):
    return spark.createDataFrame(rows, "id long, word string, cnt long")


def test_vocabulary_ties_in_first_seen_order(spark):
    got = vocab.build_vocab(corpus.tokens(docs(spark, "b a b a c")), 1).orderBy("id").collect()
    assert [(r["id"], r["word"], r["cnt"]) for r in got] == [(0, "b", 2), (1, "a", 2), (2, "c", 1)]


def test_unknown_words_close_up(spark):
    got = vocab.encode(corpus.tokens(docs(spark, "a x b")), words(spark, (0, "a", 1), (1, "b", 1))).orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in got] == [(0, 0), (1, 1)]


def test_keep_probability(spark):
    got = vocab.keep_probabilities(words(spark, (0, "a", 3), (1, "b", 1)), 0.1).orderBy("id").collect()
    assert got[0]["keep_prob"] == pytest.approx(0.49848171, abs=1e-8)
    assert got[1]["keep_prob"] == 1.0


def test_negative_table_fills_its_size(spark):
    got = vocab.negative_table(words(spark, (0, "a", 8), (1, "b", 1)), 10).orderBy("id").collect()
    assert [(r["lo"], r["hi"]) for r in got] == [(0, 8), (8, 10)]


def test_negative_table_shares_don_t_drift(spark):
    n = 3000  # a share's end is a half for every other word
    table = spark.range(n).select("id", F.lit("x").alias("word"), F.lit(16).cast("long").alias("cnt")).repartition(7)
    got = [r["hi"] for r in vocab.negative_table(table, n // 2, width=700).orderBy("id").collect()]
    assert got == [round((i + 1) / 2) for i in range(n)]


def test_cooccurrence_and_pmi(spark):
    cells = cooc.cooccurrence(ids(spark, [0, 1, 2, 0]), 2)
    got = {(r["i"], r["j"]): r["value"] for r in cells.collect()}
    assert got == {(0, 1): 1.5, (1, 0): 1.5, (0, 2): 1.5, (2, 0): 1.5, (1, 2): 1.0, (2, 1): 1.0}
    pmi = {(r["i"], r["j"]): r["value"] for r in cooc.sppmi(cells, 1.0).collect()}
    assert pmi[0, 1] == pytest.approx(0.470004, abs=1e-6)
    assert pmi[1, 2] == pytest.approx(0.246860, abs=1e-6)
    assert cooc.sppmi(cells, 15.0).count() == 0


def test_self_pair_counts_twice(spark):
    assert [r["value"] for r in cooc.cooccurrence(ids(spark, [0, 0]), 1).collect()] == [2.0]


def test_rare_words_take_up_positions(spark):
    got = cooc.cooccurrence(ids(spark, [0, 5, 1]), 2, top=2).collect()
    assert {(r["i"], r["j"], r["value"]) for r in got} == {(0, 1, 0.5), (1, 0, 0.5)}


def test_sampled_pairs_mirror_and_nearest_always_stay(spark):
    got = pairs.sampled(ids(spark, list(range(30))), 10).collect()
    kept = {(r["center"], r["context"]) for r in got}
    assert kept == {(b, a) for a, b in kept}
    assert all((i, i + 1) in kept for i in range(29))


def test_adaptive_window_limits(spark):
    v = words(spark, (0, "a", 100), (1, "b", 50), (2, "c", 1))
    got = pairs.adaptive(ids(spark, [0] * 40), v, 3, 15).collect()
    assert max(r["dist"] for r in got) <= 3


def test_results_do_not_depend_on_partitions(spark):
    rows = ids(spark, [i * 7 % 11 for i in range(200)], [i * 3 % 5 for i in range(100)])
    one = {tuple(r) for r in cooc.cooccurrence(rows.coalesce(1), 10).collect()}
    many = {tuple(r) for r in cooc.cooccurrence(rows.repartition(16), 10).collect()}
    assert one == many


def test_chunks_cross_documents_and_keep_the_tail(spark):
    lengths = spark.createDataFrame([(0, 7), (1, 5)], "doc_id long, n long")
    assert {tuple(r) for r in vocab.chunk_sizes(lengths, 5).select("chunk_id", "n").collect()} == {(0, 5), (1, 5), (2, 2)}
    assert vocab.chunk_sizes(lengths, 5, drop_tail=True).count() == 2


def test_question_parsing(spark):
    lines = ["a b c d", ": x", "A b c d", "a b c", "", ": y", "e f g h", ": x", "i j k l"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = {tuple(r) for r in questions.parse(df).collect()}
    assert got == {("x", 1, "i", "j", "k", "l"), ("y", 1, "e", "f", "g", "h")}


def test_stable_scalars(spark):
    x = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double")
    got = x.select(scalars.sigmoid(F.col("x")).alias("s"), scalars.log_sigmoid(F.col("x")).alias("l")).collect()
    assert [r["s"] for r in got] == [0.0, 0.5, 1.0]
    assert got[0]["l"] == -1000.0 and got[1]["l"] == pytest.approx(-math.log(2)) and got[2]["l"] == 0.0


def emb(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, vec array<float>")


def test_analogies_ties_unknown_words_and_excluded_answers(spark):
    e = emb(spark, [[1, 0], [0, 1], [1, 1], [0, 2], [0, 2]])
    w = spark.createDataFrame([(i, f"w{i}") for i in range(5)], "id long, word string")
    q = spark.createDataFrame([("s", 1, "w0", "w1", "w2", "w3"), ("s", 2, "w0", "w1", "w2", "w1"), ("s", 3, "w0", "w1", "w2", "no"), ("e", 1, "no", "w1", "w2", "w3")], "category string, qno long, a string, b string, c string, d string")
    j = analogy.judged(e, w, q)
    rows = {(r["category"], r["qno"]): r for r in j.collect()}
    assert rows["s", 1]["correct"] and rows["s", 1]["answer"] == "w3"  # w3 ties with w4
    assert not rows["s", 2]["correct"] and rows["s", 2]["answerable"]
    assert not rows["s", 3]["answerable"] and not rows["e", 1]["answerable"]
    by = {r["category"]: r for r in analogy.by_category(j, ("s",)).collect()}
    assert (by["s"]["correct"], by["s"]["total"], by["s"]["skipped"], by["s"]["accuracy"]) == (1, 2, 1, 0.5)
    assert by["e"]["accuracy"] == 0.0
    parts = {r["part"]: r["total"] for r in analogy.summary(j, ("s",)).collect()}
    assert parts == {"semantic": 2, "syntactic": 0, "overall": 2}
    assert analogy.neighbors(e, w, w.limit(1).select("word"), 50).count() == 4  # k beyond the vocabulary


def test_postprocessing_centres_and_removes(spark):
    m = np.random.default_rng(0).normal(size=(40, 6))
    none = np.array([r["vec"] for r in vectors.postprocess(emb(spark, m), 0).orderBy("id").collect()])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert np.allclose(none, unit - unit.mean(axis=0), atol=1e-6)
    two = np.array([r["vec"] for r in vectors.postprocess(emb(spark, m), 2).orderBy("id").collect()])
    assert np.linalg.matrix_rank(two, tol=1e-6) == 4


@pytest.mark.parametrize(("n", "grid"), [(30, 1), (2100, 2)])
def test_svd_matches_dense_and_holds_no_thin_matrix_on_the_driver(spark, monkeypatch, n, grid):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(n, 30)))[0]
    m = (basis * 0.5 ** np.arange(30)) @ basis.T
    if n > 100:  # sparse: what is large; symmetric still
        m[np.abs(m) < np.quantile(np.abs(m), 0.97)] = 0
    at = np.argwhere(m)
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in at], "i long, j long, value double").repartition(4)
    largest = []
    collect = type(cells).collect
    monkeypatch.setattr(type(cells), "collect", lambda df: largest.append(rows := collect(df)) or rows)
    u, s = svd.randomized_svd(cells, n, 5, power_iterations=3, oversample=10, grid=grid)
    monkeypatch.undo()
    assert all(len(rows) == 1 for rows in largest)  # triangular factors alone
    left, values, _ = np.linalg.svd(m)
    assert np.allclose(s, values[:5], rtol=1e-6)
    rows = {r["id"]: r["vec"] for r in u.collect()}
    got = np.array([rows[i] for i in range(n)])
    assert np.allclose(got.T @ got, np.eye(5), atol=1e-10) and np.allclose(np.abs((got * left[:, :5]).sum(axis=0)), 1, atol=1e-5)


def test_svd_of_a_table_of_less_rank_than_asked(spark):
    cells = spark.createDataFrame([(0, 0, 3.0), (1, 2, 2.0), (2, 1, 2.0)], "i long, j long, value double")
    u, s = svd.randomized_svd(cells, 40, 10, grid=2)
    assert np.allclose(s, [3, 2, 2], atol=1e-12) and u.count() == 40
    assert {r["id"]: np.round(np.abs(r["vec"]), 6).tolist() for r in u.collect()}[0][0] == 1.0


def batch(spark, rows):
    return spark.createDataFrame(rows, "row long, center long, pos long, negs array<long>, w double")


def test_gradients_against_finite_differences(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(size=(8, 4)), rng.normal(size=(8, 4))
    rows = [(0, 3, 5, [1, 1, 5], 1.0), (1, 3, 5, [2, 3, 0], 0.5), (2, 7, 1, [7, 6, 6], 1.0)]
    table = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>")

    def total(a, b):
        out = 0.0
        for _, c, p, negs, w in rows:
            out += w * np.logaddexp(0, -a[c] @ b[p]) + w * sum(np.logaddexp(0, a[c] @ b[n]) for n in negs)
        return out

    got = {(r["side"], r["id"], r["dim"]): r["grad"] for r in sgns.gradients(batch(spark, rows), table(a), table(b)).collect()}
    for side, m in (("in", a), ("out", b)):
        for i in range(8):
            for d in range(4):
                old = m[i, d]
                m[i, d] = old + 1e-5
                up = total(a, b)
                m[i, d] = old - 1e-5
                down = total(a, b)
                m[i, d] = old
                assert got.get((side, i, d), 0.0) == pytest.approx((up - down) / 2e-5, abs=1e-6)
    # the workers' kernel takes the same step
    w_in, w_out = a.copy(), b.copy()
    sgns.train_batch(w_in, w_out, np.array([3, 3, 7]), np.array([5, 5, 1]), np.array([[1, 1, 5], [2, 3, 0], [7, 6, 6]]), np.array([1.0, 0.5, 1.0]), 0.1)
    moved = {(r["side"], r["id"], r["dim"]): r["value"] for r in sgns.step(batch(spark, rows), table(a), table(b), 0.1).collect()}
    assert all(moved["in", i, d] == pytest.approx(w_in[i, d]) and moved["out", i, d] == pytest.approx(w_out[i, d]) for i in range(8) for d in range(4))


def test_extreme_dots_are_clipped_and_last_duplicate_wins(spark):
    table = lambda m: spark.createDataFrame([(i, r) for i, r in enumerate(m)], "id long, vec array<double>")
    rows = [(0, 0, 0, [1], 1.0), (1, 0, 1, [0], 1.0)]
    loss = sgns.loss(batch(spark, rows), table([[10.0]]), table([[5.0], [-5.0]])).first()
    assert loss["loss"] == pytest.approx((np.logaddexp(0, -10) + np.logaddexp(0, -10) + np.logaddexp(0, 10) + np.logaddexp(0, 10)) / 2)
    both = sgns.gradients(batch(spark, rows), table([[0.1]]), table([[0.2], [0.3]]), "last").where("side = 'in'").first()["grad"]
    x = lambda t: 1 / (1 + math.exp(-0.1 * t))
    assert both == pytest.approx((x(0.3) - 1) * 0.3 + x(0.2) * 0.2)


SMALL = Settings(embed_dim=8, epochs=4, min_count=1, subsample_t=1.0, window_size=3, batch_size=8)
TWELVE = " ".join(["a b c d e f", "g h i j k l"] * 300)


def vectors_of(df):
    return {r["id"]: r["vec"] for r in df.collect()}


@pytest.mark.parametrize("blocks", [1, 3])
def test_training_lowers_the_loss(spark, monkeypatch, blocks):
    monkeypatch.setattr(training, "LEAST_BATCH", 8)  # gradients of equal ids add up within a batch, so with twelve words batches must be small
    done = training.train(corpus.tokens(docs(spark, TWELVE, TWELVE)), SMALL, blocks=blocks, log_every=100)
    rows = done.history.orderBy("batch").collect()
    assert rows[-1]["loss"] < 0.8 * rows[0]["loss"] and sorted(vectors_of(done.w_in)) == sorted(vectors_of(done.w_out)) == list(range(12))
    assert [r["processed"] for r in rows] == sorted(r["processed"] for r in rows) and rows[-1]["processed"] == done.pairs
    assert {r["epoch"] for r in rows} == set(range(4)) and rows[-1]["lr"] < 0.01 < rows[0]["lr"]
    near = vectors_of(vectors.l2_normalized(done.w_in))
    same = [np.dot(near[i], near[j]) for i in range(12) for j in range(i) if i % 2 == j % 2]
    assert np.isfinite(same).all()


def test_training_does_not_depend_on_partitions_and_resumes_where_it_was_stopped(spark, tmp_path, monkeypatch):
    texts = [TWELVE[k : k + 700] for k in range(0, 2800, 350)]
    t = corpus.tokens(docs(spark, *texts))
    whole = training.train(t, SMALL, blocks=2)
    again = training.train(t.repartition(7), SMALL, blocks=2)
    assert vectors_of(again.w_in) == vectors_of(whole.w_in) and vectors_of(again.w_out) == vectors_of(whole.w_out)
    state, deal, dealt = f"file://{tmp_path}/state", training.dealt, []

    def killed(*args):
        dealt.append(args[3])
        if len(dealt) == 3:
            raise KeyboardInterrupt
        return deal(*args)

    monkeypatch.setattr(training, "dealt", killed)
    with pytest.raises(KeyboardInterrupt):
        training.train(t, SMALL, blocks=2, state=state)
    resumed = training.train(t, SMALL, blocks=2, state=state)
    assert dealt == [0, 1, 2, 2, 3]  # what was committed isn't trained again
    assert vectors_of(resumed.w_in) == vectors_of(whole.w_in) and vectors_of(resumed.w_out) == vectors_of(whole.w_out)
    assert [tuple(r) for r in resumed.history.collect()] == [tuple(r) for r in whole.history.collect()]
    finished = training.train(t, SMALL, blocks=2, state=state)
    assert len(dealt) == 5 and vectors_of(finished.w_in) == vectors_of(whole.w_in)
    with pytest.raises(ValueError, match="other settings"):
        training.train(t, SMALL.with_(window_size=2), blocks=2, state=state)


def test_training_goes_on_from_a_model(spark):
    t = corpus.tokens(docs(spark, TWELVE))
    first = training.train(t, SMALL.with_(epochs=1), blocks=2)
    start = (first.w_in.where("id <> 3"), first.w_out)
    none = training.train(t, SMALL.with_(epochs=0), blocks=2, start=start)
    got, old = vectors_of(none.w_in), vectors_of(first.w_in)
    assert {k: v for k, v in got.items() if k != 3} == {k: v for k, v in old.items() if k != 3} and got[3] != old[3] and none.pairs == 0
    assert vectors_of(none.w_out) == vectors_of(first.w_out)
    more = training.train(t, SMALL.with_(epochs=1), blocks=2, start=start)
    assert more.history.first()["loss"] < first.history.first()["loss"]


def test_training_holds_a_block_in_a_task_and_none_on_the_driver(spark, monkeypatch):
    """With blocks of 256 bytes, twelve words of eight dimensions need two; the driver gets counts and notes of losses alone."""
    monkeypatch.setattr(training, "BLOCK_BYTES", 256)
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(df.columns) or collect(df))
    monkeypatch.setattr(SparkContext, "broadcast", lambda *a: pytest.fail("a broadcast"))
    weights = training.initial_weights
    cut = []
    monkeypatch.setattr(training, "initial_weights", lambda v, s, blocks, start: cut.append(blocks) or weights(v, s, blocks, start))
    done = training.train(corpus.tokens(docs(spark, TWELVE)), SMALL.with_(epochs=1))
    assert cut == [2] and {tuple(c) for c in seen} <= {("rotation", "n"), ("a",)}
    monkeypatch.undo()
    assert done.w_in.count() == 12


def test_training_reports_as_it_goes_and_weighs_by_distance(spark):
    t = corpus.tokens(docs(spark, "a b c d " * 40))
    seen = []
    s = Settings(embed_dim=4, epochs=5, min_count=1, subsample_t=1.0, window_size=2, batch_size=16)
    done = training.train(t, s, lambda epoch, emb: seen.append((epoch, emb.count())), log_every=3)
    assert seen == [(5, 4)] and done.history.count() > 5
    for more in ({"use_position_weights": True}, {"use_afws": True}):
        assert training.train(t, s.with_(epochs=1, **more)).pairs > 0
    nothing = training.train(t.where("false"), s)
    assert nothing.w_in.count() == 0 and nothing.pairs == 0 and nothing.history.count() == 0


def test_pairs_of_long_documents_are_those_of_the_whole(monkeypatch):
    ids, counts = np.arange(1000) % 37, np.full(1000, 5)
    s = Settings(window_size=4, subsample_t=1e9)
    sure = type("Sure", (), {"random": staticmethod(np.zeros), "permutation": staticmethod(np.arange)})()
    whole = np.concatenate(list(training.pairs_of(ids, counts, s, 1.0, 5.0, sure)), axis=1)
    monkeypatch.setattr(training, "SEGMENT", 90)
    parts = np.concatenate(list(training.pairs_of(ids, counts, s, 1.0, 5.0, sure)), axis=1)
    assert whole.shape == parts.shape == (3, 2 * sum(1000 - d for d in range(1, 5))) and sorted(map(tuple, whole.T)) == sorted(map(tuple, parts.T))


def test_ordered_sums_do_not_depend_on_blocks(spark):
    from vocabulon.operators import ordered

    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(k), int(v)) for k, v in zip(rng.permutation(400)[:150], rng.integers(0, 50, 150), strict=True)], "k long, v long")
    at = sorted((r["k"], r["v"]) for r in rows.collect())
    for width in (7, 100, 1 << 16):
        got = {r["k"]: r["s"] for r in ordered.running(rows, "k", F.col("v"), "s", width).collect()}
        before = {r["k"]: r["s"] for r in ordered.running(rows, "k", F.col("v"), "s", width, inclusive=False).collect()}
        top = {r["k"]: (r["m"], r["l"]) for r in ordered.running_max(rows, "k", "v", "m", "l", width).collect()}
        rank = {r["k"]: r["r"] for r in ordered.ranked(rows.withColumn("g", F.col("v") % 3), "g", F.col("k"), ["k"], "r", width).collect()}
        for i, (k, v) in enumerate(at):
            assert got[k] == sum(x for _, x in at[: i + 1]) and before[k] == got[k] - v
            assert top[k] == (max(x for _, x in at[: i + 1]), max((x for _, x in at[:i]), default=None))
            assert rank[k] == sum(x % 3 == v % 3 for _, x in at[: i + 1])
    t = corpus.tokens(docs(spark, *[f"w{i} w{(i * 7) % 20} x" for i in range(30)]))
    vocabularies = [{tuple(r) for r in vocab.build_vocab(t, 1, width).collect()} for width in (1, 4, 1 << 16)]
    assert vocabularies[0] == vocabularies[1] == vocabularies[2]
    slots = [{tuple(r) for r in vocab.negative_table(vocab.build_vocab(t, 1), 1000, width=w).collect()} for w in (3, 1 << 16)]
    assert slots[0] == slots[1]


def test_chunks_of_one_stream_are_read_like_documents(spark):
    rows = ids(spark, [0, 1, 2], [3, 4, 5, 6], [7])
    got = sorted((r["doc_id"], r["pos"], r["id"]) for r in vocab.chunked(rows, 3, width=2).collect())
    assert got == [(i // 3, i % 3, i) for i in range(8)]
    assert vocab.chunked(rows, 3, drop_tail=True).count() == 6
    assert cooc.cooccurrence(vocab.chunked(rows, 8), 1).count() == 14


@pytest.mark.parametrize(("dense", "held", "stretch"), [(1024, 4_000_000, 16), (3, 50, 2)])
def test_cells_equal_brute_force_however_they_are_held(spark, dense, held, stretch):
    rng = np.random.default_rng(0)
    docs_ = [rng.integers(0, 25, n).tolist() for n in (0, 1, 40, 7, 300, 2)]
    rows = [(d, 2 * p + d, i) for d, s in enumerate(docs_) for p, i in enumerate(s)]  # places with gaps
    table = spark.createDataFrame(rows, "doc_id long, pos long, id long").repartition(5)
    for window, weighted, top in ((10, True, None), (3, False, 11), (4, True, 11)):
        want = {}
        for s in docs_:
            for p, a in enumerate(s):
                for k in range(1, window + 1):
                    if p + k < len(s) and (top is None or max(a, s[p + k]) < top):
                        for x, y in ((a, s[p + k]), (s[p + k], a)):
                            want[x, y] = want.get((x, y), 0) + (1 / k if weighted else 1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        unit = cooc.unit_of(window, weighted)
        half = cooc.counted_pairs(table, window, weighted, top, dense, held, stretch)
        got = {(r["i"], r["j"]): r["value"] for r in cooc.mirrored(cooc._values(half, unit), "value").collect()}
        sums = {r["i"]: (r["total"], r["n_cells"]) for r in cooc.marginals_of_pairs(half, unit).collect()}
        plain = {r["i"]: (r["total"], r["n_cells"]) for r in cooc.marginals(cooc.cooccurrence(table, window, weighted, top)).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {k: pytest.approx(v) for k, v in want.items()}
        assert sums == {k: (pytest.approx(t), n) for k, (t, n) in plain.items()}
    a = {(r["i"], r["j"]): r["value"] for r in cooc.sppmi(cooc.cooccurrence(table, 4), 1.0).collect()}
    b = {(r["i"], r["j"]): r["value"] for r in cooc.associations(table, 4, 1.0).collect()}
    assert a and b == {k: pytest.approx(v, abs=1e-12) for k, v in a.items()}


def test_unknown_words_of_examples_are_said_to_be(spark):
    emb = spark.createDataFrame([(i, v) for i, v in enumerate(([1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.5, 1.0]))], "id long, vec array<double>")
    w = spark.createDataFrame(list(enumerate("abcd")), "id long, word string")
    asked = spark.createDataFrame([("x", 1, "a", "b", "c", "d"), ("x", 2, "a", "zz", "c", "d"), ("x", 3, "a", "b", "c", "zz")], "category string, qno long, a string, b string, c string, d string")
    got = {(r["qno"], r["rank"]): (r["answer"], r["score"]) for r in analogy.examples(emb, w, asked, 5).collect()}
    assert got[2, 1] == ("OOV", 0.0) and got[1, 1][0] == got[3, 1][0] == "d" and len(got) == 3


def test_blocks_meet_however_many_partitions_there_are(spark, monkeypatch):
    """Without partitions that are merged as they are small, keys of both sides must hash alike."""
    from vocabulon.operators import grid, scoring

    monkeypatch.setattr(scoring, "LEAST_BLOCK", 20)
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 7)
    x = np.random.default_rng(1).normal(size=(90, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = rows.where("id < 30").select(F.col("id").alias("qid"), "vec", F.array("id").alias("banned"))
    words = spark.createDataFrame([(i, f"w{i}") for i in range(90)], "id long, word string")
    asked = spark.createDataFrame([("family", q, f"w{q}", f"w{q + 1}", f"w{q + 2}", f"w{q + 3}") for q in range(40)], "category string, qno long, a string, b string, c string, d string")
    best = analogy.answers(rows, words, asked).select("category", "qno", F.col("answer").alias("d"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for found in (scoring.top_k(rows, queries, 4), scoring.pruned_top_k(rows, queries, 4, 5).found):
            got = {}
            for r in found.orderBy("qid", "rank").collect():
                got.setdefault(r["qid"], []).append(r["id"])
            assert got == {q: [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:4] for q in range(30)}
        scores = grid.scores(rows, rows.limit(50), np.ones(5), [grid.Mix("one", 1.0)], words, asked.drop("d").join(best, ["category", "qno"])).first()
        assert scores["sem_raw"] == 1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_top_k_with_pruning_is_exact_and_skips_most_of_clustered_rows(spark):
    from vocabulon.operators import scoring

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 12))
    x[:5] = x[7]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    queries = rows.where("id % 15 = 0 or id < 8").select(F.col("id").alias("qid"), "vec", F.array("id").alias("banned"))
    want = [tuple(r) for r in scoring.top_k(rows, queries, 6).orderBy("qid", "rank").collect()]
    for cells in (1, 60):
        got = scoring.pruned_top_k(rows, queries, 6, cells)
        assert [tuple(r) for r in got.found.orderBy("qid", "rank").collect()] == want
    assert got.visits < 0.3 * got.meetings, (got.visits, got.meetings)
    few = rows.where("id < 4")  # fewer rows than are asked for
    assert [tuple(r) for r in scoring.pruned_top_k(few, queries, 6, 3).found.orderBy("qid", "rank").collect()] == [tuple(r) for r in scoring.top_k(few, queries, 6).orderBy("qid", "rank").collect()]
    assert scoring.pruned_top_k(rows.where("false"), queries, 6).found.count() == 0


def test_words_are_cut_at_unicode_white_space(spark):
    text = "a\u0085b\u00a0c\u2003d\u3000e\x1cf\tg\u200bh"
    got = [r["word"] for r in corpus.tokens(docs(spark, text)).orderBy("pos").collect()]
    assert got == text.split()


def test_moving_average_of_losses(spark):
    loss = np.random.default_rng(3).random(170)
    history = spark.createDataFrame([(3 * i, float(x)) for i, x in enumerate(loss)], "batch long, loss double")
    got = {r["batch"]: r["smooth"] for r in sgns.smoothed(history, 16).collect()}
    assert got == {3 * i: pytest.approx(loss[i : i + 2].mean()) for i in range(169)}
    assert sgns.smoothed(history.limit(50)).count() == 0


def test_experiments(spark, tmp_path):
    from vocabulon.operators import experiments
    from vocabulon.sources import plots

    t = corpus.tokens(docs(spark, " ".join(["a b c d e f", "g h i j k l"] * 60)))
    asked = spark.createDataFrame([("family", 1, "a", "b", "c", "d"), ("other", 1, "e", "f", "g", "h"), ("other", 2, "a", "zz", "c", "d")], "category string, qno long, a string, b string, c string, d string")
    s = Settings(embed_dim=6, epochs=5, min_count=1, subsample_t=1.0, neg_table_size=1000, window_size=3, batch_size=8)
    contest = experiments.baseline_and_adaptive(t, asked, s, 2, log_every=10)
    rows = contest.scores.collect()
    assert {(r["model"], r["weights"]) for r in rows} == {(m, w) for m in ("baseline", "adaptive") for w in ("in", "in+out")}
    assert all(sum(r["chosen"] for r in rows if r["model"] == m) == 1 for m in ("baseline", "adaptive"))
    for m in ("baseline", "adaptive"):
        best = max((r for r in rows if r["model"] == m), key=lambda r: (r["semantic"], r["weights"] == "in"))
        assert best["chosen"]
    assert [(r["model"], r["epoch"]) for r in contest.checks.collect()] == [("baseline", 5)]
    words = vocab.build_vocab(t, 1).select("id", "word")
    table = experiments.comparison([("one", contest.baseline.w_in), ("two", contest.adaptive.w_in)], words, asked, components=1)
    got = table.orderBy("config_no").collect()
    assert [r["chosen"] for r in got].count(True) == 1 and next(r for r in got if r["chosen"])["sem_pp"] == max(r["sem_pp"] for r in got)
    raw = experiments.scores(contest.adaptive.w_in, words, asked).first()
    assert (got[1]["sem_raw"], got[1]["syn_raw"]) == (raw["semantic"], raw["syntactic"])
    lines = [r["text"].split("\t") for r in experiments.table_lines(table).orderBy("line").collect()]
    assert [x[0] for x in lines] == ["model", "one", "two"] and [x[1] for x in lines[1:]] == [f"{100 * r['sem_raw']:.1f}" for r in got] and sum(x[-1] == "chosen" for x in lines) == 1
    charts = plots.training_plots(contest.curves.where("model = 'baseline'"))
    assert charts["loss"].count("<polyline") >= 1 and "<svg" in plots.comparison_plot(contest.curves)
    store.save_text(spark, charts["loss"], f"file://{tmp_path}/loss.svg")
    assert spark.read.text(f"file://{tmp_path}/loss.svg", wholetext=True).first()["value"].startswith("<svg")


def test_gradients_of_a_table_are_held_against_differences(spark, monkeypatch):
    rng = np.random.default_rng(42)
    table = lambda: spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(8)], "id long, vec array<double>")
    b = batch(spark, [(0, 3, 5, [1, 1, 5], 1.0), (1, 3, 5, [2, 3, 0], 0.5), (2, 7, 1, [7, 6, 6], 1.0)])
    w_in, w_out = table().cache(), table().cache()
    got = {r["side"]: r for r in sgns.gradient_errors(b, w_in, w_out).collect()}
    assert {k: r["parameters"] for k, r in got.items()} == {"in": 2 * 4, "out": 7 * 4} and all(r["ok"] and r["error"] < 1e-7 for r in got.values())
    right = sgns.gradients
    monkeypatch.setattr(sgns, "gradients", lambda *a: right(*a).withColumn("grad", F.when(F.col("side") == "in", F.col("grad") * 1.01).otherwise(F.col("grad"))))
    assert {r["side"]: r["ok"] for r in sgns.gradient_errors(b, w_in, w_out).collect()} == {"in": False, "out": True}


def test_a_grid_equals_its_models_as_tables(spark):
    from vocabulon.operators import experiments, grid

    rng = np.random.default_rng(8)
    n, d = 60, 6
    emb = lambda ids, scale: spark.createDataFrame([(int(i), (scale * rng.normal(size=d)).tolist()) for i in ids], "id long, vec array<double>").cache()
    trained, u, s = emb(range(n), 2.0), emb(range(40), 0.3), np.array([5.0, 4.0, 2.5, 2.0, 1.0, 0.0])
    words = spark.createDataFrame([(i, f"w{i}") for i in range(n)], "id long, word string")
    pick = [rng.choice(n, 4, replace=False) for _ in range(150)]
    x = {r["id"]: np.array(r["vec"]) for r in trained.collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}

    def answer(a, b, c):
        t = unit[b] - unit[a] + unit[c]
        return max((i for i in range(n) if i not in (a, b, c)), key=lambda i: t @ unit[i])

    rows = [("family" if q % 2 else "other", q, *[f"w{k}" for k in p[:3]], f"w{answer(*p[:3]) if q % 3 else p[3]}") for q, p in enumerate(pick)]
    rows += [("family", 900, "w1", "none", "w2", "w3"), ("other", 901, "w1", "w2", "w3", "none")]
    asked = spark.createDataFrame(rows, "category string, qno long, a string, b string, c string, d string")
    models = grid.mixes(powers=(0.0, 0.5), alphas=(0.3, 0.7))
    got = [tuple(r) for r in grid.scores(trained, u, s, models, words, asked).orderBy("config_no").collect()]
    want = [tuple(r)[:7] for r in experiments.comparison(grid.as_tables(trained, u, s, models), words, asked).orderBy("config_no").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-9)
    assert len({g[2:] for g in got}) > 3 and got[0][2] > 0.5  # models differ, and there is something to get right
    whole = grid.whole_grid(trained, emb(range(n), 1.0), u, s, words, asked).orderBy("config_no").collect()
    assert len(whole) == 1 + 5 + 35 + 1 + 3 and [r["chosen"] for r in whole].count(True) == 1 and [r["config_no"] for r in whole] == list(range(45))


def test_missing_corpus_is_refused(spark, tmp_path):
    (tmp_path / "source.txt").write_text("x y")
    got = corpus.fetched(spark, f"file://{tmp_path}/source.txt", f"file://{tmp_path}/copy.txt")
    assert corpus.text_files(spark, got).first()["text"] == "x y"
    assert corpus.fetched(spark, f"file://{tmp_path}/none.txt", f"file://{tmp_path}/copy.txt") == got
    with pytest.raises(FileNotFoundError, match="missing"):
        corpus.fetched(spark, f"file://{tmp_path}/none.txt", f"file://{tmp_path}/other.txt")


def test_empty_inputs(spark):
    none = corpus.tokens(docs(spark, "").where("false"))
    v = vocab.build_vocab(none, 1)
    assert v.count() == 0 and vocab.encode(none, v).count() == 0
    assert cooc.sppmi(cooc.cooccurrence(vocab.encode(none, v), 3), 1.0).count() == 0


def test_text_and_zip_files_and_store(spark, tmp_path):
    import zipfile

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x y")
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        z.writestr("b.txt", "z")
    assert {(r["doc_id"], r["text"]) for r in corpus.text_files(spark, f"file://{tmp_path}/in/*").collect()} == {(0, "x y"), (1, "z")}
    made, path, source = [], f"file://{tmp_path}/m", spark.range(3).toDF("id")
    make = lambda: made.append(1) or source
    for window in (10, 10, 4):
        df = store.load_or(spark, path, make, store.manifest(Settings(window_size=window), source))
    assert df.count() == 3 and len(made) == 2  # other settings: made again
    with pytest.raises(ValueError, match="settings"):
        store.load_or(spark, path, make, store.manifest(Settings(), source), on_mismatch="refuse")
    spark.range(5).toDF("id").write.parquet(f"{tmp_path}/source")
    files = spark.read.parquet(f"{tmp_path}/source")
    before = store.manifest({"k": 15}, files)
    store.load_or(spark, path, make, before)
    spark.range(6).toDF("id").write.mode("append").parquet(f"{tmp_path}/source")
    after = store.manifest({"k": 15}, spark.read.parquet(f"{tmp_path}/source"))
    assert before == store.manifest({"k": 15}, files) and before != after  # other files: made again
    assert store.load_or(spark, path, make, after).count() == 3 and len(made) == 4
    assert '"window_size": 4' in Settings().with_(window_size=4).to_json()


def test_streaming_counts_equal_the_batch(spark, tmp_path):
    from vocabulon.streaming.counts import streaming_counts

    d = docs(spark, "a b a", "b c")
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    query = streaming_counts(stream, "word_counts", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("word_counts").collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_registered_training_is_the_whole_job(monkeypatch):
    from vocabulon.config import Settings
    from vocabulon.plans import catalogue

    asked = []
    monkeypatch.setattr(catalogue, "_tokens", lambda spark, d: None)
    monkeypatch.setattr(catalogue.training, "train", lambda tokens, s: asked.append(s) or type("Trained", (), {"w_in": None}))
    catalogue.queries()["train_sgns"](None, "")
    assert asked == [Settings()] and (asked[0].embed_dim, asked[0].epochs, asked[0].subsample_t, asked[0].batch_size) == (300, 20, 1e-5, 4096)


def _batch_of_weights(words, n, dim, kind=np.float32):
    rng = np.random.default_rng(5)
    frequent = np.concatenate((np.zeros(words // 10, np.int64), rng.permutation(words)))  # id 0 is met often
    draw = lambda shape: frequent[rng.integers(0, len(frequent), shape)]
    return (rng.random((words, dim)) - 0.5).astype(kind), (rng.random((words, dim)) - 0.5).astype(kind), draw(n), draw(n), draw((n, 5)), rng.random(n)


def test_kernel_moves_repeated_rows_by_all_their_samples(monkeypatch):
    """whatever is moved at once, a batch's moves are those of its samples one by one."""
    monkeypatch.setattr(sgns, "REPEATS", 10**9)
    for words, n, weighted in ((7, 500, True), (400, 500, False), (70_000, 50, True)):  # beyond 65,536 rows ids aren't short
        w_in, w_out, centers, positives, negatives, weights = _batch_of_weights(words, n, 6, np.float64)
        weights = weights if weighted else None
        want_in, want_out = w_in.copy(), w_out.copy()
        for c, p, row, w in zip(centers, positives, negatives, np.ones(n) if weights is None else weights, strict=True):
            for t, label in ((p, 1), *((t, 0) for t in row)):
                g = 0.1 * w * (1 / (1 + np.exp(-w_in[c] @ w_out[t])) - label)
                want_in[c] -= g * w_out[t]
                want_out[t] -= g * w_in[c]
        for cached, moved in ((128, 768), (3, 4)):
            monkeypatch.setattr(sgns, "CACHED", cached)
            monkeypatch.setattr(sgns, "MOVED", moved)
            got_in, got_out = w_in.copy(), w_out.copy()
            sgns.train_batch(got_in, got_out, centers, positives, negatives, weights, 0.1)
            assert np.allclose(got_in, want_in) and np.allclose(got_out, want_out)


def test_kernel_stays_finite_where_a_batch_repeats_its_words():
    """on check_s the sums of words that a batch holds hundreds of times grew until all weights were NaN."""
    rng = np.random.default_rng(0)
    w_in, w_out = ((rng.random((12, 20)) - 0.5) / 20).astype(np.float32), np.zeros((12, 20), np.float32)
    for _ in range(600):
        centers = rng.integers(0, 12, 512)
        loss = sgns.train_batch(w_in, w_out, centers, centers // 2 * 2 + rng.integers(0, 2, 512), rng.integers(0, 12, (512, 5)), None, 0.025)
    assert loss < 2 and np.abs(w_in).max() < 10 and np.abs(w_out).max() < 10
    for n in (sgns.REPEATS, 100):
        w_in, w_out, none = np.full((2, 3), 0.5), np.full((2, 3), 0.25), np.zeros((n, 0), np.int64)
        sgns.train_batch(w_in, w_out, np.zeros(n, np.int64), np.ones(n, np.int64), none, None, 0.1)
        each = 0.1 * (1 - 1 / (1 + np.exp(-0.375)))
        assert np.allclose(w_in[0], 0.5 + sgns.REPEATS * each * 0.25) and np.allclose(w_out[1], 0.25 + sgns.REPEATS * each * 0.5)


def test_kernel_costs_less_than_sums_over_sorted_moves():
    """moves were laid out, sorted and summed column by column, which was most of a step."""
    import time

    w_in, w_out, centers, positives, negatives, _ = _batch_of_weights(4000, 512, 300)
    targets = np.concatenate((positives[:, None], negatives), axis=1).ravel()

    def summed():
        moves = np.repeat(w_in[centers], 6, axis=0)
        order = np.argsort(targets, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(targets[order]) != 0)))
        return np.add.reduceat(moves[order], first, axis=0)

    def least(run):
        taken = []
        for _ in range(15):
            began = time.perf_counter()
            run()
            taken.append(time.perf_counter() - began)
        return min(taken)

    assert least(lambda: sgns.train_batch(w_in, w_out, centers, positives, negatives, None, 1e-4)) < least(summed)


def test_negatives_are_those_of_a_search_by_share():
    """slots of the draws stand for most searches, and give the same words."""
    for counts in ([5], [10**9] + [1] * 3000, list(range(1, 2000))):
        cell = training._Cell(Settings(embed_dim=2), 0, 64, lambda done: 0.1, [3], 10)
        for kind in (training._IN, training._OUT):
            cell.hold(kind, 0, 0, np.zeros((len(counts), 2), np.float32).tobytes(), np.array(counts, np.int64).tobytes())
        cell._ready()
        cell.rng = np.random.default_rng(9)
        want = np.minimum(np.searchsorted(cell.ends, np.random.default_rng(9).random((5000, 5)), "right"), len(counts) - 1)
        assert (cell._negatives(5000) == want).all()


def test_meetings_hold_a_stretch_of_scores_and_equal_rows_once(monkeypatch):
    """F1: a meeting of many queries with many rows held all their scores, and every copy of a vector."""
    import pandas as pd

    from vocabulon.operators import scoring

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[100:300] = x[0]  # copies
    frame = lambda name, key: pd.DataFrame({key: np.arange(400), name: list(x)})
    asked = frame("query", "qid").assign(banned=[np.array([i]) for i in range(400)])
    held = []
    best = scoring._best
    monkeypatch.setattr(scoring, "SCORES", 2000)
    monkeypatch.setattr(scoring, "_best", lambda ids_, *a: (held.append((len(ids_), len(a[1]))), best(ids_, *a))[1])
    got = scoring._met(frame("vec", "id"), asked, 5)
    assert max(n * m for n, m in held) <= 2000 and held[0][0] == 200 + 5
    scores = np.array([(x * q).sum(axis=1) for q in x])
    np.fill_diagonal(scores, -np.inf)
    want = {(q, i) for q in range(400) for i in np.lexsort((np.arange(400), -scores[q]))[:5].tolist()}
    assert {(r.qid, r.id) for r in got.itertuples()} == want


def test_a_query_travels_once_to_a_block_of_cells(spark, monkeypatch):
    """a query was sent to every cell that it could not skip."""
    from vocabulon.operators import scoring

    first, own, n = scoring._blocks(np.array([10, 20_000, 20_000, 70_000, 0, 5]))
    assert first.tolist() == [0, 0, 1, 2, 4, 5] and own.tolist() == [1, 1, 1, 3, 1, 1] and n == 6
    monkeypatch.setattr(scoring, "ROW_BLOCK", 150)
    x = np.random.default_rng(5).normal(size=(600, 8))
    x[200:400] = x[3]  # a cell of several blocks
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    queries = rows.select(F.col("id").alias("qid"), "vec", F.array("id").alias("banned"))
    want = [tuple(r) for r in scoring.top_k(rows, queries, 4).orderBy("qid", "rank").collect()]
    got = scoring.pruned_top_k(rows, queries, 4, 40)
    assert [tuple(r) for r in got.found.orderBy("qid", "rank").collect()] == want and len(want) == 2400


def test_draws_below_a_share_are_told_by_the_digest(spark):
    at = spark.range(2000).select("id", (F.col("id") % 21 / 20).alias("p"))
    got = at.select((scalars.uniform(1, "=x", "id") < F.col("p")).alias("a"), scalars.below(F.col("p"), 1, "=x", "id").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and {r["a"] for r in got} == {True, False}
    edge = scalars.uniform(1, "=x", F.lit(5))
    near = spark.range(1).select(*[scalars.below(edge + d, 1, "=x", F.lit(5)).alias(f"c{k}") for k, d in enumerate((-(2.0**-33), 0.0, 2.0**-33))]).first()
    assert tuple(near) == (False, False, True)


def test_winning_samples_are_found_without_a_window_over_entries(spark):
    """the last sample was looked for among all entries of all vectors, in one window."""
    batch = spark.createDataFrame([(r, r % 2, 1, [0, 1], 1.0) for r in range(6)] + [(9, 77, 1, [0, 1], 1.0)], "row long, center long, pos long, negs array<long>, w double")
    model = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "id long, vec array<double>")
    got = sgns.gradients(batch, model, model, "last")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = sgns.gradients(batch.where("row in (4, 5)"), model, model, "last")  # row 9 asks for a word that isn't there
    key = lambda table: {(r["side"], r["id"], r["dim"]): pytest.approx(r["grad"]) for r in table.collect()}
    assert key(got) == key(want) and len(key(got)) == 8


def test_a_contest_prepares_its_corpus_once_and_scores_in_one_pass(spark, monkeypatch):
    """vocabulary and documents were made for each model, and each table of weights was evaluated by itself."""
    from vocabulon.operators import experiments, training

    t = corpus.tokens(docs(spark, " ".join(["a b c d e f", "g h i j k l"] * 60)))
    asked = spark.createDataFrame([("family", 1, "a", "b", "c", "d"), ("other", 1, "e", "f", "g", "h")], "category string, qno long, a string, b string, c string, d string")
    s = Settings(embed_dim=6, epochs=2, min_count=1, subsample_t=1.0, window_size=3, batch_size=8)
    made, passes, build, judged = [], [], training.build_vocab, experiments.analogy.judged
    monkeypatch.setattr(training, "build_vocab", lambda *a: made.append(1) or build(*a))
    monkeypatch.setattr(experiments.analogy, "judged", lambda *a: passes.append(1) or judged(*a))
    contest = experiments.baseline_and_adaptive(t, asked, s, 1, log_every=10)
    got = {(r["model"], r["weights"]): r for r in contest.scores.collect()}
    assert (len(made), len(passes)) == (1, 1)
    words = contest.baseline.vocab.select("id", "word")
    for name, trained in (("baseline", contest.baseline), ("adaptive", contest.adaptive)):
        alone = training.train(t, s.with_(use_afws=name == "adaptive", epochs=2 if name == "baseline" else 1), log_every=10)
        assert alone.w_in.orderBy("id").collect() == trained.w_in.orderBy("id").collect()
        one = experiments.scores(trained.w_in, words, asked).first()
        assert tuple(one) == tuple(got[name, "in"][c] for c in ("semantic", "syntactic", "overall"))
    with pytest.raises(ValueError):
        training.train(t, s.with_(min_count=2), corpus=training.prepared(t, s))


def _encoded(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("size", [3, 64, vocab.CHUNK])
def test_documents_are_encoded_by_the_words_of_chunks(spark, size):
    """every token went to the vocabulary by its word, and back to its document."""
    texts = ["a b c a x", "b b", "", "c a b y z a", " ".join("abc"[i % 3] for i in range(50))]
    rows = [(7 - i, p, w) for i, x in enumerate(texts) for p, w in enumerate(x.split())] + [(None, 0, "a"), (3, 9, None)]
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, word string")
    number = {"a": 0, "b": 1, "c": 2}
    for t in (spark.createDataFrame(rows, "doc_id long, pos int, word string").coalesce(1), spark.createDataFrame(rows[::-1], "doc_id long, pos int, word string").repartition(3)):
        known = [(d, p, number[w]) for d, p, w in rows if w in number]
        assert _encoded(vocab.known_words(t, v, size)) == sorted(known, key=str)
        closed = [(d, sum(e == d and q < p for e, q, _ in known), i) for d, p, i in known]
        assert _encoded(vocab.encode(t, v, size)) == sorted(closed, key=str)
        parts = vocab.known_words(t, v, size).rdd.glom().collect()
        seen = [(d, k) for k, part in enumerate(parts) for d in {r["doc_id"] for r in part}]
        assert len(seen) == len({d for d, _ in seen})  # no document in two partitions
        for part in parts:
            runs = [r["doc_id"] for i, r in enumerate(part) if i == 0 or part[i - 1]["doc_id"] != r["doc_id"]]
            assert len(runs) == len(set(runs)) and all(a["doc_id"] != b["doc_id"] or a["pos"] < b["pos"] for a, b in zip(part, part[1:], strict=False))


def test_tokens_are_not_shuffled_by_their_words(spark):
    """The plan's exchanges carry chunks and their words; documents that stand together aren't dealt again for their pairs."""
    t = corpus.tokens(docs(spark, "a b a b", "b a c"))
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, word string")
    plan = vocab.encode(t, v)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "split(" not in plan
    known = vocab.known_words(t, v)
    a, b = (cooc.counted_pairs(known, 2, together=x) for x in (True, False))
    assert a._jdf.queryExecution().optimizedPlan().toString().count("Repartition") < b._jdf.queryExecution().optimizedPlan().toString().count("Repartition")
    assert sorted(a.collect()) == sorted(b.collect())


def test_cells_travel_in_few_bytes_and_keep_large_weights():
    """F16: a cell took twelve bytes of a shuffle; weights beyond 32 bits come back whole."""
    keys = np.sort(np.random.default_rng(3).choice(1 << 18, 5000, replace=False).astype(np.int64)) | 7 << 32
    w = np.arange(5000, dtype=np.int64) % 9 * 2520
    w[:2] = (1 << 40) + 3, (1 << 46) + 65535
    b = cooc._rows(keys, w, 16)
    assert sum(len(x.as_py()) for c in b.schema.names if pa.types.is_binary(b.schema.field(c).type) for x in b.column(c)) <= 8 * 5000
    high = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in b.column("high")]).astype(np.int64)
    low = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in b.column("low")])
    places = [(i << 32 | s << 16) + np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for i, s, x in zip(b.column("i").to_pylist(), b.column("stretch").to_pylist(), b.column("js"), strict=True)]
    assert (np.concatenate(places) == keys).all() and (high << 16 | low == w).all() and len(places) == 4


def test_scores_are_joined_without_sorting_the_cells(spark):
    """all cells were sorted twice, by their row and by their column, to meet their sums."""
    t = corpus.tokens(docs(spark, "a b a b c", "b a c"))
    plan = cooc.associations(vocab.known_words(t, vocab.build_vocab(t, 1)), 2, 1.0, together=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=shuffle_hash") == 2


def test_a_product_adds_up_in_its_task(spark):
    """every block of a product was shuffled once for each block of the thin matrix, to be summed."""
    rng = np.random.default_rng(5)
    m = np.where(rng.random((30, 30)) < 0.3, rng.normal(size=(30, 30)), 0)
    m[3::4] = m[:, 3::4] = 0  # one of four blocks has no cells
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, value double")
    y = svd.normal_pieces(spark, 30, 3, 4, 1)
    dense = {r["id"]: r["vec"] for r in svd.as_rows(y, 3, 4).collect()}
    made = svd.product(svd.packed(cells, 4), y, 3, 30, 4)
    blocks = [r["block"] for r in made.select("block", "place").collect()]
    assert sorted(blocks) == [0, 1, 2]  # a block comes out once
    got = {r["id"]: r["vec"] for r in svd.as_rows(made, 3, 4).collect()}
    want = m @ np.array([dense[i] for i in range(30)])
    assert all(np.allclose(got.get(i, np.zeros(3)), want[i]) for i in range(30))


@pytest.mark.parametrize("size", [3, 64, vocab.TALLY])
def test_lengths_are_counted_by_rare_words_alone(spark, monkeypatch, size):
    """all tokens were encoded, and their chunks written and shuffled, to count the documents' words."""
    monkeypatch.setattr(vocab, "_known", lambda *a: pytest.fail("tokens are encoded"))
    texts = ["a b c a x", "b b", "", "c a b y z a", "u v w", " ".join("abc"[i % 3] for i in range(50))]
    rows = [(7 - i, p, w) for i, x in enumerate(texts) for p, w in enumerate(x.split())] + [(7, 99, "late"), (2, 99, "late"), (3, 98, None), (None, 0, "a")]
    cnt = {w: sum(w == x for _, _, x in rows) for _, _, w in rows if w}
    for t in (spark.createDataFrame(rows, "doc_id long, pos int, word string").coalesce(1), spark.createDataFrame(rows[::-1], "doc_id long, pos int, word string").repartition(3)):
        for least in (1, 2, 5):
            known = [(d, p, w) for d, p, w in rows if w and cnt[w] >= least]
            want = sorted(((d, sum(d == e for e, _, _ in known)) for d in {d for d, _, _ in known}), key=str)
            assert _encoded(vocab.known_lengths(t, least, size)) == want
            v, lengths = vocab.vocab_and_lengths(t, least, size)
            assert _encoded(lengths) == want
            first = {w: min((d, p) for d, p, x in known if x == w and d is not None) for _, _, w in known}
            order = sorted(first, key=lambda w: (-cnt[w], first[w]))
            assert _encoded(v) == sorted(((i, w, cnt[w]) for i, w in enumerate(order)), key=str) == _encoded(vocab.build_vocab(t, least))


def test_registered_lengths_encode_nothing(spark, monkeypatch):
    """the same of the registered queries, whose lengths are read more than once."""
    monkeypatch.setattr(vocab, "_known", lambda *a: pytest.fail("tokens are encoded"))
    text = "a b c d " * 20_000
    monkeypatch.setattr(catalogue.corpus, "documents", lambda *a: docs(spark, text, "a rare word", text))
    assert sorted(map(tuple, catalogue.chunk_ids(spark, "").collect())) == [(0, 50000), (1, 50000), (2, 50000), (3, 10001)]
    assert catalogue.expected_pairs(spark, "").first()["tokens"] == 160_001


def test_digests_of_many_keys_are_md5():
    """each draw's key was a text of its own, and its digest another."""
    pos = np.array([0, 9, 10, 99, 100, 54321, 1234567])
    for key in ("1|neg|0|-37|", "1|neg|0|", "x" * 45 + "|", "x" * 90 + "|"):
        keys = np.frombuffer((key * 2).encode(), np.uint8).reshape(2, -1)
        got = sorted(int(x) for part in digests.numbered_draws(keys, np.zeros(7, int), pos, 12) for x in part)
        assert got == sorted(int(hashlib.md5(f"{key}{p}|{j}".encode()).hexdigest()[:8], 16) for p in pos for j in range(12))


@pytest.mark.parametrize("tasks", [1, 3])
def test_draws_are_counted_before_they_are_shuffled(spark, monkeypatch, tasks):
    """every draw was shuffled to meet its interval."""
    monkeypatch.setattr(negatives, "STRETCH", 7)
    monkeypatch.setattr(negatives, "HELD", 50)
    monkeypatch.setattr(negatives, "CELLS", 10)
    lengths = spark.createDataFrame([(3, 20), (-5, 1), (123456789, 12), (None, 3), (4, 0)], "doc_id long, n long")
    table = spark.createDataFrame([(0, 0, 60), (1, 60, 60), (2, 60, 61), (3, 61, 97), (4, 97, 103)], "id long, lo long, hi long")
    slots = lengths.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos")).select("doc_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    drawn = slots.withColumn("r", F.floor(scalars.uniform(7, "=neg", 2, "doc_id", "pos", "k") * 103))
    want = vocab.draw_negatives(drawn, table, 103).groupBy("id").agg(F.count(F.lit(1)), F.sum("r"))
    got = negatives.drawn_counts(lengths, table, 103, 5, 7, 2, tasks)
    assert _encoded(got) == _encoded(want) and sum(r["draws"] for r in got.collect()) == 36 * 5


def test_a_plain_meeting_takes_little_memory():
    """a meeting held four million scores, their copy, and two vectors for each of those that it multiplied out again."""
    import tracemalloc

    import pandas as pd

    from vocabulon.operators import scoring

    x = np.random.default_rng(4).normal(size=(2048, 64))
    rows, asked = pd.DataFrame({"id": np.arange(2048), "vec": list(x)}), pd.DataFrame({"qid": np.arange(2048), "query": list(x), "banned": [np.array([i]) for i in range(2048)]})
    tracemalloc.start()
    got = scoring._met(rows, asked, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    assert [set(g["id"]) for _, g in got.groupby("qid")] == [set(r) for r in np.argsort(-scores, axis=1)[:, :5]]


def _wordy(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(d if d % 7 else None if d == 7 else 1000 * d, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 40)) for d in range(n)]
    return corpus.tokens(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("whole", [True, False])
def test_counts_of_pairs_equal_pairs_however_the_text_is_cut(spark, whole):
    t = _wordy(spark)
    t = t if whole else t.repartition(3, "word")
    v = vocab.build_vocab(t, 2)
    text = vocab.Encoded(t, v)
    assert text.whole == whole
    rows = vocab.encode(t, v)
    count = lambda p: {tuple(r) for r in p.groupBy("center", F.col("dist").cast("long").alias("dist")).agg(F.count(F.lit(1)).alias("n"), F.sum("context").alias("contexts")).collect()}
    widths = pairs.adaptive_widths(v, 2, 6)
    for got, expected in (
        (pairs.tallied(text, 4, part=3, at_once=11), pairs.both_ways(pairs.look_ahead(rows, 4))),
        (pairs.tallied(text, 12, "sampled", seed=5, part=3, at_once=11), pairs.sampled(rows, 12, 5)),
        (pairs.tallied(text, 6, "adaptive", widths, 5, part=3, at_once=11), pairs.adaptive(rows, v, 2, 6, seed=5)),
    ):
        assert {tuple(r) for r in got.collect()} == count(expected)
    kept = vocab.keep_probabilities(v, 0.02)
    assert sorted(map(str, vocab.subsampled(text, kept, 5).collect())) == sorted(map(str, vocab.subsample(rows, kept, 5).collect()))


def test_pair_counts_make_no_row_a_pair(spark, tmp_path):
    spark.createDataFrame([(d, "a b c d e f g a b c " * 3) for d in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("pairs_window", "pairs_sampled", "pairs_weighted", "pairs_afws", "subsample_tokens"):
        plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "lead(" not in plan and "windowspecdefinition(doc_id" not in plan, name


def test_long_keys_draw_like_short_ones():
    keys = [b"1|pair|0|7|", b"1|pair|0|" + b"x" * 60 + b"|", b"1|pair|0||"]
    own, pos = np.array([0, 1, 2, 0, 2]), np.array([0, 9, 10, 123456, 99])
    got = digests.draws_of(keys, own, pos, [b"", b"|2", b"|10"])
    for row, tail in enumerate((b"", b"|2", b"|10")):
        assert got[row].tolist() == [int(hashlib.md5(keys[o] + str(p).encode() + tail).hexdigest()[:8], 16) for o, p in zip(own, pos, strict=True)]


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize(("window", "top", "dense", "stretch", "sorted_", "part_cells", "together"), [(10, None, 1024, 16, 1 << 22, 1 << 20, 8), (4, None, 5, 2, 50, 7, 3), (4, 9, 0, 1, 50, 1, 1)])
def test_cells_of_a_text_equal_cells_of_its_rows(spark, whole, window, top, dense, stretch, sorted_, part_cells, together):
    t = _wordy(spark)
    t = t if whole else t.repartition(3, "word")
    v = vocab.build_vocab(t, 2)
    counted = cooc.Counted(vocab.Encoded(t, v), window, top=top, dense=dense, stretch=stretch, sorted_=sorted_, part_cells=part_cells, together=together)
    half = cooc.counted_pairs(vocab.encode(t, v), window, top=top)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(counted.pairs(), half)
    sums = cooc.marginals_of_pairs(half, counted.unit)
    assert same(counted.marginals(), sums)
    assert same(counted.sums().select("i", (F.col("w") / counted.unit).alias("total")), sums.select("i", "total"))
    got = {(r["i"], r["j"]): r["value"] for r in counted.associations(2.0).collect()}
    expected = {(r["i"], r["j"]): r["value"] for r in cooc.associations(vocab.encode(t, v), window, 2.0, top).collect()}
    assert got.keys() == expected.keys() and got == pytest.approx(expected, abs=1e-12)


def test_registered_associations_join_no_cells(spark, tmp_path):
    spark.createDataFrame([(d, "a b c d e f g a b c " * 3) for d in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.queries()["sppmi"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]


def test_a_written_step_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).repartition(3)
    setting = spark.conf.get(scratch._CLEANUP)
    table = scratch.written(rows.groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and spark.conf.get(scratch._CLEANUP) == setting
    where = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = {p for p in where.rglob("shuffle_*")}
    scratch.written(rows.groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not {p for p in where.rglob("shuffle_*")} - before:
            break
        time.sleep(0.1)
    assert not {p for p in where.rglob("shuffle_*")} - before


@pytest.mark.parametrize("whole", [True, False])
def test_cells_of_a_stream_equal_cells_of_its_chunks(spark, whole):
    t = _wordy(spark).where("doc_id is not null")
    t = t if whole else t.repartition(3, "word")
    v = vocab.build_vocab(t, 2)
    stream = vocab.Stream(vocab.Encoded(t, v), 23, width=5)
    half = cooc.counted_pairs(vocab.chunked(vocab.encode(t, v), 23), 4)
    assert sorted(map(tuple, cooc.Counted(stream, 4).pairs().collect())) == sorted(map(tuple, half.collect()))


def test_slices_of_columns_multiply_like_the_whole(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 40)) * (rng.random((40, 40)) < 0.3)
    m = m + m.T
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, value double")
    made = []
    for wide in (96, 3):
        u, s = svd.randomized_svd(cells, 40, 5, 6, 3, grid=3, wide=wide)
        v = np.array([r["vec"] for r in u.orderBy("id").collect()])
        made.append((s, (v * s) @ v.T))
    assert made[0][0] == pytest.approx(made[1][0], rel=1e-9) and made[0][1] == pytest.approx(made[1][1], abs=1e-8)
    assert made[0][0][0] == pytest.approx(np.abs(np.linalg.eigvalsh(m)).max(), rel=1e-3)
