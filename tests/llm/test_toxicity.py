"""The field's marginals against brute force, its learning on held-out texts, and odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocabulon.llm import textkernel as tk
from vocabulon.llm import toxicity as tx
from vocabulon.llm.ship import ship


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def by_hand(field, scores):
    """Marginals of one text over all of its taggings."""
    total, hot = 0.0, np.zeros(len(scores))
    for tags in itertools.product((0, 1), repeat=len(scores)):
        x = field.opening * tags[0] + sum(s for s, y in zip(scores, tags, strict=True) if y) + sum(field.links[a, b] for a, b in itertools.pairwise(tags))
        total += np.exp(x)
        hot += np.exp(x) * np.array(tags)
    return hot / total


def test_marginals_equal_brute_force_over_all_taggings():
    rng = np.random.default_rng(1)
    field = tx.Field(np.zeros(1), 0.0, rng.standard_normal((2, 2)), 0.7)
    lengths = [1, 5, 9, 2, 12, 1, 7] * 8  # several blocks, texts across their bounds
    scores = [rng.standard_normal(n) * 3 for n in lengths]
    opens = np.concatenate([np.arange(n) == 0 for n in lengths])
    got = tx.marginals(field, np.concatenate(scores), opens)
    assert np.allclose(got, np.concatenate([by_hand(field, s) for s in scores]), atol=1e-12)
    assert len(tx.marginals(field, np.zeros(0), np.zeros(0, bool))) == 0


def test_gradients_lead_to_the_tags():
    """With a tag that only the word before tells, the field learns it from its neighbour features."""
    rng = np.random.default_rng(2)
    texts, tags = [], []
    for _ in range(200):
        w = rng.choice(["aa", "bb", "cc", "you", "such"], 30)
        texts.append(" ".join(w))
        tags += [0.0, *(w[:-1] == "such").astype(float)]
    field = tx.fitted(tx.sampled(texts), np.array(tags), np.random.default_rng(0))
    t = tx.tokens(next(tk.slices(pa.array(texts, pa.large_string()), 1 << 62))[2])
    assert ((tx.marginals(field, field.scores(t), t.opens) > 0.5) == (np.array(tags) > 0)).mean() > 0.999


def test_tokens_lose_punctuation_and_know_their_place():
    texts = ["«Ärger», (so)!! -- x", "", "ab3 ABC", "... ..."]
    t = tx.tokens(next(tk.slices(pa.array(texts, pa.large_string()), 1 << 62))[2])
    words = [bytes(t.words.buf[s:e]).decode() for s, e in zip(t.start, t.end, strict=True)]
    assert words == ["«Ärger»", "so", "", "x", "ab3", "ABC", "", ""]
    p = np.array([0.9, 0.9, 0.1, 0.8, 0.9, 0.9, 0, 0])
    spans = [[(s["start"], s["end"]) for s in x] for x in tx._spans(t, p, 4).to_pylist()]
    assert spans == [[(0, 12), (19, 20)], [], [(0, 7)], []]


def corpus(n, seed):
    """Texts of invented words; toxic ones hold insults, some with endings that no other text has."""
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    out = []
    for i in range(n):
        w = rng.choice(plain, rng.integers(20, 120)).tolist()
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, len(w), 3):
                w[at] = rng.choice(["moron", "Scum!", "(trash)", f"loweq{rng.choice(plain)[:3]}"])
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out_texts_are_told_apart_and_spans_point_at_insults(sp):
    rows = corpus(1200, 4)
    docs = sp.createDataFrame([(i, t, "clash", 1.0) for i, t, _ in rows], "doc_id long, text string, spans string, score double").repartition(5)
    labels = sp.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    wrong = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))  # held-out labels must not matter
    model = tx.fit(docs, wrong)
    got = {r["doc_id"]: r for r in tx.scored(docs, model).collect()}
    text = {i: t for i, t, _ in rows}
    test = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(test) > 300 and np.mean([(got[i]["score"] >= 0.7) == bool(y) for i, y in test]) > 0.98
    hits = [text[i][s["start"] : s["end"]] for i, y in test if y for s in got[i]["spans"]]
    assert np.mean([h.startswith(("moron", "Scum", "trash", "loweq")) for h in hits]) > 0.97
    again = tx.fit(docs.repartition(2), wrong)
    assert np.array_equal(again.field.weights, model.field.weights) and np.array_equal(again.slope, model.slope)  # whatever the partitions
    odd = sp.createDataFrame([(None, "moron scum trash"), (1, None), (2, ""), (3, " \t"), (4, "moron " + "fine " * 400_000 + "scum trash"), (5, "é" * 3_000_000), (1, None)], "doc_id long, text string")
    found = tx.scored(odd, model).collect()
    assert len(found) == 7
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["score"] > 0.7 and by[1][0] == by[1][1] and by[2][0]["score"] == by[1][0]["score"] == by[3][0]["score"] < 0.7
    assert by[4][0]["score"] > 0.7 and [tuple(s) for s in by[4][0]["spans"]] == [(0, 5), (2_000_006, 2_000_016)]  # over more than one slice of text
    assert 0 <= by[5][0]["score"] < 0.7


def test_without_labels_or_rows(sp):
    docs = sp.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = sp.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert tx.fit(docs, labels) is None and tx.fit(docs, labels.where("false")) is None and tx.fit(docs.where("false"), labels) is None
    assert [(r["score"], r["spans"]) for r in tx.scored(docs, None).collect()] == [(0.0, []), (0.0, [])]
    assert tx.scored(docs.where("false"), None).collect() == []


def test_near_copies_count_once():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    near = a.copy()
    near[:10] += np.uint64(1)
    assert tx.apart([a, near, a, rng.integers(0, 1 << 60, 200).astype(np.uint64), np.zeros(0, np.uint64)]).tolist() == [True, False, False, True, True]
