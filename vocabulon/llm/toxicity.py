"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words without the punctuation around them; a token is plain or toxic.  The field scores a token by
hashed features of it and its neighbours (the word, its first and last characters, its shape, the words
beside it) and two tokens in a row by their tags; forward-backward gives each token's probability.
A document's score is a logistic function of its largest marginals and their sum; its spans are the runs
of tokens whose marginal is one half or more, as offsets of the source text in code points.

Labels are known for documents only.  Tokens get theirs from a bounded sample of labelled documents: words
and beginnings of words that far more toxic than other documents hold, by a likelihood-ratio test, are
toxic in toxic documents; every token of a document that isn't toxic is plain; toxic documents without
such a word teach nothing.  Near-copies count once.  The sample is ``SAMPLE`` documents a label of at most
``SAMPLE_CHARS`` characters, drawn by a hash of the id from all labels; nothing else is bounded: every text
is scored whole, and only ids of the sample and its texts reach the driver.

A batch of texts is one chain whose links between documents are cut, in blocks of ``STRIDE`` tokens that are
multiplied side by side, so a text of millions of words costs as much a word as many short ones.

Defined cases: null text counts as empty, and an empty text has the score of no toxic token; repeated rows
are scored each; a null id is scored and teaches nothing; a document with several label rows is toxic if one
says so, null labels are ignored; without toxic and other labelled documents every score is 0; extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

SAMPLE, SAMPLE_CHARS, SEED = 2000, 20_000, 20240515
BITS, STRIDE, EPOCHS, BATCHES, RATE, RIDGE = 18, 64, 6, 64, 0.3, 1e-5
#: Evidence for a marker: twice the log-likelihood ratio, and how much likelier its documents are to be toxic.
EVIDENCE, ODDS, LEAST_DOCS = 24.0, 8.0, 3
FAINT, TOXIC = 0.05, 0.5
_PREFIXES, _SUFFIX = (3, 4, 5), 3
_OWN = 3 + len(_PREFIXES)  # word, prefixes, suffix, shape
#: Bytes of punctuation and the like.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALT = tk.mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bucket(h: np.ndarray, template: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tk.mix(h + _SALT[template]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Tokens:
    """Tokens of some texts: where they are, their distinct words and these words' features."""

    words: tk.Words
    start: np.ndarray  # without punctuation around
    end: np.ndarray
    chars: np.ndarray  # code points up to each byte, itself included
    word: np.ndarray  # index of each token's word among the distinct ones
    own: np.ndarray  # (distinct words, _OWN): buckets
    before: np.ndarray  # bucket of each distinct word as the one before another
    after: np.ndarray
    markers: np.ndarray  # (distinct words, 3): hashes of the word and of its first 4 and 5 characters

    @property
    def opens(self) -> np.ndarray:
        """Whether a token is its text's first."""
        row = self.words.row
        return np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)


def tokens(w: tk.Words) -> Tokens:
    buf, n = w.buf, len(w.buf)
    at = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    solid = ~_OUTSIDE[buf]
    last = np.maximum.accumulate(np.where(solid, at, at.dtype.type(-1))) if n else at
    following = np.minimum.accumulate(np.where(solid, at, at.dtype.type(n))[::-1])[::-1] if n else at
    start = np.minimum(following[w.start], w.end)
    end = np.maximum(last[w.end - 1] + 1, start)
    del last, following, solid
    heads = (buf & 0xC0) != 0x80
    chars = np.cumsum(heads, dtype=at.dtype)
    h = tk.hash_spans(buf, start, end, tk.BYTE_TABLE_LOWER)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    place = np.append(np.flatnonzero(heads), n)
    head = np.where(e > s, chars[np.minimum(s, n - 1)] - 1, 0) if n else np.zeros(len(s), np.int64)
    count = np.where(e > s, chars[np.maximum(e - 1, 0)] - head, 0) if n else np.zeros(len(s), np.int64)
    cut = lambda k: np.minimum(place[np.minimum(head + k, len(place) - 1)], e)  # noqa: E731  the end of the first k characters
    prefixes = {k: tk.hash_spans(buf, s, np.maximum(cut(k), s), tk.BYTE_TABLE_LOWER) for k in _PREFIXES}
    tail = np.where(e > s, place[np.minimum(head + np.maximum(count - _SUFFIX, 0), len(place) - 1)], s)
    upper, digit = (np.concatenate((np.zeros(1, at.dtype), np.cumsum((buf >= lo) & (buf <= hi), dtype=at.dtype))) for lo, hi in ((65, 90), (48, 57)))
    shape = 4 * np.minimum(upper[e] - upper[s], 2) + 2 * (digit[e] > digit[s]) + (upper[e] - upper[s] == e - s)
    templates = [distinct, *(prefixes[k] for k in _PREFIXES), tk.hash_spans(buf, tail, e, tk.BYTE_TABLE_LOWER), shape.astype(np.uint64)]
    own = np.stack([_bucket(x, i) for i, x in enumerate(templates)], axis=1) if len(distinct) else np.zeros((0, _OWN), np.int64)
    markers = np.stack((distinct, tk.mix(prefixes[4] ^ _SALT[14]), tk.mix(prefixes[5] ^ _SALT[15])), axis=1) if len(distinct) else np.zeros((0, 3), np.uint64)
    return Tokens(w, start, end, chars, word, own, _bucket(distinct, _OWN), _bucket(distinct, _OWN + 1), markers)


_EDGE = np.array([_OWN + 2, _OWN + 3])  # buckets for what stands before a text and after it


def _beside(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words before and after each token."""
    n, opens = len(t.word), t.opens
    before, after = np.full(n, _EDGE[0]), np.full(n, _EDGE[1])
    if n > 1:
        inner = ~opens[1:]
        before[1:][inner] = t.before[t.word[:-1][inner]]
        after[:-1][inner] = t.after[t.word[1:][inner]]
    return before, after


@dataclass
class Field:
    """Weights of the toxic tag by bucket, log-potentials of (tag, next tag) and of a text's first tag."""

    weights: np.ndarray
    bias: float
    links: np.ndarray
    opening: float

    def scores(self, t: Tokens) -> np.ndarray:
        """Log-potential of the toxic tag for each token."""
        before, after = _beside(t)
        return self.weights[t.own].sum(axis=1)[t.word] + self.weights[before] + self.weights[after] + self.bias

    def scores_of(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) + self.bias


def _times(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (4, any), to a scale."""
    out = np.stack((p[0] * m[0] + p[1] * m[2], p[0] * m[1] + p[1] * m[3], p[2] * m[0] + p[3] * m[2], p[2] * m[1] + p[3] * m[3]))
    return out / out.max(axis=0)


def _potentials(field: Field, scores: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """(4, tokens): the matrix from the token before to each token; a text's first token forgets what was before."""
    toxic = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    tag = np.stack((1 - toxic, toxic))
    links = np.exp(field.links).ravel()
    m = np.concatenate((tag, tag)) * links[:, None]
    first = tag[:, opens] * np.array([[1.0], [np.exp(field.opening)]])
    m[:, opens] = np.concatenate((first, first))
    return m / m.max(axis=0)


def forward_backward(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, n) each: what comes up to each token and what follows it, to a scale, by blocks of STRIDE matrices."""
    n = m.shape[1]
    blocks = -(-n // STRIDE)
    full = np.zeros((4, blocks * STRIDE))
    full[:, :n] = m
    full[0, n:] = full[3, n:] = 1.0
    full = np.ascontiguousarray(full.reshape(4, blocks, STRIDE).transpose(2, 0, 1))  # (place, 4, block)
    upto, after = np.empty_like(full), np.empty_like(full)
    upto[0] = full[0]
    for k in range(1, STRIDE):
        upto[k] = _times(upto[k - 1], full[k])
    after[-1] = np.array([1.0, 0, 0, 1])[:, None]
    for k in range(STRIDE - 2, -1, -1):
        after[k] = _times(full[k + 1], after[k + 1])
    whole = upto[-1].T.tolist()
    left, right = [(1.0, 1.0)], [(1.0, 1.0)]
    for a, b, c, d in whole[:-1]:
        x, y = left[-1]
        x, y = x * a + y * c, x * b + y * d
        left.append((x / (x + y), y / (x + y)))
    for a, b, c, d in whole[:0:-1]:
        x, y = right[-1]
        x, y = a * x + b * y, c * x + d * y
        right.append((x / (x + y), y / (x + y)))
    left, right = np.array(left).T, np.array(right[::-1]).T
    alpha = np.stack((left[0] * upto[:, 0] + left[1] * upto[:, 2], left[0] * upto[:, 1] + left[1] * upto[:, 3]))
    beta = np.stack((after[:, 0] * right[0] + after[:, 1] * right[1], after[:, 2] * right[0] + after[:, 3] * right[1]))
    flat = lambda x: x.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    return flat(alpha), flat(beta)


def marginals(field: Field, scores: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The probability of the toxic tag for each token."""
    if not len(scores):
        return np.zeros(0)
    alpha, beta = forward_backward(_potentials(field, scores, opens))
    both = alpha * beta
    return both[1] / both.sum(axis=0)


# --- fitting --------------------------------------------------------------------------------------


@dataclass
class Sample:
    """What is kept of the sample's texts: a few numbers a token."""

    features: np.ndarray  # (tokens, buckets)
    markers: np.ndarray  # (tokens, 3): the word and its first 4 and 5 characters
    first: np.ndarray  # of each text, its first token; one more entry at the end

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def opens(self) -> np.ndarray:
        out = np.zeros(len(self.features), bool)
        out[self.first[:-1][np.diff(self.first) > 0]] = True
        return out

    def tokens_of(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)

    def of(self, rows: np.ndarray) -> Sample:
        at = self.tokens_of(rows)
        return Sample(self.features[at], self.markers[at], np.concatenate(([0], np.cumsum(np.diff(self.first)[rows]))))


def sampled(texts: list[str]) -> Sample:
    features, markers, lengths = [np.zeros((0, _OWN + 2), np.int32)], [np.zeros((0, 3), np.uint32)], [np.zeros(0, np.int64)]
    for _, _, w in tk.slices(pa.array(texts, pa.large_string())):
        t = tokens(w)
        before, after = _beside(t)
        features.append(np.concatenate((t.own[t.word], before[:, None], after[:, None]), axis=1).astype(np.int32))
        markers.append((t.markers >> np.uint64(32)).astype(np.uint32)[t.word])
        lengths.append(w.n_words)
    return Sample(np.concatenate(features), np.concatenate(markers), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))))


def apart(hashes: list[np.ndarray], least: int = 16) -> np.ndarray:
    """Which documents (their words' hashes) aren't near-copies of an earlier one: half of the ``least`` smallest hashes in common."""
    seen: dict[int, int] = {}
    keep = np.ones(len(hashes), bool)
    for i, h in enumerate(hashes):
        sketch = np.unique(h)[:least].tolist()
        votes: dict[int, int] = {}
        for x in sketch:
            if (other := seen.get(x)) is not None:
                votes[other] = votes.get(other, 0) + 1
        if sketch and 2 * max(votes.values(), default=0) >= len(sketch):
            keep[i] = False
            continue
        for x in sketch:
            seen.setdefault(x, i)
    return keep


def marked(sample: Sample, toxic: np.ndarray) -> np.ndarray:
    """Which tokens are, or begin like, words that toxic texts (``toxic`` by text) hold far oftener than others."""
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    row = sample.row
    hit = np.zeros(len(row), bool)
    log = lambda k, n, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / n / np.maximum(p, 1e-12)), 0.0)
    for column in sample.markers.T:
        names, of = np.unique(column, return_inverse=True)
        held = np.unique(row * len(names) + of)  # a text counts once
        doc, name = np.divmod(held, len(names))
        a, b = (np.bincount(name[of_kind[doc]], minlength=len(names)).astype(float) for of_kind in (toxic, ~toxic))
        share = (a + b) / (n_toxic + n_other)
        ratio = 2 * (log(a, n_toxic, share) + log(b, n_other, share) + log(n_toxic - a, n_toxic, 1 - share) + log(n_other - b, n_other, 1 - share))
        good = (a >= LEAST_DOCS) & (ratio >= EVIDENCE) & ((a + 0.5) / n_toxic >= ODDS * (b + 0.5) / n_other)
        hit |= good[of]
    return hit & toxic[row]


def fitted(sample: Sample, tags: np.ndarray, rng: np.random.Generator) -> Field:
    """Maximum conditional likelihood of ``tags``, by adaptive gradient steps on batches of texts."""
    features = sample.features
    field = Field(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)), 0.0)
    seen_w, seen_rest = np.full(1 << BITS, 1e-8), np.full(6, 1e-8)
    lengths = np.diff(sample.first)
    opens, rows = sample.opens, np.flatnonzero(lengths)
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        cuts = np.cumsum(lengths[order]) * BATCHES // max(1, len(features))
        for part in np.split(order, np.flatnonzero(np.diff(cuts)) + 1):
            at = sample.tokens_of(part)
            x, y, new = features[at], tags[at], opens[at]
            alpha, beta = forward_backward(m := _potentials(field, field.scores_of(x), new))
            p = (alpha * beta)[1] / (alpha * beta).sum(axis=0)
            off = y - p
            inner = np.flatnonzero(~new)
            pair = np.stack([alpha[i, inner - 1] * m[2 * i + j, inner] * beta[j, inner] for i in (0, 1) for j in (0, 1)])
            expected = (pair / pair.sum(axis=0)).sum(axis=1)
            observed = np.bincount(2 * y[inner - 1].astype(int) + y[inner].astype(int), minlength=4)
            rest = np.array([off.sum(), off[new].sum(), *(observed - expected)])
            touched = np.flatnonzero(np.bincount(x.ravel(), minlength=1 << BITS))
            g = np.bincount(x.ravel(), np.repeat(off, x.shape[1]), 1 << BITS)[touched] - RIDGE * len(at) * field.weights[touched]
            seen_w[touched] += g * g
            field.weights[touched] += RATE * g / np.sqrt(seen_w[touched])
            seen_rest += rest * rest
            step = RATE * rest / np.sqrt(seen_rest)
            field.bias += step[0]
            field.opening += step[1]
            field.links += step[2:].reshape(2, 2)
    return field


def _of_documents(rows: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """(texts, 3): the two largest marginals of each text and the logarithm of one plus their sum, faint ones left out."""
    out = np.zeros((n, 3))
    at = np.flatnonzero(p > FAINT)
    row = rows[at]
    out[:, 2] = np.log1p(np.bincount(row, p[at], n))
    order = np.lexsort((-p[at], row))
    place = np.arange(len(at)) - np.searchsorted(row[order], row[order])
    for k in (0, 1):
        own = order[place == k]
        out[row[own], k] = p[at][own]
    return out


@dataclass
class Model:
    field: Field
    slope: np.ndarray
    level: float

    def document_scores(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(figures @ self.slope + self.level, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Slope and level of a logistic fit by Newton steps; both labels weigh the same."""
    z = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + penalty
        move = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty @ b)
        b += move
        if np.abs(move).max() < 1e-9:
            break
    return b[:-1], float(b[-1])


def fit_texts(texts: list[str], toxic: np.ndarray, seed: int = SEED) -> Model | None:
    """A model of labelled ``texts``; None if one of the labels is missing or no word tells them apart."""
    toxic = np.asarray(toxic, bool)
    if not len(texts) or not toxic.any() or toxic.all():
        return None
    sample = sampled(texts)
    keep = np.flatnonzero(apart(np.split(sample.markers[:, 0], sample.first[1:-1])))
    sample, toxic = sample.of(keep), toxic[keep]
    if not toxic.any() or toxic.all():
        return None
    tags = marked(sample, toxic)
    told = np.bincount(sample.row, tags, len(toxic)) > 0
    if not told.any():
        return None
    use = np.flatnonzero(told | ~toxic)  # toxic texts that no marker tells apart teach no tags
    field = fitted(sample.of(use), tags[sample.tokens_of(use)].astype(float), np.random.default_rng(seed))
    figures = [_of_documents(part.row, marginals(field, field.scores_of(part.features), part.opens), len(rows)) for rows in np.array_split(np.arange(len(toxic)), BATCHES) if len(rows) for part in (sample.of(rows),)]
    return Model(field, *_logistic(np.concatenate(figures), toxic.astype(float)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of a sample of the labelled ``docs`` that are not held out.

    The sample is drawn from the labels, so only texts that are in it leave their tasks; ids and texts are bounded.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    key = F.xxhash64("doc_id", F.lit(SEED))
    picked = []
    for toxic in (True, False):
        bound = int(min(1.0, 3.0 * sample / max(1, counts.get(toxic, 0))) * (1 << 30))
        near = known.where((F.col("toxic") == toxic) & (F.pmod(key, F.lit(1 << 30)) < bound))
        picked += near.orderBy(key, "doc_id").limit(2 * sample).collect()
    if not picked:
        return None
    chosen = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.where(F.length("text") <= most_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 4 * sample rows at most
    once = rows.groupBy("toxic", F.xxhash64("text").alias("t")).agg(F.min(F.struct("doc_id", "text")).alias("r")).select("toxic", "r.*")
    texts = [r for toxic in (True, False) for r in once.where(F.col("toxic") == toxic).orderBy(key, "doc_id", "text").limit(sample).collect()]
    return fit_texts([r["text"] for r in texts], np.array([r["toxic"] for r in texts], bool)) if texts else None


# --- scoring --------------------------------------------------------------------------------------


def _spans(t: Tokens, p: np.ndarray, n: int) -> pa.ListArray:
    """Runs of toxic tokens of each text: start, end (excluded), in code points."""
    hot, row = p >= TOXIC, t.words.row
    link = np.zeros(len(p), bool)
    link[1:] = hot[1:] & hot[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(hot & ~link)
    last = np.flatnonzero(hot & ~np.append(link[1:], False)) if len(p) else first
    upto = np.concatenate(([0], t.chars))
    base = upto[t.words.row_bytes[row[first]]]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(upto[t.start[first]] - base), pa.array(upto[t.end[last]] - base)], ["start", "end"]))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, spans (start, end) of each of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in tk.slices(b.column("text")):
                n = hi - lo
                if model is None:
                    score, spans = np.zeros(n), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["start", "end"]))
                else:
                    t = tokens(w)
                    p = marginals(model.field, model.field.scores(t), t.opens)
                    score, spans = model.document_scores(_of_documents(w.row, p, n)), _spans(t, p, n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(score), spans], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:bigint,end:bigint>>")
