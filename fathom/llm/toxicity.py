"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed, word ends
marked), a window of ``WINDOW`` words the mean of its words, and a softmax of two
classes sits on top. Embeddings and softmax are trained jointly in numpy, on
windows of a bounded sample of labelled documents. Because both averages are
linear, a trained model is one number per n-gram; a misspelling that training
has never seen shares most n-grams, hence most of the score.

Toxic words are sparse, so a segment of ``SEGMENT`` windows is judged by the mean
logit of its highest windows, one in every ``EVERY`` begun; a document's score is
that of its worst segment, whole text read, so neither one chance word condemns a
document nor does a long clean rest hide a toxic passage. Training follows: after
a few epochs over all windows, the label is carried by those highest windows. The
threshold is chosen on held-out documents of the sample.

Defined results: a null, empty or wordless text scores 0 and isn't toxic;
repeated rows score alike; labels with nulls are ignored; without labels of both
classes nothing is rejected.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.shared import arrow_map, quoted

#: Toxic labelled documents that training may use, and twice as many clean ones; the rest of the labels isn't read.
SAMPLE_PER_CLASS = 600
WINDOW = 4
BUCKETS, DIM, RATE, DECAY = 1 << 17, 8, 0.2, 1e-3
SEGMENT, EVERY = 64, 25
#: Epochs, the first of them over all windows; from TRIM_FROM on these shares of clean and of toxic windows, the least like their label, sit out.
EPOCHS, WHOLE_EPOCHS = 20, 2
TRIM_FROM, TRIM = 8, (0.02, 0.05)
GRAMS = (3, 4, 5)
CACHE_WORDS = 1_000_000

_WORDS = re.compile(r"\w+").findall
_EMPTY = np.empty(0, np.int32)


def grams(word: str) -> np.ndarray:
    """Buckets of the n-grams of ``<word>`` and of the word itself."""
    w = f"<{word}>".encode()
    found = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} | {w}
    return np.fromiter((zlib.crc32(g) % BUCKETS for g in sorted(found)), np.int64, len(found))


class _Codes(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


@dataclass
class Model:
    """Logit of an n-gram by bucket, bias, and the threshold of the score; picklable, half a MB."""

    weight: np.ndarray
    bias: float
    threshold: float

    @classmethod
    def none(cls) -> Model:
        return cls(np.zeros(BUCKETS, np.float32), -50.0, 1.0)


class Scorer:
    """Scores texts; remembers the logits of words already met."""

    def __init__(self, model: Model) -> None:
        self.model, self.codes, self.logit = model, _Codes(), np.empty(0)

    def _words(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, _WORDS(text.lower())), np.int32) if text else _EMPTY

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.codes) > CACHE_WORDS:
            self.codes, self.logit = _Codes(), np.empty(0)
        coded = [self._words(t) for t in texts]
        if self.codes.new:
            fresh = np.array([self.model.weight[grams(w)].mean() for w in self.codes.new])
            self.logit, self.codes.new = np.concatenate([self.logit, fresh]), []
        return np.array([self._score(c) for c in coded])

    def _score(self, codes: np.ndarray) -> float:
        n = len(codes)
        if not n:
            return 0.0
        x = self.logit[codes]
        order = np.argsort(codes, kind="stable")
        again = (codes[order[1:]] == codes[order[:-1]]) & (order[1:] // WINDOW == order[:-1] // WINDOW)
        x[order[1:][again]] = 0  # once a window, as in training
        w = np.add.reduceat(x, np.arange(0, n, WINDOW)) / WINDOW
        if len(w) <= SEGMENT:
            m = -(-len(w) // EVERY)
            top = np.partition(w, len(w) - m)[-m:].mean()
        else:  # equal segments, the last one ends where the text does
            at = np.append(np.arange(0, len(w) - SEGMENT, SEGMENT // 2), len(w) - SEGMENT)
            m = -(-SEGMENT // EVERY)
            top = np.sort(w[at[:, None] + np.arange(SEGMENT)], 1)[:, -m:].mean(1).max()
        return float(1 / (1 + np.exp(-np.clip(top + self.model.bias, -50, 50))))


def _train(texts: list[str], y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Adagrad on windows; returns n-gram logits and bias."""
    codes = _Codes()
    rows, label, doc = [], [], []
    for d, (t, c) in enumerate(zip(texts, y)):
        w = np.fromiter(map(codes.__getitem__, _WORDS(t.lower())), np.int64)
        for i in range(0, len(w), WINDOW):
            rows.append(np.unique(w[i : i + WINDOW]))
            label.append(c)
            doc.append(d)
    parts = [grams(w) for w in codes.new]
    size = np.array([len(p) for p in parts])
    start, flat = np.cumsum(size) - size, np.concatenate(parts)
    label, doc = np.array(label), np.array(doc)
    most = -(-np.bincount(doc, minlength=len(texts)) // EVERY)
    held = np.array([len(r) for r in rows])
    row_word, row_start = np.concatenate(rows), np.cumsum(held) - held
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        order = np.arange(len(rows))
        if epoch >= WHOLE_EPOCHS:  # the highest windows of each document carry its label
            logit = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[flat], start) / size
            rank = np.lexsort((-np.add.reduceat(logit[row_word], row_start), doc))
            nth = np.arange(len(rank)) - np.searchsorted(doc, doc[rank])
            order = rank[nth < most[doc[rank]]]
            if epoch >= TRIM_FROM:  # wrong labels: toxic documents without a toxic window, clean ones with one
                top, c = np.add.reduceat(logit[row_word], row_start)[order], label[order]
                low = np.quantile(top[c == 1], TRIM[1]) if (c == 1).any() else -np.inf
                high = np.quantile(top[c == 0], 1 - TRIM[0]) if (c == 0).any() else np.inf
                order = order[np.where(c == 1, top >= low, top <= high)]
        share = np.maximum(np.bincount(label[order], minlength=2), 1)
        weight = (len(order) / 2 / share)[label]
        order = rng.permutation(order)
        for k in range(0, len(order), 256):
            pick = order[k : k + 256]
            words = np.concatenate([rows[i] for i in pick])
            per = np.array([len(rows[i]) for i in pick])
            s = size[words]
            end = np.cumsum(s)
            at = np.arange(end[-1]) + np.repeat(start[words] - (end - s), s)
            idx = flat[at]
            row = np.repeat(np.repeat(np.arange(len(pick)), per), s)
            w = (1 / (WINDOW * s)).astype(np.float32).repeat(s)
            begin = np.concatenate([[0], np.cumsum(np.add.reduceat(s, np.cumsum(per) - per))[:-1]])
            hidden = np.add.reduceat(emb[idx] * w[:, None], begin)
            z = hidden @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            d = (p * weight[pick][:, None] / len(pick)).astype(np.float32)
            back = d @ out.T
            for par, acc, g in ((out, g_out, hidden.T @ d), (bias, g_bias, d.sum(0))):
                acc += g * g
                par -= RATE * g / np.sqrt(acc)
            grad = np.stack([np.bincount(idx, w * back[row, j], BUCKETS) for j in range(DIM)], 1).astype(np.float32)
            hit = np.flatnonzero(np.bincount(idx, minlength=BUCKETS))
            grad = grad[hit]
            g_emb[hit] += (grad * grad).mean(1)
            emb[hit] = emb[hit] * (1 - DECAY) - RATE * grad / np.sqrt(g_emb[hit])[:, None]
    both = out[:, 1] - out[:, 0]
    return emb @ both, float(bias[1] - bias[0])


def fit(texts: list[str], toxic: list[int], clean_weight: float = 1.0, seed: int = 7) -> Model:
    """A model of the texts that have words; a fifth of them is held out for the threshold.

    ``clean_weight``: how many clean documents a clean one of the sample stands for, next to a toxic one.
    """
    have = [(t, int(c)) for t, c in zip(texts, toxic) if t and c is not None and _WORDS(t)]
    y = np.array([c for _, c in have], np.int64)
    if len(set(y.tolist())) < 2:
        return Model.none()
    hold = np.random.default_rng(seed).permutation(len(y)) % 5 == 0
    if len(set(y[hold].tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        hold = np.ones(len(y), bool)  # too few to hold any out
        weight, bias = _train([t for t, _ in have], y, seed)
    else:
        weight, bias = _train([t for (t, _), h in zip(have, hold) if not h], y[~hold], seed)
    model = Model(weight, bias, 0.5)
    s = Scorer(model).scores([t for (t, _), h in zip(have, hold) if h])
    # the gap with the fewest weighted errors; in the middle of it, on the logit scale
    logit = np.log(np.clip(s, 1e-9, 1) / np.clip(1 - s, 1e-9, 1))
    cuts = np.unique(logit)
    mids = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    yh = y[hold]
    errors = np.array([clean_weight * ((logit > m) & (yh == 0)).sum() + ((logit <= m) & (yh == 1)).sum() for m in mids])
    best = np.flatnonzero(errors == errors.min())
    m = float(mids[best[np.argmax(np.diff(cuts)[best])]]) if len(cuts) > 1 else float(mids[0])
    model.threshold = float(1 / (1 + np.exp(-m)))
    return model


def fit_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``per_class`` toxic and twice as many clean labelled documents, drawn by a hash of the id.

    Only ids and labels are ranked; the sample (bounded, so safe to broadcast)
    is then met by one scan of the texts. Of ids that occur in several rows the
    least text counts.
    """
    ids = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    ids = ids.groupBy("id").agg(F.max("y").alias("y"))
    rank = F.xxhash64("id", F.lit("toxicity"))
    have = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    clean_weight = max(1.0, (have.get(0, 0) / min(max(have.get(0, 0), 1), 2 * per_class)) / (max(have.get(1, 0), 1) / min(max(have.get(1, 0), 1), per_class)))
    picked = ids.filter("y = 1").orderBy(rank, "id").limit(per_class).unionAll(ids.filter("y = 0").orderBy(rank, "id").limit(2 * per_class))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    got = sorted(((r.id, r.text, r.y) for r in rows.collect()), key=lambda r: r[0])
    return fit([t for _, t, _ in got], [y for _, _, y in got], clean_weight)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``toxicity`` and ``is_toxic``; they replace columns of these names. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer, cut = Scorer(held.value), held.value.threshold

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            s = scorer.scores(b.column(0).to_pylist())
            return [pa.array(np.round(s, 6)), pa.array(s > cut)]

        return batch

    fields = [T.StructField("toxicity", T.DoubleType()), T.StructField("is_toxic", T.BooleanType())]
    return arrow_map(docs, [text_col], docs.columns if keep is None else keep, fields, make)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, columns as they were."""
    flag = "__toxic"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer, cut = Scorer(held.value), held.value.threshold
        return lambda b: [pa.array(scorer.scores(b.column(0).to_pylist()) > cut)]

    return arrow_map(docs, [text_col], docs.columns, [T.StructField(flag, T.BooleanType())], make).filter(~F.col(flag)).drop(flag)
