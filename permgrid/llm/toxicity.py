"""Toxicity by a classifier chain (operator 8).

Categories are predicted one after the other: disruptive writing, toxic, severely toxic.
Each has a linear (logistic) model on the words and word beginnings of a text; the models
of later categories also get the probabilities of the earlier ones.  For training these
come out of fold: every labelled document is scored by models that have not seen it, so a
later model learns how far an earlier one can be trusted.

Features are the presence of words and of their first four and five bytes, hashed to
``2**BITS`` cells; each model picks the ``n_features`` cells that tell its category apart
best, within the documents it learns from, and scales each by its log odds.

Training uses a bounded sample of labelled rows, ``max_positive`` of each rare class and
``max_negative`` others, those with the lowest hash of their id.  All documents are scored.
Severe is no label of its own: a toxic document is severe when the share of its words that
tell toxic documents apart is at least that of the median toxic document.

A text is rejected when its probability of being toxic reaches the threshold and its own words speak for it:
a text of words that the model does not use has the share of toxic labels as its probability and stays,
however large that share is.

Edge cases: a null or empty text has no features, gets the models' base rates and is never rejected; without
usable labels, or with labels of one class only, probabilities are that class's share;
repeated rows and ids give a row each; labels of unknown documents and null labels are
ignored; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import text_batches
from permgrid.llm.wordhash import WordHasher, alnum_separators, mix, small_batches

BITS = 20
CATEGORIES = ["disruptive", "toxic", "severe"]




def _kind(chars):
    t = np.zeros(256, np.int8)
    t[list(chars.encode())] = 1
    return t


STYLE = {"upper": _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "symbols": _kind("*$%&#~^<>{}[]|"), "shouts": _kind("!?"),
         "digits": _kind("0123456789")}


class TextFeatures:
    def __init__(self):
        self.hasher = WordHasher(alnum_separators(), seed=11)

    def __call__(self, texts):
        """One sorted array of distinct cells per text, and its number of distinct words."""
        s, e, counts, data, off, h = self.hasher.spans(texts)
        cells = [(h >> np.uint64(64 - BITS)).astype(np.int32)]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for n in (4, 5):
            p = np.full(len(s), n * 0x5851F42D4C957F2D % 2**64, np.uint64)
            for i in range(n):
                p += self.hasher.value[padded[s + i]] * self.hasher.coef[i]
            cell = (mix(p) >> np.uint64(64 - BITS)).astype(np.int32)
            cell[e - s <= n] = -1
            cells.append(cell)
        cells = np.stack(cells, 1)
        style = self.style(data, off)
        at = 0
        for n, m in enumerate(counts.tolist()):
            u = np.unique(cells[at:at + m])
            u = u[1:] if len(u) and u[0] < 0 else u
            yield np.union1d(u, style[n]) if m else u
            at += m

    @staticmethod
    def style_cell(step, kind):
        return (mix(step + np.uint64((kind + 1) << 32)) >> np.uint64(64 - BITS)).astype(np.int32)

    def style(self, data, off):
        """Cells for how large a share of a text's bytes is of each kind, in steps."""
        out = np.zeros((len(off) - 1, len(STYLE)), np.int32)
        for k, table in enumerate(STYLE.values()):
            c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
            share = (c[off[1:]] - c[off[:-1]]) / np.maximum(np.diff(off), 1)
            step = np.ceil(np.minimum(share * 40, 15)).astype(np.uint64)
            out[:, k] = self.style_cell(step, k)
        return out


STYLE_CELLS = np.concatenate([TextFeatures.style_cell(np.arange(16, dtype=np.uint64), k) for k in range(len(STYLE))])


def _features(batches):
    import pyarrow as pa
    make = TextFeatures()
    for b in small_batches(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(make(b.column(1))), pa.list_(pa.int32()))], names=["doc", "cells"])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class LinearModel:
    """Logistic regression on the cells that tell the classes apart best, and extra inputs."""

    def __init__(self, n_features=600, penalty=1e-3, rounds=250):
        self.n_features, self.penalty, self.rounds = n_features, penalty, rounds

    def fit(self, docs, extra, y):
        n, pos = len(y), float(y.sum())
        self.cells, self.weights = np.zeros(0, np.int32), np.zeros(0)
        self.extra, self.prior = np.zeros(extra.shape[1]), (pos + 0.5) / (n + 1.0)
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        if pos == 0 or pos == n:
            return self
        length = np.array([len(d) for d in docs])
        flat = np.concatenate(docs) if length.sum() else np.zeros(0, np.int32)
        on = np.bincount(flat, weights=np.repeat(y, length), minlength=1 << BITS)
        every = np.bincount(flat, minlength=1 << BITS).astype(float)
        a, b, share = on / pos, (every - on) / (n - pos), every / n
        apart = (a - b) / np.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)) + 1e-12)
        apart[every < 3] = 0
        # a cell that stands in few documents of the other class counts as strong evidence too
        order = np.argsort(-np.abs(apart), kind="stable")[:self.n_features]
        self.cells = np.sort(order[apart[order] != 0]).astype(np.int32)
        # cells count by their log odds, so that one telling word outweighs many common ones
        odds = np.log((on + 0.5) / (pos + 1)) - np.log((every - on + 0.5) / (n - pos + 1))
        odds = odds[self.cells].astype(np.float32)
        x = np.concatenate([self.matrix(docs) * odds, extra.astype(np.float32)], 1)
        y = y.astype(np.float32)
        w, v, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0
        bias, bv = np.float32(self.bias), np.float32(self.bias)
        balance = np.minimum(np.where(y > 0, 0.5 * n / pos, 0.5 * n / (n - pos)), 5.0).astype(np.float32)
        step = np.float32(1.0 / (0.25 * _largest(x) / n * float(balance.max()) + self.penalty))
        for _ in range(self.rounds):
            g = (sigmoid(x @ v + bv) - y) * balance
            w2, b2 = v - step * (g @ x / np.float32(n) + np.float32(self.penalty) * v), bv - step * g.mean()
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            m = np.float32((t - 1) / t2)
            v, bv = w2 + m * (w2 - w), b2 + m * (b2 - bias)
            w, bias, t = w2, b2, t2
        k = len(self.cells)
        self.weights, self.extra, self.bias = w[:k] * odds, w[k:], float(bias)
        return self

    def matrix(self, docs):
        x = np.zeros((len(docs), len(self.cells)), np.float32)
        for r, d in enumerate(docs):
            x[r, np.searchsorted(self.cells, d[np.isin(d, self.cells, assume_unique=True)])] = 1
        return x

    def table(self):
        w = np.zeros(1 << BITS, np.float32)
        w[self.cells] = self.weights
        return w

    def score(self, docs, extra):
        w = self.table()
        return sigmoid(np.array([w[d].sum() for d in docs]) + extra @ self.extra + self.bias)


def _largest(x):
    """Largest eigenvalue of x'x by a few power steps."""
    v = np.full(x.shape[1], x.shape[1] ** -0.5, x.dtype)
    for _ in range(12):
        v = (x @ v) @ x
        size = np.linalg.norm(v)
        if size == 0:
            return 1.0
        v /= size
    return float(size)


def fit_chain(docs, labels, folds=4, **options):
    """Models of a chain over label columns; later ones see out-of-fold earlier probabilities."""
    n, fold = len(docs), np.arange(len(docs)) % folds
    earlier, models = np.zeros((n, 0)), []
    for y in labels:
        out = np.zeros(n)
        for f in range(folds if n >= 2 * folds else 0):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m = LinearModel(**options).fit([docs[i] for i in a], earlier[a], y[a])
            out[b] = m.score([docs[i] for i in b], earlier[b])
        models.append(LinearModel(**options).fit(docs, earlier, y))
        earlier = np.concatenate([earlier, out[:, None]], 1)
    return models


def severe(docs, toxic):
    """Toxic documents whose share of cells that tell toxic ones apart reaches the median."""
    if not toxic.any():
        return np.zeros(len(docs))
    flat, length = np.concatenate(docs), np.array([len(d) for d in docs])
    on = np.bincount(flat, weights=np.repeat(toxic, length), minlength=1 << BITS)
    off = np.bincount(flat, weights=np.repeat(1 - toxic, length), minlength=1 << BITS)
    odds = np.log((on + 0.1) / (toxic.sum() + 0.2)) - np.log((off + 0.1) / ((1 - toxic).sum() + 0.2))
    strong = (odds > 3) & (on >= 5)
    share = np.array([strong[d].mean() if len(d) else 0.0 for d in docs])
    return ((toxic > 0) & (share >= np.median(share[toxic > 0]))).astype(float)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 3000, id_col: str = "doc_id",
          text_col: str = "text"):
    """Chain models from the bounded sample of ``labels`` (doc_id, quality, toxic)."""
    text_batches(docs.sparkSession)
    known = (labels.select(F.col(id_col).cast("long").alias("doc"), "quality", "toxic")
             .where("doc is not null and quality is not null and toxic is not null")
             .groupBy("doc").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    pick = lambda where, n: known.where(where).orderBy(F.xxhash64("doc"), "doc").limit(n)
    sample = (pick("toxic <> 0", max_positive).unionByName(pick("toxic = 0 and quality = 0", max_positive))
              .unionByName(pick("toxic = 0 and quality <> 0", max_negative)))
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = (text.join(F.broadcast(sample.select("doc")), "doc", "left_semi")  # bounded by the limits above
            .mapInArrow(_features, "doc long, cells array<int>").join(sample, "doc")
            .select("doc", "cells", "quality", "toxic").toPandas())
    rows = rows.drop_duplicates("doc").sort_values("doc", key=lambda s: mix(s.to_numpy().astype(np.uint64))).reset_index(drop=True)
    cells = [np.asarray(c, np.int32) for c in rows.cells]
    toxic = (rows.toxic.to_numpy() != 0).astype(float)
    return fit_chain(cells, [(rows.quality.to_numpy() == 0).astype(float), toxic, severe(cells, toxic)])


def _score(shared, threshold):
    def run(batches):
        import pyarrow as pa
        make = TextFeatures()
        models = shared.value
        for b in small_batches(batches, 1):
            docs, p = list(make(b.column(1))), np.zeros((len(b), 0))
            for cells, weights, extra, bias in models:
                w = np.zeros(1 << BITS, np.float32)
                w[cells] = weights
                told = np.array([w[d].sum() for d in docs])
                if p.shape[1] == CATEGORIES.index("toxic"):
                    w[STYLE_CELLS] = 0
                    speaks = np.array([w[d].sum() for d in docs]) > 0  # its words, not its style or the share of labels
                z = told + (p @ extra if p.shape[1] else 0.0) + bias
                p = np.concatenate([p, sigmoid(z)[:, None]], 1)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(p[:, i]) for i in range(p.shape[1])]
                                             + [pa.array((p[:, 1] >= threshold) & speaks)],
                                             names=["doc", *(f"p_{c}" for c in CATEGORIES), "rejected"])
    return run


def score(docs: DataFrame, models, threshold: float = 0.45, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability of each category per document, and whether it is rejected as toxic."""
    small = [(m.cells, m.weights.astype(np.float32), m.extra, m.bias) for m in models]
    shared = docs.sparkSession.sparkContext.broadcast(small)  # n_features weights a category
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(shared, threshold), "doc long, p_disruptive double, p_toxic double, p_severe double, rejected boolean")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: doc_id, a probability per category, rejected."""
    return score(docs, train(docs, labels)).withColumnRenamed("doc", "doc_id")


def drop_toxic(docs: DataFrame, training_docs: DataFrame, labels: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``docs`` without rejected ones; models learn from ``training_docs`` and ``labels``."""
    models = train(training_docs, labels)
    small = [(m.cells, m.weights.astype(np.float32), m.extra, m.bias) for m in models]
    shared = docs.sparkSession.sparkContext.broadcast(small)
    wide = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))

    def keep(batches):
        import pyarrow as pa
        slices = []

        def told():
            for b in small_batches(batches, 1):
                slices.append(b)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column(1)], names=["doc", "text"])
        # the scorer gives one batch of verdicts for each slice, in order
        for verdict in _score(shared, threshold)(told()):
            kept = slices.pop(0).column(0).filter(pa.array([not r for r in verdict.column(verdict.num_columns - 1).to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept], names=["row"])
    schema = wide.select("row").schema
    return wide.mapInArrow(keep, schema).select("row.*")
