"""Document quality by a linear-chain conditional random field over lines (operator 9).

Every line of a text is labelled good or bad.  A line's evidence is its own shape (shares
of upper case, symbols, bars and digits, word lengths, repeated words) and that of
the lines before and after it; the chain adds how good and bad lines follow each other.
Marginals come from the forward-backward recursion, and their mean, weighted by line
length, becomes the score through a logistic calibration fitted on the training rows.

Training learns from a bounded sample of labelled rows, at most ``max_rows`` per class with the
lowest hash of their id, and never from held-out rows: a row is held out when
crc32(doc_id as text) mod 5 is 0.  Lines start with their document's label; then, once, lines
of bad documents that the model finds good become good, and the model learns again.

Edge cases: a null or empty text has no lines and gets the share of good rows in training;
white-space lines count as empty lines and weigh nothing, and a text of only such lines is
an empty text; without usable labels the score is 0.5; with one class only it is that class's
share; repeated rows and ids give a row each; null ids are not held out; labels, language, source and
other columns are no inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import text_batches
from permgrid.llm.wordhash import WordHasher, mix, small_batches, space_separators

N_SHAPE = 15


def _kinds():
    t = np.zeros((7, 256), np.int8)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "*$%&#~^<>{}[]@\\_=+/", "|", "!?", "0123456789", ".,;:", " \t")):
        t[k, list(chars.encode())] = 1
    return t


class LineShapes:
    """Features of the lines of a batch of texts."""

    def __init__(self):
        self.hasher, self.kinds = WordHasher(space_separators(), seed=5), _kinds()

    def __call__(self, texts):
        """(features lines x D, weights, lines per text) with neighbours' shapes included."""
        s, e, _, data, off, h = self.hasher.spans(texts)
        newline = np.flatnonzero(data == 10)
        # lines: from a text's start or after a newline, up to the next newline or the text's end
        begin = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], newline + 1]))
        begin = begin[begin < len(data)] if len(data) else np.zeros(0, np.int64)
        begin = begin.astype(np.int64)
        end = np.concatenate([begin[1:], [len(data)]])[:len(begin)]
        size = (end - begin).astype(float)
        a, b = np.searchsorted(s, begin), np.searchsorted(s, end)
        words = (b - a).astype(float)
        keep = words > 0
        begin, end, size, a, b, words = (x[keep] for x in (begin, end, size, a, b, words))
        lines = np.diff(np.searchsorted(begin, off))
        n = len(begin)
        x = np.zeros((n, N_SHAPE))
        for k in range(7):
            c = np.concatenate([[0], np.cumsum(self.kinds[k][data], dtype=np.int64)])
            x[:, k] = (c[end] - c[begin]) / np.maximum(size, 1)
        c = np.concatenate([[0], np.cumsum(data >= 0x80, dtype=np.int64)])
        x[:, 7] = (c[end] - c[begin]) / np.maximum(size, 1)
        again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
        c = np.concatenate([[0], np.cumsum(again, dtype=np.int64)])
        x[:, 8] = (c[b] - c[a]) / np.maximum(words, 1)
        length = (e - s).astype(float)
        c = np.concatenate([[0.0], np.cumsum(length)])
        x[:, 9] = (c[b] - c[a]) / np.maximum(words, 1) / 10
        line = np.repeat(np.arange(n), (b - a).astype(int))
        key = mix(h)
        pair = np.lexsort((key, line)) if len(line) else np.zeros(0, np.int64)
        if len(pair):
            fresh = np.concatenate([[True], (key[pair][1:] != key[pair][:-1]) | (line[pair][1:] != line[pair][:-1])])
            x[:, 10] = np.bincount(line[pair][fresh], minlength=n) / np.maximum(words, 1)
        x[:, 11] = np.log1p(words) / 5
        x[:, 12] = np.log1p(size) / 8
        total = np.zeros(n, np.uint64)
        if len(line):
            c = np.concatenate([[np.uint64(0)], np.cumsum(key, dtype=np.uint64)])
            total = c[b] - c[a]
        first = np.concatenate([[0], np.cumsum(lines)])[:-1]
        same = np.concatenate([[False], total[1:] == total[:-1]]) if n else np.zeros(0, bool)
        same[first[lines > 0]] = False
        x[:, 13] = same
        x[:, 14] = 1.0
        before, after = np.zeros_like(x), np.zeros_like(x)
        if n:
            before[1:], after[:-1] = x[:-1], x[1:]
            before[first[lines > 0]] = 0
            after[np.cumsum(lines)[lines > 0] - 1] = 0
        return np.concatenate([x, before, after], 1), size, lines


def chain_marginals(emit, trans, lines):
    """P(good) of each line and the normaliser of each chain; ``emit`` is the score of good.

    Chains are worked through side by side, sorted by length, one position at a time.
    Scores: emit for good and 0 for bad, trans[i, j] from state i to state j.
    """
    lines = np.asarray(lines)
    order = np.argsort(-lines, kind="stable")
    order = order[lines[order] > 0]
    length = lines[order]
    first = np.concatenate([[0], np.cumsum(lines)])[:-1][order]
    n, steps = len(order), int(length[0]) if len(order) else 0
    alive = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # chains with more than t lines
    fwd, bwd = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    norm, pairs = np.zeros(len(lines)), np.zeros((2, 2))
    score = np.stack([np.zeros(len(emit)), emit], 1)
    now = None
    for t in range(steps):
        k = alive[t]
        at = first[:k] + t
        if t == 0:
            now = score[at]
        else:
            now = np.logaddexp.reduce(now[:k, :, None] + trans[None], axis=1) + score[at]
        fwd[at] = now
    last = first + length - 1
    norm[order] = np.logaddexp(fwd[last, 0], fwd[last, 1])
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        at = first[:k] + t
        bwd[at] = np.logaddexp.reduce(trans[None] + (score[at + 1] + bwd[at + 1])[:, None, :], axis=2)
        p = fwd[at][:, :, None] + trans[None] + (score[at + 1] + bwd[at + 1])[:, None, :] - norm[order[:k]][:, None, None]
        pairs += np.exp(p).sum(0)
    z = np.repeat(norm, lines)
    return np.exp(np.minimum(fwd[:, 1] + bwd[:, 1] - z, 0.0)), norm, pairs


class LineField:
    def fit(self, x, lines, y, rounds=60, penalty=1e-3):
        """Maximum conditional likelihood of line labels ``y`` by Adam steps on all chains."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.concatenate([z, np.ones((len(z), 1))], 1)
        d = z.shape[1]
        theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
        inside = np.ones(len(y), bool)
        ends = np.cumsum(lines)[lines > 0]
        inside[ends - 1] = False
        at = np.flatnonzero(inside)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
        for r in range(1, rounds + 1):
            good, _, pairs = chain_marginals(z @ theta[:d], theta[d:].reshape(2, 2), lines)
            g = np.concatenate([z.T @ (good - y), (pairs - seen).ravel()]) / len(y) + penalty * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        self.weights, self.trans = theta[:d], theta[d:].reshape(2, 2)
        return self

    def good(self, x, lines):
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return chain_marginals(z @ self.weights[:-1] + self.weights[-1], self.trans, lines)[0]


def document_share(good, size, lines):
    """Length-weighted mean of the marginals per text; NaN without lines."""
    doc = np.repeat(np.arange(len(lines)), lines)
    weight = np.bincount(doc, weights=size, minlength=len(lines))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, weights=good * size, minlength=len(lines)) / weight


class QualityModel:
    def fit(self, x, size, lines, labels, relabel=1):
        self.prior = float((labels.sum() + 0.5) / (len(labels) + 1.0))
        self.field = None
        if not len(labels) or labels.min() == labels.max() or not len(x):
            return self
        doc_y = np.repeat(labels, lines).astype(float)
        y = doc_y.copy()
        for r in range(relabel + 1):
            self.field = LineField().fit(x, lines, y)
            good = self.field.good(x, lines)
            if r < relabel:
                y = np.where((doc_y == 0) & (good > 0.5), 1.0, doc_y)
                share = document_share(y, size, lines)  # a bad document keeps a bad line
                whole = np.repeat((share == 1.0) & (labels == 0), lines)
                y[whole] = 0.0
        share = document_share(good, size, lines)
        ok = ~np.isnan(share)
        u, t = self._logit(share[ok]), labels[ok].astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a one-input logistic regression
            p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
            w, e = p * (1 - p) + 1e-6, p - t
            h = np.array([[(w * u * u).sum() + 1.0, (w * u).sum()], [(w * u).sum(), w.sum() + 1.0]])
            d = np.linalg.solve(h, [(e * u).sum() + (a - 1), e.sum()])
            a, b = a - d[0], b - d[1]
        self.a, self.b = float(max(a, 1e-3)), float(b)
        return self

    @staticmethod
    def _logit(p):
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, x, size, lines):
        out = np.full(len(lines), self.prior)
        if self.field is not None and len(x):
            share = document_share(self.field.good(x, lines), size, lines)
            ok = ~np.isnan(share)
            out[ok] = 1 / (1 + np.exp(-np.clip(self.a * self._logit(share[ok]) + self.b, -30, 30)))
        return out


def held_out(col):
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _shapes(batches):
    import pyarrow as pa
    make = LineShapes()
    for b in small_batches(batches, 1):
        x, size, lines = make(b.column(1))
        off = np.concatenate([[0], np.cumsum(lines)])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x[p:q].astype("<f4").tobytes() for p, q in zip(off[:-1], off[1:])], pa.binary()),
             pa.array([size[p:q].astype("<f4").tobytes() for p, q in zip(off[:-1], off[1:])], pa.binary())],
            names=["doc", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """The model from at most ``max_rows`` labelled rows of each class that are not held out."""
    text_batches(docs.sparkSession)
    known = (labels.select(F.col(id_col).cast("long").alias("doc"), F.col("quality").cast("int").alias("quality"))
             .where("doc is not null and quality is not null").where(~held_out(F.col("doc")))
             .groupBy("doc").agg(F.min("quality").alias("quality")))
    pick = lambda where: known.where(where).orderBy(F.xxhash64("doc"), "doc").limit(max_rows)
    sample = pick("quality = 0").unionByName(pick("quality <> 0"))
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = (text.join(F.broadcast(sample.select("doc")), "doc", "left_semi")  # at most 2 * max_rows ids
            .mapInArrow(_shapes, "doc long, x binary, size binary").join(sample, "doc").toPandas())
    rows = rows.sort_values(["doc", "x"]).drop_duplicates("doc").reset_index(drop=True)
    d = 3 * N_SHAPE
    xs = [np.frombuffer(v, "<f4").reshape(-1, d) for v in rows.x]
    x = np.concatenate(xs).astype(float) if xs else np.zeros((0, d))
    size = np.concatenate([np.frombuffer(v, "<f4") for v in rows["size"]]).astype(float) if xs else np.zeros(0)
    lines = np.array([len(v) for v in xs], int)
    return QualityModel().fit(x, size, lines, (rows.quality.to_numpy() != 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """The query: doc_id, held_out, score and predicted per document."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    field = model.field.__dict__ if model.field else None
    shared = docs.sparkSession.sparkContext.broadcast({**model.__dict__, "field": field})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        make, model = LineShapes(), QualityModel()
        model.__dict__.update(shared.value)
        if model.field is not None:
            model.field = LineField()
            model.field.__dict__.update(shared.value["field"])
        for b in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(*make(b.column(1))))], names=["doc_id", "score"])
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
