"""Language-model scores by a log-bilinear neural model (operator 13).

Tokens are words between white space with ``A`` to ``Z`` lower-cased, and one end per document.  Spark
counts all tokens; the counts grow with the corpus and give the base score (add-half unigrams).

**Model.**  The ``words`` most frequent training tokens and ``classes`` classes of all other words (by
their last two bytes) have a context vector ``R``, a target vector ``Q`` and a bias ``b``.  The vectors of
the tokens before predict ``q = sum_j C_j * R[w_j]`` (``C_j`` diagonal) and a token scores ``Q[w].q + b[w]``.
The softmax over all targets, computed for the distinct contexts of a slice as one matrix product, gives
normalised log probabilities; a word of a class is multiplied by its add-half share of the class, in which
all unseen words have one share together.  So the probabilities of a context sum up to one.

**Training.**  Noise-contrastive estimation in numpy, with noise from the unigram distribution shared by a
minibatch.  In every round each partition trains a copy of the model on all of its training documents, and
the copies are averaged, weighted by tokens, in groups of at most 64 until 64 are left.  All training
documents take part; what reaches the driver is the model, of a size fixed by the parameters.

**Counts at scoring.**  Counts of frequent words (at most ``frequent``) are broadcast.  Other words of a
document are joined with the counts by shuffling; each of these has fewer rows than the limiting count, so
no key is hot.  Scores of a batch are written once below ``spark.checkpoint.dir``.

Edge cases: a null or empty text is the end alone; a null id counts as empty text in the hash that picks
held-out documents; long texts are worked through whole; repeated rows count as often as they occur; ties
between words of equal count go by their hash; without training documents the model is uniform over its
classes and the base score is 0; an empty table gives no rows; other columns are ignored, whatever their names.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.alignment import frequent_from
from permgrid.llm.links import text_batches
from permgrid.llm.wordhash import WordHasher, mix, small_batches, space_separators
from permgrid.session import scratch_path

END = 0  # stands for a document's end among the word hashes
SLICE = 4 << 20  # bytes of text worked on at once; contexts repeat more often in larger slices
COUNTS = "h long, cls int, c_all long, c_train long"


@dataclass(frozen=True)
class Settings:
    """Size of the model and of its training; none of them limits the rows that are read."""

    words: int = 640
    classes: int = 128
    dim: int = 32
    context: int = 2
    rounds: int = 2
    batch: int = 512
    noise: int = 64
    rate: float = 0.15
    folds: int = 5
    held_fold: int = 1
    frequent: int = 250_000

    @property
    def targets(self) -> int:
        return self.words + self.classes


class Tokens:
    """Tokens of Arrow batches: hashes with an end after every text, classes and places."""

    def __init__(self, s: Settings):
        self.hasher, self.s = WordHasher(space_separators()), s
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.lower = lower

    def of(self, texts):
        """(hash, class, document) of every token, and the first token's place per document."""
        starts, ends, counts, data, _, h = self.hasher.spans(texts)
        last = self.lower[data[ends - 1]] if len(ends) else np.zeros(0, np.uint64)
        before = np.where(ends - starts > 1, self.lower[data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64) if len(ends) else last
        cls = (mix(last * np.uint64(256) + before) % np.uint64(self.s.classes)).astype(np.int32)
        n = len(counts)
        size = counts + 1
        first = np.concatenate([[0], np.cumsum(size)])
        is_end = np.zeros(first[-1], bool)
        is_end[first[1:] - 1] = True
        out_h, out_c = np.full(first[-1], END, np.int64), np.zeros(first[-1], np.int32)
        out_h[~is_end], out_c[~is_end] = h.view(np.int64), cls
        return out_h, out_c, np.repeat(np.arange(n), size), first


def held_out(ids, s: Settings):
    from zlib import crc32
    return np.array([crc32(b"" if i is None else str(i).encode()) % s.folds == s.held_fold for i in ids], bool)


def _count_task(batches, s, held=500_000):
    import pyarrow as pa
    tok, kept, rows = Tokens(s), [], 0

    def merged():
        t = pa.concat_tables(kept).group_by(["h", "cls"], use_threads=False).aggregate([("c_all", "sum"), ("c_train", "sum")])
        return t.rename_columns(["h", "cls", "c_all", "c_train"])

    for b in small_batches(batches, 1):
        h, cls, doc, _ = tok.of(b.column(1))
        train = ~held_out(b.column(0).to_pylist(), s)
        kept.append(pa.table({"h": h, "cls": cls, "c_all": np.ones(len(h), np.int64), "c_train": train[doc].astype(np.int64)}))
        rows += len(h)
        if rows >= held:
            kept, rows = [merged()], 0
            if len(kept[0]) >= held:
                yield from kept.pop().to_batches()
    if kept:
        yield from merged().to_batches()


def token_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """(h, cls, c_all, c_train) per distinct token of (id, text) rows, written and read again."""
    spark = docs.sparkSession
    partial = docs.mapInArrow(lambda it: _count_task(it, s), COUNTS)
    path = scratch_path(spark, "token_counts")
    partial.groupBy("h", "cls").agg(F.sum("c_all").alias("c_all"), F.sum("c_train").alias("c_train")).write.parquet(path)
    return spark.read.schema(COUNTS).parquet(path)


class Vocabulary:
    """The model's targets and what turns counts into probabilities; of a size fixed by the settings."""

    def __init__(self, s: Settings, top, per_class, total: int, distinct: int):
        """``top``: (h, cls, c_train) of the chosen words; ``per_class``: (cls, sum, words) of all seen words."""
        self.total, self.distinct = total, distinct
        rows = sorted(top)
        self.h = np.array([r[0] for r in rows], np.int64)
        mass, words = np.zeros(s.classes), np.zeros(s.classes)
        for c, m, n in per_class:
            mass[c], words[c] = m, n
        for h, c, n in rows:
            if n > 0:
                mass[c] -= n
                words[c] -= 1
        self.class_size = mass + 0.5 * (words + 1)  # divisor of the shares within a class
        weight = np.zeros(s.targets)
        weight[:len(rows)] = [r[2] for r in rows]
        weight[s.words:] = self.class_size
        self.used = weight > 0
        self.noise = weight / weight.sum()

    def targets(self, h, cls, s: Settings):
        """Target per token: its word's, else its class's."""
        if not len(self.h):
            return s.words + cls
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, s.words + cls).astype(np.int64)

    def base_divisor(self):
        return self.total + 0.5 * (self.distinct + 1)


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    seen = counts.where("c_train > 0")
    top = seen.where(F.col("h") != END).orderBy(F.desc("c_train"), "h").limit(s.words - 1).collect()
    ends = seen.where(F.col("h") == END).collect()
    per_class = seen.groupBy("cls").agg(F.sum("c_train").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    rows = [(r["h"], r["cls"], r["c_train"]) for r in [*top, *ends]]
    return Vocabulary(s, rows, [(r["cls"], r["m"], r["n"]) for r in per_class],
                      sum(r["m"] for r in per_class), sum(r["n"] for r in per_class))


# --- the model: one flat array of parameters ------------------------------------

def _shapes(s):
    return [("R", (s.targets, s.dim)), ("Qb", (s.targets, s.dim + 1)), ("C", (s.context, s.dim))]


def unpack(flat, s: Settings) -> dict:
    """Views into ``flat``: R, C, and Q with the biases b as its last column."""
    out, at = {}, 0
    for name, shape in _shapes(s):
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out | {"Q": out["Qb"][:, :-1], "b": out["Qb"][:, -1]}


def start(v: Vocabulary, s: Settings):
    """Small random vectors; biases make the untrained model the unigram distribution."""
    rng = np.random.default_rng(11)
    flat = np.zeros(sum(int(np.prod(shape)) for _, shape in _shapes(s)), np.float32)
    p = unpack(flat, s)
    p["R"][:] = rng.normal(0, 0.3, p["R"].shape)
    p["Q"][:] = rng.normal(0, 0.1, p["Q"].shape)
    p["C"][:] = 1.0
    p["b"][:] = np.where(v.used, np.log(np.maximum(v.noise, 1e-30)), -30.0)
    return flat


def contexts(t, first, s: Settings, end: int):
    """The ``context`` targets before every token, nearest first; ends stand before a document."""
    place = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((s.context, len(t)), end, np.int64)
    for j in range(s.context):
        ok = np.flatnonzero(place > j)
        out[j, ok] = t[ok - j - 1]
    return out


def _add_rows(params, memory, ids, grads, rate):
    """Adagrad step on the rows ``ids`` (repeats are added up first)."""
    small = ids.astype(np.uint16) if len(params) <= 1 << 16 else ids  # sorts faster
    order = np.argsort(small, kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g, rows = np.add.reduceat(grads[order], at, axis=0), ids[at]
    memory[rows] += g * g
    params[rows] += rate * g / np.sqrt(memory[rows])


def _sigmoid(x):
    """1 / (1 + exp(-x)), worked out in place."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def grouped(ctx, t, s: Settings):
    """Distinct contexts (context, n) and, in their order, (targets, times, first row per context)."""
    code = np.zeros(len(t), np.int64)
    for c in (*ctx, t):
        code = code * s.targets + c
    code, times = np.unique(code, return_counts=True)
    code, target = np.divmod(code, s.targets)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    code, out = code[first], np.empty((len(ctx), len(first)), np.int64)
    for j in range(len(ctx) - 1, -1, -1):
        code, out[j] = np.divmod(code, s.targets)
    return out, target, times, first


def nce_step(p, mem, ctx, t, times, first, noise, log_noise, rate):
    """One minibatch of distinct contexts (context, n) and their targets ``t``, seen ``times`` each, the
    rows of a context starting at ``first``; all share the noise targets."""
    rows, log_k = len(t), np.float32(np.log(len(noise)))
    size = np.diff(np.append(first, rows))
    r, target, wrong = p["R"][ctx], p["Qb"][t], p["Qb"][noise]
    q = r[0] * p["C"][0]
    for j in range(1, len(ctx)):
        q += r[j] * p["C"][j]
    each = np.repeat(q, size, axis=0)
    good = np.einsum("nd,nd->n", each, target[:, :-1])
    good += target[:, -1] - (log_k + log_noise[t])
    bad = q @ wrong[:, :-1].T
    bad += wrong[:, -1] - (log_k + log_noise[noise])
    times = times.astype(np.float32)
    g_good = (1 - _sigmoid(good)) * times
    g_bad = _sigmoid(bad) * np.add.reduceat(times, first)[:, None]
    dq = np.add.reduceat(target[:, :-1] * g_good[:, None], first, axis=0)
    dq -= g_bad @ wrong[:, :-1]
    grads = np.empty((rows + len(noise), q.shape[1] + 1), np.float32)
    np.multiply(each, g_good[:, None], out=grads[:rows, :-1])
    grads[:rows, -1] = g_good
    np.matmul(g_bad.T, -q, out=grads[rows:, :-1])
    grads[rows:, -1] = -g_bad.sum(0)
    d_context = np.einsum("nd,jnd->jd", dq, r)
    d_r = np.concatenate([dq * c for c in p["C"]])
    _add_rows(p["Qb"], mem["Qb"], np.concatenate([t, noise]), grads, rate)
    _add_rows(p["R"], mem["R"], ctx.reshape(-1), d_r, rate)
    mem["C"] += d_context * d_context
    p["C"] += rate * d_context / np.sqrt(mem["C"])


def minibatches(ctx, target, times, first, size: int, rng):
    """The contexts in random order, in runs of about ``size`` tokens, as arguments of :func:`nce_step`."""
    order = rng.permutation(len(first))
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    rows = np.diff(np.append(first, len(target)))
    by = np.argsort(np.repeat(place, rows), kind="stable")
    target, times, rows = target[by], times[by], rows[order]
    first = np.cumsum(rows) - rows
    tokens = np.cumsum(np.add.reduceat(times, first))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(tokens, np.arange(size, tokens[-1], size), "right"), [len(first)]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = first[a], first[b] if b < len(first) else len(target)
        yield ctx[:, order[a:b]], target[low:high], times[low:high], first[a:b] - low


def train_copy(flat, slices, v: Vocabulary, s: Settings, rate: float, seed):
    """(trained parameters, tokens): a copy of the model after one pass over slices of (contexts, targets).

    A slice is worked off by distinct contexts, since equal ones have equal predictions."""
    flat = flat.copy()
    p, rng, seen = unpack(flat, s), np.random.default_rng(seed), 0
    mem = {name: np.ones(shape, np.float32) for name, shape in _shapes(s)}
    log_noise = np.log(np.maximum(v.noise, 1e-30)).astype(np.float32)
    ladder = np.cumsum(v.noise)
    for ctx, t in slices:
        for part in minibatches(*grouped(ctx, t, s), s.batch, rng):
            noise = np.minimum(np.searchsorted(ladder, rng.random(s.noise), "right"), s.targets - 1)
            nce_step(p, mem, *part, noise, log_noise, rate)
        seen += len(t)
    return flat, seen


def log_probs(p, ctx, t, s: Settings, rows: int = 2048):
    """Natural log of the normalised probability of every target given its context."""
    code = np.zeros(len(t), np.int64)
    for c in ctx:
        code = code * s.targets + c
    _, one, same = np.unique(code, return_index=True, return_inverse=True)
    q = (p["R"][ctx[:, one]] * p["C"][:, None, :]).sum(0)
    norm = np.empty(len(one), np.float64)
    longest, highest = np.sqrt((p["Q"] ** 2).sum(1).max()), p["b"].max()
    for at in range(0, len(one), rows):
        z = q[at:at + rows] @ p["Q"].T + p["b"]
        top = np.sqrt((q[at:at + rows] ** 2).sum(1)) * longest + highest  # at least the largest score
        if (top - z[:, 0]).max(initial=0) > 60:
            top = z.max(1)
        z -= top[:, None]
        norm[at:at + rows] = top + np.log(np.exp(z, out=z).sum(1))
    return np.einsum("nd,nd->n", q[same], p["Q"][t]).astype(np.float64) + p["b"][t] - norm[same]


# --- jobs ------------------------------------------------------------------------

def _train_task(batches, v, flat, s, rate, round_no):
    import pyarrow as pa
    from pyspark import TaskContext
    tok, part = Tokens(s), TaskContext.get().partitionId()
    end = int(v.targets(np.array([END]), np.array([0]), s)[0])

    def slices():
        for b in small_batches(batches, 1, SLICE):
            b = b.filter(pa.array(~held_out(b.column(0).to_pylist(), s)))
            if len(b):
                h, cls, _, first = tok.of(b.column(1))
                t = v.targets(h, cls, s)
                yield contexts(t, first, s, end), t

    out, seen = train_copy(flat, slices(), v, s, rate, (round_no, part))
    if seen:
        yield pa.record_batch([pa.array([part]), pa.array([float(seen)]), pa.array([out.tobytes()], pa.binary())], ["part", "weight", "params"])


def _averaged(pdf):
    """One row: the weighted mean of the copies of a group."""
    import pandas as pd
    total = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(pdf["weight"], pdf["params"]))
    weight = float(pdf["weight"].sum())
    return pd.DataFrame({"part": [int(pdf["part"].min())], "weight": [weight], "params": [(total / weight).astype(np.float32).tobytes()]})


def train(docs: DataFrame, v: Vocabulary, s: Settings):
    """The model's parameters after ``rounds`` rounds over all training documents of (id, text) rows."""
    spark, schema = docs.sparkSession, "part long, weight double, params binary"
    flat, parts = start(v, s), docs.rdd.getNumPartitions()
    for n in range(s.rounds):
        given = spark.sparkContext.broadcast((v, flat))
        copies = docs.mapInArrow(lambda it, g=given, n=n: _train_task(it, *g.value, s, s.rate / (n + 1), n), schema)
        left = parts
        while left > 64:
            left = -(-left // 64)
            copies = copies.groupBy(F.pmod(F.col("part"), F.lit(left))).applyInPandas(_averaged, schema)
        got = copies.toPandas()  # at most 64 copies of the model
        if len(got):
            flat = np.frombuffer(_averaged(got)["params"][0], np.float32).copy()
    return flat


SCORED = ("row_key long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, "
          "others array<long>, times array<long>")


def _score_task(batches, v, flat, known, s):
    import pyarrow as pa
    from pyspark import TaskContext
    tok, p, key = Tokens(s), unpack(flat, s), TaskContext.get().partitionId() << 40
    end = int(v.targets(np.array([END]), np.array([0]), s)[0])
    words, count = known
    share = np.log10(v.class_size)
    for b in small_batches(batches, 1, SLICE):
        h, cls, doc, first = tok.of(b.column(1))
        n = len(b)
        t = v.targets(h, cls, s)
        model = log_probs(p, contexts(t, first, s, end), t, s) / np.log(10)
        rare = t >= s.words
        model[rare] -= share[cls[rare]]
        at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        hit = words[at] == h if len(words) else np.zeros(len(h), bool)
        c = count[at[hit]]
        part = np.log10(c + 0.5)
        base = np.full(len(h), -np.log10(v.base_divisor()))
        base[hit] += part
        model[hit] += part * rare[hit]
        left = pa.table({"doc": doc[~hit], "h": h[~hit]}).group_by(["doc", "h"], use_threads=False).aggregate([([], "count_all")])
        left = left.sort_by([("doc", "ascending"), ("h", "ascending")])
        off = np.concatenate([[0], np.cumsum(np.bincount(left["doc"].to_numpy(), minlength=n))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(off, left[x].combine_chunks().cast(pa.int64())) for x in ("h", "count_all")]
        sums = [np.bincount(doc, x, n) for x in (base, model)]
        yield pa.record_batch([pa.array(np.arange(key, key + n)), b.column(0), pa.array(held_out(b.column(0).to_pylist(), s)),
                               pa.array(np.diff(first)), pa.array(np.bincount(doc[hit], c > 0, n).astype(np.int64)),
                               *(pa.array(x) for x in sums), *lists],
                              ["row_key", "doc_id", "held_out", "n_tokens", "known", "base", "model", "others", "times"])
        key += n


def score_language(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and the model's score."""
    spark = docs.sparkSession
    text_batches(spark)
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    counts = token_counts(d, s)
    v = vocabulary(counts, s)
    flat = train(d, v, s)
    low = frequent_from(counts.withColumnRenamed("c_all", "n"), s.frequent)
    chosen = (F.col("c_all") >= low) | F.col("h").isin(v.h.tolist())  # the model's own words are always among them
    often = counts.where(chosen).select("h", "c_train").toArrow().sort_by("h")
    known = spark.sparkContext.broadcast((often["h"].to_numpy(), often["c_train"].to_numpy()))
    del often
    given = spark.sparkContext.broadcast((v, flat))
    path = scratch_path(spark, "scored")
    d.mapInArrow(lambda it: _score_task(it, *given.value, known.value, s), SCORED).write.option("compression", "zstd").parquet(path)
    scored = spark.read.schema(SCORED).parquet(path)
    others = scored.select("row_key", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "row_key", F.col("o.others").alias("h"), F.col("o.times").alias("times"))
    rest = (others.join(counts.where(~chosen).select("h", "c_train"), "h").groupBy("row_key")
            .agg(F.sum(F.col("times") * F.log10(F.col("c_train") + 0.5)).alias("part"),
                 F.sum(F.when(F.col("c_train") > 0, F.col("times")).otherwise(0)).alias("more")))
    part = F.coalesce("part", F.lit(0.0))
    return scored.drop("others", "times").join(rest, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"), (F.col("base") + part).alias("base_score"),
        (F.col("model") + part).alias("score"))
