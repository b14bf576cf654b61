"""Language-model scores: counts and base score exactly, the model against a plain restatement."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from permgrid.llm import lblm as L

SMALL = L.Settings(words=24, classes=8, dim=8, batch=64, noise=16)
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
END = "\n"  # no word holds white space


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x20\\x09-\\x0D]+", low) + [END]


def plain(rows):
    held = [crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held):
        words = tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((i, h, len(words), sum(c[w] > 0 for w in words), n, base))
    return out, c


def check(df, rows):
    assert df.columns == COLUMNS
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(plain(rows)[0], key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-10, abs=1e-9)
    assert all(math.isfinite(r[6]) and r[6] <= 0 for r in got)
    return got


def corpus(n=60):
    rnd = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "中文", "A-b", "x" * 50]
    return [(i, " ".join(rnd.choice(words, rnd.integers(0, 40)).tolist())) for i in range(n)] + [(800, None), (801, ""), (802, "\t  \x0b")]


@pytest.mark.parametrize("frequent", [1_000_000, 10])
def test_counts_and_base_score(documents, frequent):
    rows = corpus() + [(5, "twice w1"), (5, "twice w1")]
    check(L.score_language(documents(rows), L.Settings(words=24, classes=8, dim=8, frequent=frequent)), rows)


def test_score_equals_a_plain_restatement(documents, spark):
    rows = corpus()
    d = documents(rows).select("doc_id", "text")
    counts = L.token_counts(d, SMALL)
    v = L.vocabulary(counts, SMALL)
    flat = L.train(d, v, SMALL)
    p = {k: x.astype(np.float64) for k, x in L.unpack(flat, SMALL).items()}  # doubles
    got = {r["doc_id"]: r["score"] for r in L.score_language(documents(rows), SMALL).collect()}
    _, c = plain(rows)
    import pyarrow as pa
    tok = L.Tokens(SMALL)
    target, cls = {}, {}
    for w in {w for _, t in rows for w in tokens(t)}:
        h, k, _, _ = tok.of(pa.array([w if w != END else ""]))
        target[w], cls[w] = int(v.targets(h[:1], k[:1], SMALL)[0]), int(k[0])
    size = {k: sum(c[w] for w in c if target[w] == SMALL.words + k) + 0.5 * (1 + sum(target[w] == SMALL.words + k for w in c))
            for k in range(SMALL.classes)}
    for i, t in rows:
        total, past = 0.0, [target[END]] * SMALL.context
        for w in tokens(t):
            q = sum(p["C"][j] * p["R"][past[j]] for j in range(SMALL.context))
            z = p["Q"] @ q + p["b"]
            total += (z[target[w]] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
            if target[w] >= SMALL.words:
                total += math.log10((c[w] + 0.5) / size[cls[w]])
            past = [target[w], *past[:-1]]
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_probabilities_of_a_context_sum_up_to_one():
    top = [(h, h % 8, 40 - h) for h in range(1, 20)] + [(L.END, 0, 30)]
    v = L.Vocabulary(SMALL, top, [(k, 500, 20) for k in range(8)], 4000, 160)
    p = L.unpack(L.start(v, SMALL) + np.random.default_rng(1).normal(0, 1, len(L.start(v, SMALL))).astype(np.float32), SMALL)
    t = np.arange(SMALL.targets)
    ctx = np.full((SMALL.context, len(t)), 3)
    assert np.exp(L.log_probs(p, ctx, t, SMALL)).sum() == pytest.approx(1, abs=1e-5)
    assert v.noise.sum() == pytest.approx(1)


def test_the_normaliser_holds_for_large_scores():
    s = L.Settings(words=4, classes=2, dim=2, context=1)
    p = {"R": np.array([[50, 0]] * 6, np.float32), "Q": np.array([[i, 0] for i in range(6)], np.float32), "C": np.ones((1, 2), np.float32),
         "b": np.zeros(6, np.float32)}  # z - top reaches 250
    lp = L.log_probs(p, np.zeros((1, 6), np.int64), np.arange(6), s)
    assert lp == pytest.approx([-50.0 * (5 - i) for i in range(6)], abs=1e-3)


def test_a_step_lowers_the_loss():
    """One stochastic step moves true words up and noise down."""
    v = L.Vocabulary(SMALL, [(h, 0, 10) for h in range(1, 24)] + [(L.END, 0, 10)], [(0, 240, 24)], 240, 24)
    flat = L.start(v, SMALL)
    t = np.tile([3, 4, 5], 400)
    ctx = np.stack([np.roll(t, 1), np.roll(t, 2)])
    before = L.log_probs(L.unpack(flat, SMALL), ctx, t, SMALL).mean()
    after, seen = L.train_copy(flat, [(ctx, t)] * 5, v, SMALL, 0.3, 0)
    assert seen == 5 * len(t)
    assert L.log_probs(L.unpack(after, SMALL), ctx, t, SMALL).mean() > before + 1


def test_held_out_texts_score_better_than_unigrams(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3, "doc_id")
    r = L.score_language(df).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.15  # log10 a token


def test_no_training_documents_and_empty_table(documents):
    only = next(i for i in range(100) if crc32(str(i).encode()) % 5 == 1)
    got = check(L.score_language(documents([(only, "some words")]), SMALL), [(only, "some words")])
    assert got[0][4:6] == (0, 0.0)
    assert L.score_language(documents([]), SMALL).collect() == []


def test_null_id_long_text_and_clashing_names(spark, clashing):
    rows = [(None, "alone here"), (3, "word " * 200_000 + "y" * 1_200_000), (4, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("h", "cls", "row_key", "others", "times", "part", "more", "c_all"):
        df = df.withColumn(name, F.lit("clash"))
    check(L.score_language(clashing(df), SMALL), rows)


def test_many_copies_are_averaged_in_levels(documents, spark):
    rows = corpus(140)
    d = documents(rows).select("doc_id", "text").repartition(140, "doc_id")
    v = L.vocabulary(L.token_counts(d, SMALL), SMALL)
    one = L.Settings(words=24, classes=8, dim=8, batch=64, noise=16, rounds=1)
    flat = L.start(v, one)
    copies = d.mapInArrow(lambda it: L._train_task(it, v, flat, one, one.rate, 0), "part long, weight double, params binary").toPandas()
    want = np.average([np.frombuffer(x, np.float32) for x in copies["params"]], axis=0, weights=copies["weight"])
    assert len(copies) > 64
    assert L.train(d, v, one) == pytest.approx(want, abs=1e-4)
