"""Spelling variants against plain Python over the same texts."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from permgrid.llm.spelling import near_pairs, spelling_variants, word_counts

ALPHA = "abcdefghijklmnopqrstuvwxyzéüÉÜ×"


def plain_counts(rows):
    n = Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def edits(w):
    for i in range(len(w) + 1):
        for c in ALPHA:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1:]
        if i < len(w):
            yield w[:i] + w[i + 1:]


def plain(rows):
    n = plain_counts(rows)
    near = {w: {e for e in edits(w) if e in n and e != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed, base=14, docs=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aabéc", k=rnd.randint(5, 9))) for _ in range(base)]
    words += [rnd.choice(list(edits(rnd.choice(words)))) for _ in range(4 * base)]
    weight = [rnd.choice((1, 1, 2, 8, 60)) for _ in words]
    make = lambda: rnd.choice((" ", "-", "7", "中")).join(
        w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(words, weight, k=120))
    return [(i, make()) for i in range(docs)]


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_python(documents, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "12 34")]
    assert got(spelling_variants(documents(rows))) == plain(rows)


def test_forms_chain_to_a_root(documents):
    rows = [(1, " ".join(["colour"] * 5 + ["colours"] * 30 + ["colourss"] * 200))]
    assert {(w, r) for w, _, r, *_ in got(spelling_variants(documents(rows)))} >= {("colour", "colourss")}
    assert got(spelling_variants(documents(rows))) == plain(rows)


@pytest.mark.parametrize("limit", [1, 16, 10**9])
def test_hot_keys_are_cut_without_losing_a_pair(spark, limit):
    rnd = random.Random(5)
    words = {"prefix" + "".join(rnd.choices("abc", k=4)) for _ in range(60)} | {"".join(rnd.choices("ab", k=7)) for _ in range(60)}
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    pairs = [(r[0], r[1]) for r in near_pairs(df, limit).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(w, e) for w in words for e in edits(w) if e in words and e != w}


def test_long_text_long_word_and_repeated_rows(documents):
    long = "x" * 60_000
    rows = [(7, "stream " * 300_000 + long)] + [(8, "streams " + long)] * 5
    assert got(spelling_variants(documents(rows))) == plain(rows)


def test_empty_table_and_clashing_names(documents, clashing):
    assert got(spelling_variants(documents([]))) == set()
    rows = corpus(4)
    df = documents(rows)
    for name in ("word", "side", "l", "m", "hot", "salt", "best"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(spelling_variants(clashing(df))) == plain(rows)


def test_null_id_counts_as_empty_text(spark):
    df = spark.createDataFrame([(None, "letters " * 6)], "doc_id long, text string")
    want = plain_counts([("", "letters " * 6)])
    assert {tuple(r) for r in word_counts(df).collect()} == set(want.items())
