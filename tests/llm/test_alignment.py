"""Tokenizer alignment against plain Python, and its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from permgrid.llm import alignment as A

PATHS = A.default_paths()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    a_tok = Tokenizer.from_file(PATHS.a)
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS.b)
    v = A.Vocabularies(PATHS)
    aligned, docs_with = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            want = (" " + text).encode()
            sides = [(a_tok.encode(" " + text, add_special_tokens=False).ids, v.a_bytes), (sp.encode(text), v.b_bytes)]
            cut = [(ids, [table[i].as_py() for i in ids]) for ids, table in sides]
            if all(b"".join(parts) == want for _, parts in cut):
                ends = [set(np.cumsum([len(p) for p in parts]).tolist()) for _, parts in cut]
                shared = sorted(ends[0] & ends[1])
                groups = [([], []) for _ in shared]
                for side, (ids, parts) in enumerate(cut):
                    at, g = 0, 0
                    for i, p in zip(ids, parts):
                        at += len(p)
                        groups[g][side].append(i)
                        g += at == shared[g]
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        docs_with.update(links.keys())
        aligned.append((groups, links))
    top = Counter()
    for (x, _), n in docs_with.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), (groups, links) in zip(rows, aligned):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if docs_with[k] == top[k[0]]), sum(n * docs_with[k] for k, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return Counter(out)


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def texts(seed, n):
    rnd = random.Random(seed)
    pool = ["the", "THE", "naïve", "中文字", "🙂🙂", "<unk>", "<s>", "<|endoftext|>", "▁", "  ", "\n\n", "\t", "x" * 40, "0x1F", "don't",
            " ", "ﬁ", "é", "<0x41>", "﻿", "\x00", "итого", "1,234.56"]
    return ["".join(rnd.choice(pool) + rnd.choice(["", " ", ", "]) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [1_000_000, 8, 0])
def test_equal_to_plain_python(documents, frequent):
    rows = list(enumerate(texts(1, 60) + [None, "", " ", "a", "a", "The cat. " * 50]))
    assert got(A.alignment_report(documents(rows), PATHS, frequent=frequent)) == plain(rows)


def test_own_tables(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(A.alignment_report(df, PATHS, frequent=2000)) == plain(rows)


def test_large_groups_are_joined_in_parts():
    v = A.Vocabularies(PATHS)
    rnd = np.random.default_rng(3)
    group_a, group_b = np.sort(rnd.integers(0, 4, 300)), np.sort(rnd.integers(0, 4, 300))
    ids_a, ids_b = rnd.integers(0, 90, 300), rnd.integers(0, 90, 300)
    doc = np.array([0, 0, 1, 1])
    want = Counter()
    for g, x in zip(group_a, ids_a):
        want.update((int(doc[g]), int(x) * v.base + int(y)) for y in ids_b[group_b == g])
    for at_once in (1, 50, 10**9):
        t = A._links(group_a, ids_a, group_b, ids_b, doc, v.base, at_once)
        assert Counter({(d, p): n for d, p, n in zip(*(c.to_pylist() for c in t.columns))}) == want


def test_long_text_repeated_rows_and_null_id(spark):
    long = "longword" * 20_000 + " and some words " * 5_000
    rows = [(1, long), (2, "some words"), (2, "some words"), (None, "and")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(A.alignment_report(df, PATHS)) == plain(rows)


def test_empty_table_and_clashing_names(documents, clashing):
    assert not got(A.alignment_report(documents([]), PATHS))
    rows = list(enumerate(texts(2, 10)))
    df = documents(rows)
    for name in ("row_key", "pairs", "times", "pair", "best", "sum", "top"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(A.alignment_report(clashing(df), PATHS)) == plain(rows)


def test_plain_texts_get_the_tokenizers_ids():
    """Every character up to U+024F alone and in pairs, odd white space and long words, against the tokenizer itself."""
    v = A.Vocabularies(PATHS)
    tok, enc = v.a, v.plain_a
    signs = [chr(c) for c in (*range(0x250), 0x85, 0x1680, 0x180E, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x4E2D, 0x1F642)]
    rnd = random.Random(4)
    texts = [f" {x}{y} w{x}{y}w{y}1{x}" for x in signs for y in rnd.sample(signs, 60)]
    texts += ["".join(rnd.choices(signs[:0x80], k=40)) for _ in range(3000)]
    texts += ["".join(rnd.choices(signs[0x20:0x250], k=40)) for _ in range(3000)]
    texts += ["".join(rnd.choices(" \t\n\r\u00e9a'1,", k=30)) for _ in range(3000)] + [" ", "x" * 5000, " " * 3000 + "a", "<|endoftext|> a"]
    assert sum(map(enc.plain, texts)) > 20_000 and not enc.plain("x" * 5000) and not enc.plain("a" + " " * 3000)
    want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    # every entry is what its own bytes are cut into, so ranks and merges agree
    assert all([t.id for t in tok.model.tokenize(tok.id_to_token(i))] == [i] for i in range(50256))
