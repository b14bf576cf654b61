"""Packing against the tokenizer itself: an exact round trip, and little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
from permgrid.llm.packing import WordEncoder, default_tokenizer, pack_documents, place
from tokenizers import Tokenizer

ODD = ["", "a\x1cb", "It's   he'll WE'VE x'd", "İstanbul Σας ΟΔΟΣ", "été ½ x² a_b--c 'S <|endoftext|>ab 日本語",
       "\U0001f642\U0001f642 \u0085x　y​z ﻿q", "naïve­soft", "ǅ ŉ ſ K Å ͅ", "́a ᠎ b",
       "é ñ", "٣٤ Ⅷ ①", "hello" * 50, "<|startoftext|> x"]


def test_encoder_equals_tokenizer():
    tok, enc = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer(), cache=7)
    for text in ODD * 2:
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark, documents, clashing):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma", "délta", "x9"]) for _ in range(rng.choice([0, 3, 40, 700, 4000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, ODD[4]), (103, ODD[5]), (102, ODD[4])]
    tok = Tokenizer.from_file(default_tokenizer())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = pack_documents(clashing(documents(rows)).repartition(2), default_tokenizer(), window=6000, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert list(r.ids) == part and r.doc_tokens == len(ids[r.doc_id]) and r.length >= 1
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, p in pieces.items():
        times = 2 if i == 102 else 1
        assert sorted(x for s, n in p for x in range(s, s + n)) == sorted(list(range(len(ids[i]))) * times)
    used = []
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        used.append(at)
    assert sum(2048 - u for u in used) < 2 * 2048  # less than a sequence per partition
    assert pack_documents(documents([]), default_tokenizer()).count() == 0


def test_place_takes_the_cheapest_sequence():
    out = place([(6, 0), (5, 1), (4, 2), (3, 3), (2, 4)], 2, 10, 1.0, 0.1)
    where = {k: (n, o) for k, s, length, n, o in out}
    assert where[0][0] != where[1][0] and where[2][0] == where[1][0] and where[3][0] == where[0][0]
    assert sum(x[2] for x in out) == 20
    cut = place([(7, 0), (7, 1), (6, 2)], 2, 10, 1.0, 0.1)
    assert sorted((k, length) for k, _, length, _, _ in cut) == [(0, 7), (1, 7), (2, 3), (2, 3)]


def test_encoder_on_every_pair_of_latin_characters():
    """All characters from U+0021 to U+024F beside each other and beside punctuation, against the tokenizer."""
    import random

    from tokenizers import Tokenizer

    from permgrid.llm.packing import WordEncoder, default_tokenizer
    enc, tok = WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    signs = [chr(c) for c in range(0x21, 0x250)]
    rnd = random.Random(6)
    texts = [f"-{c} {c}- {c}{c} a{c}1 1{c}a '{c}s" for c in signs]
    texts += [f"{x}{y}" for x in signs for y in rnd.sample(signs, 60)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, w in zip(texts, want) if enc.ids(t).tolist() != w]
    assert not wrong, wrong[:20]
