"""The exact Jaccard join against brute force, hot groups and odd rows included."""

import random
import re

import pytest
from permgrid.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_base=25, copies=6, words=(1, 120), edits=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    return rows


def run(df, **options):
    return {r.doc: (r.n, r.component) for r in J.jaccard_components(df, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, seed):
    rows = corpus(seed)
    assert run(documents(rows)) == brute(rows)


def test_hot_passage_and_many_near_copies(documents):
    """A passage in most documents and one large group of near copies, with low bounds so that
    hot signatures, unsafe sets and blocks all come into play."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"d{i}x{j}" for j in range(rng.randint(2, 40)))) for i in range(60)]
    base = [f"c{i}" for i in range(80)]
    for i in range(60, 130):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(80)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, passage) for i in range(20)]
    want = brute(rows)
    for big, block in ((2, 7), (8, 50), (32, 400)):
        assert run(documents(rows), big=big, block=block) == want


def test_small_sets(documents):
    rows = [(i, t) for i, t in enumerate([
        "a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "a b c d", "A  b\tc\nd", "a b c", "x", "x", "a b c d e",
        "a b c d e f", "b c d e f g h i", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p q"])]
    assert run(documents(rows)) == brute(rows)


def test_edge_rows(spark, documents, clashing):
    long = " ".join(f"l{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, "  \n "), (9, "same old text of five words here"), (3, "same old text of five words here"),
            (11, long), (10, long + " more"), (3, "same old text of five words here")]
    got = sorted(tuple(r) for r in J.near_duplicate_documents(clashing(documents(rows))).collect())
    assert got == [(3, 3, 3), (3, 3, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (9, 3, 3), (10, 29997, 10), (11, 29996, 10)]
    null = J.near_duplicate_documents(documents([(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in null) == [(False, 1), (True, None)]
    assert J.near_duplicate_documents(documents([])).count() == 0


def test_keep_one_of_each(documents):
    kept = J.keep_one_of_each(documents([(4, "a b c d e f g"), (2, "a b c d e f g"), (8, ""), (9, ""), (None, "a b c d e f g")]))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b c d e f g"), (2, "a b c d e f g"), (8, ""), (9, "")]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_signatures_of_similar_sets_meet():
    """Any two linked sets share a signature, or both lack one that counts."""
    import numpy as np
    rng = np.random.default_rng(3)
    signer = J.Signer(80, 100)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = int(2 * len(a) * 20 // 180)
        drop, add = int(rng.integers(0, most // 2 + 1)), int(rng.integers(0, most // 2 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(signer.sign(a)[0].tolist()) & set(signer.sign(b)[0].tolist())
            assert J.parity_gap(J.sketch(a).view(np.uint64), J.sketch(b).view(np.uint64)) <= len(a) + len(b) - 2 * both


def test_partners_that_stop_at_different_seeds_meet(documents):
    """More variants of a short text than a signature may have: all that some share is hot, and a set that
    signs under a further permutation must not count as safe for a partner that had stopped before."""
    base = [f"b532w{k}" for k in range(13)]  # for the hashes of these words 18 components were found instead of one
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        rows.append((i, " ".join(base + [f"y{i}q{q}" for q in range(1 if i % 2 else 2)])))
    want = brute(rows)
    assert {c for _, c in want.values()} == {0}
    assert run(documents(rows)) == want
