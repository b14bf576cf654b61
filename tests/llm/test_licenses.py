"""Licence scan: phrases against a plain scan, templates on texts."""

import re

from permgrid.llm.licenses import PHRASES, TEMPLATES, WORD, Automaton, scan_licenses

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PATTERN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = PATTERN.findall((text or "").translate(LOW))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [None, "", "  \n", "MIT License", "mit-license MIT  LICENSE", "Apache License apache license", "cc by cc by-nc CC BY", "commit license",
         "GNU General Public License GNU General", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
         "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
         "licensed under the terms of the gnu general public license version 2 only", "émit license mité license",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software (the \"Software\") to deal in the "
         "Software without restriction", "x " * 20000 + "mit license", "licensed under the apache licence version 2.0"]


def test_base_and_labels(documents, clashing):
    rows = list(enumerate(TEXTS)) + [(3, "MIT License"), (None, "mit license")]
    got = scan_licenses(clashing(documents(rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert by[9].labels == "apache,apache-2.0" and by[9].score == 1.0
    assert by[10].labels == "mit" and by[10].score == 1.0 and by[3].score == 0.5
    assert by[11].labels == "cc-by,cc-by-nc-4.0" and by[12].labels == "gpl,gpl-3.0" and by[13].labels == "gpl,gpl-2.0"
    assert by[15].score == 1.0 and by[17].score == 0.0 and by[0].score == 0.0
    assert scan_licenses(documents([])).count() == 0


def test_automata():
    a = Automaton("t", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> <<endOptional>>d <<var;name=x;words=1-2>> e")
    words = lambda s: WORD.findall(s.encode())
    for text in ("a d x e", "a b d x y e", "a b c d x e", "a d e e e"):
        assert a.accept(words(text), 0) == len(text.split()), text
    for text in ("a c d x e", "a d e", "a d x y z e", "b d x e", "a d x"):
        assert a.accept(words(text), 0) is None, text
    for label, markup in TEMPLATES:
        assert Automaton(label, markup).first is not None
