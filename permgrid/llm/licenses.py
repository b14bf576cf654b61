"""Licence scan by template markup (operator 5).

A template is licence wording with two kinds of marked regions:

    <<beginOptional>> words that may be missing <<endOptional>>
    <<var;name=holder;words=1-4>>     replaceable: that many words of any kind

It is compiled to a nondeterministic automaton over words.  A text is accepted at a place
when all words outside the marked regions stand there exactly, in order.  Case, white
space and punctuation do not count, as a text is read as words.

Edge cases: a null text is empty and has no words; other columns are ignored; repeated
rows and ids give a row each; an empty table gives an empty result; texts are scanned
whole, whatever their length; of several acceptances from one word the longest counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import text_batches
from permgrid.llm.wordhash import WordHasher, alnum_separators, small_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases whose places are always counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence notices as templates, under the usual short names.
TEMPLATES = [
    ("apache-2.0", "licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>"),
    ("gpl-2.0", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, version 2"
                "<<beginOptional>>.0<<endOptional>><<beginOptional>> only<<endOptional>>"),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, version 3"
                "<<beginOptional>>.0<<endOptional>><<beginOptional>> only<<endOptional>>"),
    ("gpl-or-later", "terms of the GNU General Public License as published by the Free Software Foundation; "
                     "either version <<var;name=version;words=1-2>> of the License, or (at your option) any later version"),
    ("mit", "released under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=work;words=1-12>> "
            "to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons Attribution <<endOptional>>"
                  "CC BY 4.0 <<beginOptional>>International<<endOptional>>"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a <<endOptional>>CC BY-NC 4.0 <<beginOptional>>International<<endOptional>>"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a <<endOptional>>CC BY-SA 4.0 <<beginOptional>>International<<endOptional>>"),
    ("all-rights-reserved", "Copyright <<beginOptional>>c <<endOptional>><<var;name=holder;words=1-8>> all rights reserved"),
]

NONE = frozenset()
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


class Automaton:
    """States are numbers; ``step[state]`` maps a word to states, ``any_word`` takes all words."""

    def __init__(self, label: str, markup: str):
        self.label, self.step, self.any_word, self.free = label, [{}], [set()], [set()]
        at, opened, pos = 0, [], 0
        for m in [*MARK.finditer(markup), None]:
            for w in WORD.findall(markup[pos:m.start() if m else None].lower().encode()):
                to = self._state()
                self.step[at].setdefault(w, set()).add(to)
                at = to
            if m is None:
                break
            pos, kind = m.end(), m.group(1)
            if kind == "beginOptional":
                opened.append(at)
            elif kind == "endOptional":
                to = self._state()
                self.free[at].add(to)
                self.free[opened.pop()].add(to)
                at = to
            else:
                low, high = map(int, re.search(r"words=(\d+)-(\d+)", kind).groups())
                end = self._state()
                for n in range(high):
                    if n >= low:
                        self.free[at].add(end)
                    to = self._state()
                    self.any_word[at].add(to)
                    at = to
                self.free[at].add(end)
                at = end
        if opened:
            raise ValueError(f"optional region left open in {label}")
        self.final = at
        self.start = self._close({0})
        self.first = None if any(self.any_word[s] for s in self.start) else {w for s in self.start for w in self.step[s]}

    def _state(self):
        self.step.append({})
        self.any_word.append(set())
        self.free.append(set())
        return len(self.step) - 1

    def _close(self, states):
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    def accept(self, words, at: int):
        """End of the longest acceptance that starts at word ``at``, or None."""
        now, end = self.start, None
        for i in range(at, len(words) + 1):
            if self.final in now:
                end = i
            if i == len(words):
                break
            w = words[i]
            now = self._close({t for s in now for t in self.step[s].get(w, NONE) | self.any_word[s]})
            if not now:
                break
        return end


def scan_words(words, automata, phrases):
    """(places of phrases as (first word, label), acceptances as (label, start, end))."""
    base, found = [], []
    by_first = {}
    for p, label in phrases:
        by_first.setdefault(p[0], ([], []))[0].append((p, label))
    for a in automata:
        for w in a.first or ():
            by_first.setdefault(w, ([], []))[1].append(a)
    anywhere = [a for a in automata if a.first is None]
    for i, w in enumerate(words):
        if w in by_first:
            here, machines = by_first[w]
            base += [(i, label) for p, label in here if words[i:i + len(p)] == p]
        elif not anywhere:
            continue
        else:
            machines = []
        for a in machines + anywhere:
            end = a.accept(words, i)
            if end is not None:
                found.append((a.label, i, end))
    return base, found


def _scan(templates, phrases):
    def run(batches):
        import pyarrow as pa
        hasher = WordHasher(alnum_separators())
        automata = [Automaton(label, markup) for label, markup in templates]
        listed = [(WORD.findall(p.encode()), label) for p, label in phrases.items()]
        first = {p[0] for p, _ in listed} | {w for a in automata for w in a.first or ()}
        open_start = any(a.first is None for a in automata)
        trigger = re.compile(b"|".join(sorted(map(re.escape, first))))
        for b in small_batches(batches, 1):
            _, _, counts, data, off, _ = hasher.spans(b.column(1))
            raw, rows = data.tobytes().lower(), []
            for i, n in enumerate(counts.tolist()):
                a, z = int(off[i]), int(off[i + 1])
                base, found = [], []
                if n and (open_start or trigger.search(raw, a, z)):
                    base, found = scan_words(WORD.findall(raw, a, z), automata, listed)
                places = sorted(p for p, _ in base)
                base_labels = {x for _, x in base}
                labels = base_labels | {x for x, _, _ in found}
                rows.append((n, len(base), places[0] if base else None, places[-1] if base else None,
                             ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                             1.0 if found else 0.5 if base else 0.0,
                             [{"label": x, "first": s, "last": e - 1} for x, s, e in sorted(found, key=lambda f: (f[1], f[0]))]))
            cols = list(zip(*rows)) or [()] * 8
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                                    "labels", "score", "accepted"])
    return run


def scan_licenses(docs: DataFrame, templates=None, phrases=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: word count, places of the base phrases, labels, score and the
    accepted places (label, first and last word).

    The score is 1 when a template is accepted, 0.5 when only a phrase stands in the text.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, phrases or PHRASES),
                           "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                           "labels string, score double, accepted array<struct<label:string,first:long,last:long>>")
