"""Spelling variants: near words of a corpus, each word's form and the root of its forms (operator 12).

Words are maximal runs of ASCII letters and U+00C0 to U+00FF, ``A`` to ``Z`` lower-cased.  Tasks count
words per batch of texts and Spark adds the counts up.

Near words (one code point inserted, deleted or replaced) are found by asymmetric q-chunks.  Every word
plays both parts.  As the *chunk* side a word of length ``l`` is cut into two disjoint chunks; one edit
leaves one of them whole.  As the *gram* side a word of length ``m`` gives, for partner lengths
``m - 1``, ``m`` and ``m + 1``, its positional grams as long as a partner's chunk.  A whole chunk moves by
the difference in length when the edit is before it and not at all otherwise, so of all places within
shift one only that one can match; the others are never made.  Both sides meet in an equi-join on
(length, place, text) and are verified by edit distance.

A key that many words share (a common first half) would pair all of them.  Its rows go on with the
edited region cut in half, so that the text that must agree grows by half of the region, and so on until
the key is small or the region is one code point long (then only words that differ in that very place
meet, at most an alphabet).  A pair is kept where the region holds the end of its common prefix, hence
once.  Every level is counted first (with map-side partial counts), nothing is gathered or dropped.

Edge cases: a null or empty text has no words; texts of any length are walked in slices; a null id
counts as empty text in the hash that deletes code points; repeated rows count as often as they occur;
of near words of equal count the smallest in code-point order is the form; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import bounded, saved, text_batches

SLICE = 1 << 20


def _count_task(batches, min_length: int, drop_every: int, held: int = 300_000):
    """(word, n) of a task's texts; sent on whenever ``held`` distinct words are in memory."""
    import re
    from collections import Counter
    from zlib import crc32

    import pyarrow as pa
    run, gap = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
    total = Counter()

    def out():
        b = pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return b

    for b in batches:
        texts = b.column(1).cast(pa.binary())
        for doc, raw in zip(b.column(0).to_pylist(), texts):
            raw = raw.as_py()
            if not raw:
                continue
            text = raw.lower().decode("utf-8", "replace")  # bytes.lower() changes A to Z only
            seed, pos = crc32(f"{'' if doc is None else doc}:".encode()), 0
            while pos < len(text):
                end = pos + SLICE
                cut = gap.search(text, end) if end < len(text) else None
                end = cut.start() if cut else len(text)
                for w, n in Counter(run.findall(text, pos, end)).items():
                    if len(w) >= min_length:
                        h = crc32(w.encode(), seed)
                        if h % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < min_length:
                                continue
                        total[w] += n
                pos = end
                if len(total) >= held:
                    yield out()
    if total:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                drop_every: int = 199) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that occur ``min_count`` times or more.

    A run whose crc32 with its document's id is a multiple of ``drop_every`` first loses the code point
    that the crc names."""
    text_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    partial = d.mapInArrow(lambda it: _count_task(it, min_length, drop_every), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``: the text outside the edited region [a, b) of a word, as its side sees it."""
    shift = F.col("m") - F.col("l")  # the gram side's word is that much longer than its partner
    outside = (F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("b") + shift + 1, F.col("m")))
    return rows.withColumn("key", F.xxhash64("l", "a", "b", *outside))


def _level_zero(words: DataFrame) -> DataFrame:
    """Two chunk rows a word, and its grams for partners of three lengths; ``l`` is the chunk side's length."""
    w = words.select("word", "n", F.length("word").alias("m"))
    as_chunk = w.select("*", F.lit(0).alias("side"), F.col("m").alias("l"))
    as_gram = w.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.col("m") - 1, F.col("m") + 1)).alias("l"))
    both = as_chunk.unionByName(as_gram).where("l >= 2").withColumn("h", F.floor(F.col("l") / 2).cast("int"))
    regions = F.array(F.struct(F.lit(0).alias("a"), F.col("h").alias("b")), F.struct(F.col("h").alias("a"), F.col("l").alias("b")))
    return both.select("word", "n", "m", "side", "l", F.inline(regions))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))
    return rows.withColumn("parts", parts).select("word", "n", "m", "side", "l", F.inline("parts"))


def _marked(rows: DataFrame, hot: DataFrame, salts: int = 16) -> DataFrame:
    """``rows`` with ``hot``: broadcast behind a count, else joined with every hot key dealt to ``salts`` tasks."""
    mark = hot.select("key", F.lit(True).alias("hot"))
    small = bounded(mark)
    if small is not mark:
        return rows.join(small, "key", "left")
    mark = mark.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int"))
    return dealt.join(mark, ["key", "salt"], "left").drop("salt")


def _verified(rows: DataFrame) -> DataFrame:
    """(word, other, other_n) of the pairs that meet on a key and are one edit apart."""
    s = rows.where("side = 0").select("key", "l", "b", F.col("word").alias("s"))
    t = rows.where("side = 1").select("key", F.col("word").alias("t"), F.col("n").alias("other_n"))
    met = s.join(t, "key").where("s <> t")
    once = (F.col("b") == F.col("l")) | (F.substring("s", F.lit(1), F.col("b")) != F.substring("t", F.lit(1), F.col("b")))
    return met.where(once).where(F.levenshtein("s", "t", 1) == 1).select(F.col("s").alias("word"), F.col("t").alias("other"), "other_n")


def near_pairs(words: DataFrame, pairs_per_key: int = 256) -> DataFrame:
    """(word, other, other_n): every ordered pair of distinct ``words`` (word, n) one edit apart, once.

    Keys on which more than ``pairs_per_key`` pairs would meet go on with half the region."""
    rows, found = _keyed(_level_zero(words)), None
    while True:
        sides = rows.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("c"), F.count_if(F.col("side") == 1).alias("g"),
                                        F.max(F.col("b") - F.col("a")).alias("width"))
        hot = saved(sides.where((F.col("c") * F.col("g") > pairs_per_key) & (F.col("width") > 1)).select("key"))
        if hot.isEmpty():
            cold, rest = rows, None
        else:
            split = saved(_marked(rows, hot))
            cold, rest = split.where("hot is null").drop("hot"), split.where("hot").drop("hot", "key")
        level = _verified(cold)
        found = level if found is None else found.unionByName(level)
        if rest is None:
            return found
        rows = _keyed(_halved(rest))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) by following (word, form) to the last word; chains have at most ``longest`` steps."""
    r = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        step = r.select(F.col("word").alias("root"), F.col("root").alias("next"))
        r = saved(r.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return r


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                      factor: int = 5, drop_every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the corpus.

    A word's form is its near word of largest count (ties: smallest), if that count is at least
    ``factor`` times the word's own; its root is where following forms ends."""
    words = saved(word_counts(docs, id_col, text_col, min_length, min_count, drop_every))
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    big = -F.col("best.less")
    w = words.join(near, "word", "left").withColumn("has", F.coalesce(big >= F.lit(factor) * F.col("n"), F.lit(False)))
    w = saved(w.select("word", F.when(F.col("has"), F.col("best.other")).alias("form"), "n",
                       F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), big).alias("form_n")))
    top = w.agg(F.max("n")).first()[0] or 0  # one number: a chain multiplies the count at every step
    longest = int(math.log(max(top, 1) / min_count, factor)) + 1 if top >= min_count else 0
    r = roots(w.where("form is not null"), longest)
    return (w.join(r, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
