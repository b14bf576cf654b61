"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

Test items are short, documents long, so the share of an *item* that a document holds
decides, not their Jaccard similarity.  Items are partitioned by the size of their shingle
sets.  An item of q shingles of which ``need`` must be found keeps its q - need + 1
smallest shingle hashes, a bottom-k MinHash sketch: a document that holds ``need`` of its
shingles holds at least one of these, so no leak is missed.  The largest kept hash of a
partition is its threshold; a document's sketch for the partition is its shingle hashes up
to there.  A common value makes a candidate, and candidates are verified by exact
containment on whole shingle sets.

When all items have at most ``max_shingles`` shingles together (checked by an
aggregate), sketches and sets are broadcast and documents stay where they are.  Beyond
that both sketches are joined by hash, and candidates are verified with equi-joins.  Both
ways give the same rows.

An item of fewer than five words is one shingle of all its words; such items are size partitions
of their own, one per number of words that occurs, and are held against documents' word sequences of
that length.

Edge cases: null texts are empty; an item without words is never found; texts are taken whole at any
length; null ids of items or documents take no part; for repeated ids the best row
counts; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import bounded, saved, text_batches
from permgrid.llm.wordhash import CHUNK, WordHasher, small_batches, space_separators

NUM, DEN = 80, 100


def needed(q: int, num: int, den: int) -> int:
    return -(-q * num // den)


def _item_sets(words, num, den):
    def run(batches):
        import pyarrow as pa
        hasher = WordHasher(space_separators())
        for b in batches:
            sets = list(hasher.shingles(b.column(1), words, short_as_one=False))
            keep = [u[:len(u) - needed(len(u), num, den) + 1] for u in sets]
            lists = lambda x: pa.array([v.view(np.int64) for v in x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(u) for u in sets], pa.int64()), lists(sets), lists(keep)],
                names=["item", "q", "hashes", "sketch"])
    return run


def _search(shared, words, num, den):
    """Documents against broadcast items: (doc, item, q, n)."""
    def run(batches):
        import pyarrow as pa
        items, sets, parts = shared.value
        hasher = WordHasher(space_separators())
        for b in small_batches(batches, 1, CHUNK):
            rows = []
            for doc, u in zip(b.column(0).to_pylist(), hasher.shingles(b.column(1), words, short_as_one=False)):
                if doc is None or not len(u):
                    continue
                for top, value, owner in parts:  # one partition of item sizes after the other
                    mine = u[:np.searchsorted(u, top, "right")]
                    at = np.searchsorted(value, mine)
                    at[at == len(value)] = 0
                    hit = mine[value[at] == mine]
                    if not len(hit):
                        continue
                    lo, hi = np.searchsorted(value, hit), np.searchsorted(value, hit, "right")
                    for x in sorted({int(o) for s, e in zip(lo, hi) for o in owner[s:e]}):
                        n = len(np.intersect1d(sets[x], u, assume_unique=True))
                        if n >= needed(len(sets[x]), num, den):
                            rows.append((doc, items[x], len(sets[x]), n))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "item", "q", "n"])
    return run


def _doc_sets(words, top):
    def run(batches):
        import pyarrow as pa
        hasher = WordHasher(space_separators())
        for b in small_batches(batches, 1, CHUNK):
            sets = list(hasher.shingles(b.column(1), words, short_as_one=False))
            lists = lambda x: pa.array([v.view(np.int64) for v in x], pa.list_(pa.int64()))
            small = [u[:np.searchsorted(u, np.uint64(top), "right")] for u in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists(sets), lists(small)],
                                             names=["doc", "row", "hashes", "sketch"])
    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", words: int = 5, num: int = NUM, den: int = DEN,
                    max_shingles: int = 4_000_000) -> DataFrame:
    """(doc, item, q, n): documents that hold n of an item's q shingles, den * n >= num * q."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    items = saved(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
                  .where("item is not null").distinct().withColumn("words", size))
    found = _contained(rows, items.where(F.col("words") >= words).drop("words"), words, num, den, max_shingles)
    short = items.where((F.col("words") > 0) & (F.col("words") < words))
    for r in short.select("words").distinct().collect():  # fewer than ``words`` numbers
        k = r["words"]
        found = found.unionByName(_contained(rows, short.where(F.col("words") == k).drop("words"), k, num, den, max_shingles))
    return found.groupBy("doc", "item").agg(F.max(F.struct(F.col("n") / F.col("q"), "q", "n")).alias("s")).select("doc", "item", "s.q", "s.n")


def _contained(rows: DataFrame, items: DataFrame, words: int, num: int, den: int, max_shingles: int) -> DataFrame:
    """Rows of (doc, item, q, n) over shingles of ``words`` words; repeated ids may give several."""
    spark = rows.sparkSession
    sets = saved(items.mapInArrow(_item_sets(words, num, den), "item long, q long, hashes array<long>, sketch array<long>")
                 .where("q > 0"))
    if (sets.agg(F.sum("q")).first()[0] or 0) <= max_shingles:
        got = sets.orderBy("item", "q").collect()  # bounded by the check
        arrays = [np.array(r.hashes, np.int64).view(np.uint64) for r in got]
        parts = []
        for size in sorted({int(r.q).bit_length() for r in got}):
            of = [(np.array(r.sketch, np.int64).view(np.uint64), x) for x, r in enumerate(got) if int(r.q).bit_length() == size]
            value = np.concatenate([s for s, _ in of])
            owner = np.concatenate([np.full(len(s), x) for s, x in of])
            order = np.argsort(value, kind="stable")
            parts.append((value.max(), value[order], owner[order]))
        shared = spark.sparkContext.broadcast(([r.item for r in got], arrays, parts))
        return rows.mapInArrow(_search(shared, words, num, den), "doc long, item long, q long, n long")
    flip = F.lit(-(1 << 63)).cast("long")  # hashes compare as unsigned
    top = sets.select(F.explode("sketch").alias("h")).agg(F.max(F.col("h").bitwiseXOR(flip))).first()[0]
    numbered = rows.where("doc is not null").select("doc", "text", F.xxhash64("text").alias("row"))
    mine = numbered.mapInArrow(_doc_sets(words, (top + (1 << 63)) % (1 << 64)),
                               "doc long, row long, hashes array<long>, sketch array<long>")
    sets = sets.withColumn("version", F.xxhash64("hashes"))
    sketches = sets.select("item", "version", "q", F.explode("sketch").alias("h"))
    cand = saved(mine.select("doc", "row", F.explode("sketch").alias("h")).join(sketches, "h")
                 .select("doc", "row", "item", "version", "q").distinct())
    ids = saved(cand.select("doc").distinct())
    held = (numbered.join(bounded(ids), "doc", "left_semi")
            .mapInArrow(_doc_sets(words, 0), "doc long, row long, hashes array<long>, sketch array<long>")
            .select("doc", "row", F.explode("hashes").alias("h")).distinct())
    wanted = cand.join(sets.select("item", "version", F.explode("hashes").alias("h")), ["item", "version"])
    n = wanted.join(held, ["doc", "row", "h"]).groupBy("doc", "row", "item", "version", "q").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") * den >= F.col("q") * num).select("doc", "item", "q", "n")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query: doc_id, item_id, item_shingles, shared, containment."""
    found = contained_items(docs, benchmark)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("q").alias("item_shingles"),
                        F.col("n").alias("shared"), (F.col("n") / F.col("q")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item (null ids stay)."""
    hit = saved(contained_items(docs, benchmark).select(F.col("doc").alias("doc_id")).distinct())
    return docs.join(bounded(hit), "doc_id", "left_anti").select(*docs.columns)


ORACLE = """
WITH item_words AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_sh AS (
  SELECT DISTINCT item_id, 5 AS k, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words WHERE len(w) >= 5)
  UNION ALL
  SELECT DISTINCT item_id, len(w), array_to_string(w, ' ') FROM item_words WHERE len(w) BETWEEN 1 AND 4),
ks AS (SELECT DISTINCT k FROM item_sh),
sizes AS (SELECT item_id, count(*) AS q FROM item_sh GROUP BY 1),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
doc_sh AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, count(*) AS n FROM doc_sh JOIN item_sh USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, q AS item_shingles, n AS shared, n / q AS containment
FROM hits JOIN sizes USING (item_id) WHERE n * 100 >= q * 80
"""
