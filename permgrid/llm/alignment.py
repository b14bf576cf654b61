"""Alignment of two tokenizers over whole texts (operator 11).

Tokenizer A gets a space and the text, tokenizer B the text (it adds the space).  Both cut the same bytes,
so the byte offsets where tokens of both end cut a text into groups, and every A token of a group is
linked with every B token of it.  A text whose joined token bytes differ from space + text on either
side has no tokens.

A task works on Arrow arrays throughout: the id lists are flattened with their parent indices, byte
lengths are taken by id and summed up per document, an Acero hash join on (document, end) finds the
common ends, a second one on the group pairs the distinct tokens of a group with their counts, and
``Table.group_by`` adds them up per document.  The distinct id pairs of every document are written once
below ``spark.checkpoint.dir``, as Parquet.

The corpus-wide count of a pair (documents that hold it linked) comes from ``Table.group_by`` counts per
task, merged by Spark.  To bring the counts back, pairs from a count on that leaves at most ``frequent``
of them are broadcast; the other pairs are joined by shuffling, and none of these has more rows than
that count, so no key is hot.

Edge cases: null and empty texts and texts whose bytes do not come back give zeros and an empty digest;
texts of any length are taken whole, one document at a time when they are long; repeated rows count as
documents of their own; a null id is kept; ties of a highest count all count as best; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import bounded, text_batches
from permgrid.llm.wordhash import small_batches
from permgrid.session import scratch_path

DOC_SCHEMA = ("row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, times array<long>")


@dataclass(frozen=True)
class Paths:
    """Vocabulary files: A for ``tokenizers``, B for ``sentencepiece``; the pattern that A splits texts with."""

    a: str
    b: str
    pattern_a: str


def default_paths() -> Paths:
    import public_tokenizers
    return Paths(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


class Vocabularies:
    """Both tokenizers, and per id its bytes and its decimal form as Arrow arrays."""

    def __init__(self, paths: Paths):
        import os

        import pyarrow as pa
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(paths.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.b)
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        entries = [bytes(byte[c] for c in e) for e in entries]
        self.a_bytes = pa.array(entries, pa.large_binary())
        self.plain_a = PlainTextEncoder(self.a, entries, paths.pattern_a)
        sp, n = self.b, self.b.get_piece_size()
        self.b_bytes = pa.array([bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                                 for i in range(n)], pa.large_binary())
        self.names = pa.array([str(i) for i in range(max(n, len(entries)))], pa.large_string())
        self.base = n  # a pair of ids as one number: a * base + b


class PlainTextEncoder:
    """A's ids of whole texts.

    Texts of ASCII and Latin letters without very long words go through ``tiktoken`` with A's own entries as
    ranks and A's own split pattern, which gives the same ids three times as fast.  All others, with
    characters that libraries may class differently or words on which that library is quadratic, go through A."""

    def __init__(self, tokenizer, entries, pattern: str, longest: int = 1000):
        import re

        import tiktoken
        self.tok, self.longest = tokenizer, longest
        special = set(tokenizer.get_added_tokens_decoder())
        ranks = {e: i for i, e in enumerate(entries) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u024f]")

    def plain(self, text: str) -> bool:
        if self.odd.search(text):
            return False
        raw = np.frombuffer(text.encode(), np.uint8)
        space = (raw == 32) | (raw == 10) | (raw == 13) | (raw == 9)
        turns = np.flatnonzero(space[1:] != space[:-1])
        return np.diff(np.concatenate([[0], turns, [len(raw)]])).max() <= self.longest

    def encode(self, texts: list) -> list:
        plain = [self.plain(t) for t in texts]
        rest = iter(self.tok.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]


def worker_vocabularies(paths: Paths) -> Vocabularies:
    """The vocabularies of this Python worker, kept between tasks."""
    import sys
    import types
    home = sys.modules.setdefault("permgrid_worker_cache", types.ModuleType("permgrid_worker_cache"))
    kept = home.__dict__.setdefault("vocabularies", {})
    key = (paths.a, paths.b)
    if key not in kept:
        kept[key] = Vocabularies(paths)
    return kept[key]


def _id_lists(rows):
    import pyarrow as pa
    off = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=off[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *(np.array(r, np.int32) for r in rows)])
    return pa.LargeListArray.from_arrays(off, pa.array(flat))


def _joined_ok(lists, table, want):
    """Per document: do its tokens' bytes joined equal ``want``?"""
    import pyarrow.compute as pc
    tokens = pc.take(table, pc.list_flatten(lists))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False))])
    at = ends[np.asarray(lists.offsets)]
    raw = memoryview(b"".join(tokens.to_pylist()) if tokens.offset else (tokens.buffers()[2] or b"")).cast("B")
    return np.array([raw[s:e] == w for s, e, w in zip(at[:-1].tolist(), at[1:].tolist(), want)], bool)


def _ends(lists, table):
    """(document, id, end in bytes within the document) per token."""
    import pyarrow.compute as pc
    doc, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(pc.take(table, ids)), "int64")).to_numpy(zero_copy_only=False)
    first = np.asarray(lists.offsets)[:-1]
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    return doc, ids, total - before[doc.to_numpy()]


def _names(v, ids, last):
    """Decimal ids of each group joined by commas."""
    import pyarrow as pa
    import pyarrow.compute as pc
    off = np.concatenate([[0], np.flatnonzero(last) + 1])
    return pc.binary_join(pa.LargeListArray.from_arrays(off, pc.take(v.names, ids)), pa.scalar(",", pa.large_string()))


def _counted(group, ids):
    """(group, id, occurrences) of distinct ids per group, in the order of groups, as numpy arrays."""
    import pyarrow as pa
    t = pa.table({"group": group, "id": ids}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")])
    return t.sort_by("group")


def _links(group_a, ids_a, group_b, ids_b, doc_of_group, base, at_once):
    """(document, pair, occurrence links) of distinct pairs per document.

    Groups of one token each are pairs as they are.  Other groups are joined in runs of about ``at_once`` distinct pairs; a larger group is joined in parts of its A ids."""
    import pyarrow as pa
    import pyarrow.compute as pc
    n = len(doc_of_group)
    one = (np.bincount(group_a, minlength=n) == 1) & (np.bincount(group_b, minlength=n) == 1)
    in_a, in_b = one[group_a], one[group_b]
    ids_a, ids_b = np.asarray(ids_a), np.asarray(ids_b)
    single = pa.table({"doc": doc_of_group[one], "pair": ids_a[in_a].astype(np.int64) * base + ids_b[in_b],
                       "times": np.ones(int(one.sum()), np.int64)})
    parts = [single.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])]
    ga, gb = _counted(group_a[~in_a], ids_a[~in_a]), _counted(group_b[~in_b], ids_b[~in_b])
    na, nb = ga["group"].to_numpy(), gb["group"].to_numpy()
    size_a, size_b = np.bincount(na, minlength=n), np.bincount(nb, minlength=n)
    rows = np.cumsum(size_b[na])  # pairs made up to and with each row of ga
    start = 0
    while start < len(na):
        done = rows[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(rows, done + at_once, "right")))
        low, high = np.searchsorted(nb, na[start]), np.searchsorted(nb, na[end - 1], "right")
        met = ga.slice(start, end - start).join(gb.slice(low, high - low).rename_columns(["group", "id_b", "n_b"]), "group",
                                                join_type="inner", use_threads=False)
        t = pa.table({"doc": doc_of_group[met["group"].to_numpy()],
                      "pair": met["id"].to_numpy().astype(np.int64) * base + met["id_b"].to_numpy(),
                      "times": pc.multiply(met["count_all"], met["n_b"])})
        parts.append(t.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]))
        start = end
    t = pa.concat_tables(parts)
    if len(parts) > 1:
        t = t.rename_columns(["doc", "pair", "times"]).group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
    return t.sort_by([("doc", "ascending"), ("pair", "ascending")])


def align_batch(v: Vocabularies, texts: list, at_once: int = 2_000_000):
    """(columns per text, in order): n_a, n_b, n_groups, n_links, digest, pairs and times as Arrow arrays."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc
    n = len(texts)
    full = [i for i, t in enumerate(texts) if t]
    a = _id_lists(v.plain_a.encode([" " + texts[i] for i in full]))
    b = _id_lists(v.b.encode([texts[i] for i in full], num_threads=1))
    want = [b" " + texts[i].encode() for i in full]
    ok = _joined_ok(a, v.a_bytes, want) & _joined_ok(b, v.b_bytes, want)
    if not ok.all():
        a, b = a.filter(pa.array(ok)), b.filter(pa.array(ok))
    docs = np.array(full, np.int64)[ok]
    zero = np.zeros(n, np.int64)
    n_a, n_b, n_groups, n_links, sizes = zero.copy(), zero.copy(), zero.copy(), zero.copy(), zero.copy()
    digest = np.full(n, "", object)
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(docs):
        doc_a, ids_a, end_a = _ends(a, v.a_bytes)
        doc_b, ids_b, end_b = _ends(b, v.b_bytes)
        left = pa.table({"doc": doc_a, "end": end_a, "at": np.arange(len(end_a))})
        right = pa.table({"doc": doc_b, "end": end_b, "at_b": np.arange(len(end_b))})
        common = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
        last_a, last_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
        last_a[common["at"].to_numpy()] = True
        last_b[common["at_b"].to_numpy()] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        doc_of_group = doc_a.to_numpy()[last_a].astype(np.int64)
        per_doc = np.bincount(doc_of_group, minlength=len(docs))
        named = pc.binary_join_element_wise(_names(v, ids_a, last_a), _names(v, ids_b, last_b),
                                             pa.scalar("|", pa.large_string()))
        by_doc = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(per_doc)]), named.cast(pa.large_string()))
        text = pc.binary_join(by_doc, pa.scalar(";", pa.large_string()))
        digest[docs] = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in text]
        t = _links(group_a, ids_a, group_b, ids_b, doc_of_group, v.base, at_once)
        pairs, times = t["pair"].to_numpy(), t["times_sum"].to_numpy()
        sizes[docs] = np.bincount(t["doc"].to_numpy(), minlength=len(docs))
        n_a[docs], n_b[docs] = np.diff(np.asarray(a.offsets)), np.diff(np.asarray(b.offsets))
        n_groups[docs] = per_doc
        n_links[docs] = np.bincount(doc_of_group, np.bincount(group_a, minlength=len(doc_of_group)) * np.bincount(group_b, minlength=len(doc_of_group)),
                                    len(docs)).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int64())) for x in (pairs, times)]
    return [pa.array(x) for x in (n_a, n_b, n_groups, n_links)] + [pa.array(digest.tolist(), pa.string()), *lists]


def _align_task(batches, paths):
    import pyarrow as pa
    from pyspark import TaskContext
    v = worker_vocabularies(paths)
    key = TaskContext.get().partitionId() << 40
    for b in small_batches(batches, 1, 1 << 19):
        texts = [t.as_py().decode("utf-8", "replace") if t.is_valid else "" for t in b.column(1).cast(pa.binary())]
        keys = pa.array(np.arange(key, key + len(b)))
        key += len(b)
        yield pa.record_batch([keys, b.column(0), *align_batch(v, texts)],
                              ["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def align_documents(docs: DataFrame, paths: Paths, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its groups' digest, its distinct id pairs (``a * size of B + b``) and how
    often each is linked; written below ``spark.checkpoint.dir`` and read again."""
    spark = docs.sparkSession
    text_batches(spark, 500)
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    path = scratch_path(spark, "aligned")
    d.mapInArrow(lambda it: _align_task(it, paths), DOC_SCHEMA).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(DOC_SCHEMA).parquet(path)


def _pair_counts_task(batches, held: int = 1_000_000):
    """(pair, documents) of a task's rows, sent on whenever ``held`` distinct pairs are in memory."""
    import pyarrow as pa
    import pyarrow.compute as pc
    kept, waiting, rows = [], [], 0

    def merged(tables):
        return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

    for b in batches:
        flat = pc.list_flatten(b.column(0))
        waiting.append(pa.table({"pair": flat, "n": np.ones(len(flat), np.int64)}))
        rows += len(flat)
        if rows >= held:
            kept, waiting, rows = [merged(kept + waiting)], [], 0
            if len(kept[0]) >= held:
                yield from kept.pop().to_batches()
    if kept or waiting:
        yield from merged(kept + waiting).to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each id pair is linked, written and read again."""
    spark = aligned.sparkSession
    partial = aligned.select("pairs").mapInArrow(_pair_counts_task, "pair long, n long")
    path = scratch_path(spark, "pair_counts")
    partial.groupBy("pair").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(path)
    return spark.read.schema("pair long, n long").parquet(path)


def frequent_from(counts: DataFrame, at_most: int) -> int:
    """The smallest power of two from which on at most ``at_most`` rows have that count ``n``."""
    steps = counts.groupBy(F.floor(F.log2("n")).alias("step")).count().collect()  # one row per power of two
    total, low = 0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["count"]
        if total > at_most:
            low = 1 << (int(r["step"]) + 1)
            break
    return low


def _frequent_task(batches, known, best, base, rare):
    """Rows' sums over the broadcast pairs, or (with ``rare``) their other pairs."""
    import pyarrow as pa
    import pyarrow.compute as pc
    pair, count = known.value
    top = best.value
    for b in batches:
        for at in range(0, len(b), 64):
            s = b.slice(at, 64)
            flat, times = (pc.list_flatten(s.column(c)).to_numpy() for c in (1, 2))
            row = pc.list_parent_indices(s.column(1)).to_numpy()
            spot = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[spot] == flat if len(pair) else np.zeros(len(flat), bool)
            if rare:
                yield pa.record_batch([s.column(0).take(pa.array(row[~hit])), pa.array(flat[~hit]), pa.array(times[~hit])], ["row_key", "pair", "times"])
                continue
            n, m, r = count[spot[hit]], times[hit], row[hit]
            is_best = n == top[flat[hit] // base]
            sums = np.zeros((2, len(s)), np.int64)
            np.add.at(sums[0], r, m * is_best)
            np.add.at(sums[1], r, m * n)
            yield pa.record_batch([s.column(0), pa.array(sums[0]), pa.array(sums[1])], ["row_key", "best", "sum"])


def alignment_report(docs: DataFrame, paths: Paths, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1_000_000) -> DataFrame:
    """Per document: token, group and link counts, links on a best pair, summed counts and the digest."""
    spark = docs.sparkSession
    aligned = align_documents(docs, paths, id_col, text_col)
    counts = pair_counts(aligned)
    base = worker_vocabularies(paths).base
    best = counts.groupBy(F.floor(F.col("pair") / base).alias("a")).agg(F.max("n").alias("top"))
    top = np.zeros(worker_vocabularies(paths).a.get_vocab_size(), np.int64)  # as many rows as A has ids
    for r in best.collect():
        top[r["a"]] = r["top"]
    low = frequent_from(counts, frequent)
    often = counts.where(F.col("n") >= low).toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))
    shared_top = spark.sparkContext.broadcast(top)
    cells = aligned.select("row_key", "pairs", "times")
    sums = cells.mapInArrow(lambda it: _frequent_task(it, known, shared_top, base, False), "row_key long, best long, sum long")
    others = cells.mapInArrow(lambda it: _frequent_task(it, known, shared_top, base, True), "row_key long, pair long, times long")
    tops = bounded(spark.createDataFrame([(a, int(t)) for a, t in enumerate(top) if t], "a long, top long"))
    met = (others.join(counts.where(F.col("n") < low), "pair").withColumn("a", F.floor(F.col("pair") / base)).join(tops, "a")
           .groupBy("row_key").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best"),
                                   F.sum(F.col("times") * F.col("n")).alias("sum")))
    added = sums.unionByName(met).groupBy("row_key").agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(added, "row_key").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
