"""Cost-balanced packing of tokenised documents into sequences (operator 2).

A sequence's cost is estimated as linear plus quadratic in its pieces,
``linear * tokens + quadratic * sum(piece ** 2)``: attention is computed within a
piece.  Documents are read in windows of about ``window`` tokens.  Whole sequences
are cut off long documents.  The rest is placed by falling length, each piece in the
cheapest sequence that still has room for it; when none has, the piece is cut over the
cheapest sequences with any room.  A window opens as many sequences as it can fill
completely and hands its remaining tokens to the next, so only the last sequence of a
partition is padded.

Every partition packs on its own, straight from the scan: there is no shuffle, no group to
be hot, and memory is bounded by a window and one document.  Sequence ids carry the
partition number, so a task that runs again gives the same ids.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as often
as they occur; a null id is kept; an empty table gives no pieces; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import text_batches

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_cost double")


class WordEncoder:
    """Token ids of texts, word by word through bounded caches.

    The tokenizer never joins characters across white space, so a text's ids are those of
    its words.  A word that is new is cut by the tokenizer's own pre-tokeniser, and its
    parts go through the model once.
    """

    def __init__(self, path: str, cache: int = 600_000):
        import re
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.cache, self.parts, self.limit = {}, {}, cache
        # Latin without the capital dotted I, whose lower case has two characters
        self.safe = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+\\Z").match
        letter, number = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.ints = list(range(self.tok.get_vocab_size()))
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.byte = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}

    def part(self, p):
        got = self.parts.get(p)
        if got is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            marks = p if p.isascii() else "".join([self.byte[b] for b in p.encode()])
            got = self.parts[p] = tuple([self.ints[t.id] for t in self.tok.model.tokenize(marks)])
        return got

    def word(self, w):
        """Ids of one word without white space."""
        low = w.lower()  # may leave the range of letters that the pattern knows
        if self.safe(w) and self.safe(low) and "<|" not in w:
            if w.isalpha():
                got = self.part(low)
            else:
                got = ()
                for p in self.split.findall(low):
                    got += self.part(p)
        else:
            got = tuple([self.ints[i] for i in self.tok.encode(w, add_special_tokens=False).ids])
        if len(self.cache) >= self.limit:
            self.cache.clear()
        self.cache[w] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text):  # Python and the tokenizer differ on these as white space
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        out, get, word = [], self.cache.get, self.word
        add = out.extend
        for w in text.split():
            got = get(w)
            add(word(w) if got is None else got)
        return np.array(out, np.uint32)


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept between tasks with its caches."""
    import sys
    import types
    home = sys.modules.setdefault("permgrid_worker_cache", types.ModuleType("permgrid_worker_cache"))
    encoders = home.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def place(pieces, count, size, linear, quadratic):
    """Places (length, key) pieces into ``count`` sequences of ``size`` tokens.

    Yields (key, start in the piece, length, sequence, offset) and returns nothing else;
    the pieces' total is at most ``count * size``.
    """
    heap = [(0.0, n, 0) for n in range(count)]  # cost, sequence, used
    out = []
    for length, key in sorted(pieces, key=lambda p: (-p[0], p[1])):
        start, left, passed = 0, length, []
        while heap:  # the cheapest sequence with room for the whole piece
            cost, n, used = heapq.heappop(heap)
            if size - used >= left:
                out.append((key, start, left, n, used))
                if used + left < size:
                    heapq.heappush(heap, (cost + linear * left + quadratic * left * left, n, used + left))
                left = 0
                break
            passed.append((cost, n, used))
        if left:  # none: cut over the cheapest ones
            full = 0
            for cost, n, used in passed:
                take = min(left, size - used)
                out.append((key, start, take, n, used))
                start, left = start + take, left - take
                full += 1
                if used + take < size:
                    heapq.heappush(heap, (cost + linear * take + quadratic * take * take, n, used + take))
                if not left:
                    break
            passed = passed[full:]
        for p in passed:
            heapq.heappush(heap, p)
    return out


def _packer(path, size, window, end_id, linear, quadratic, with_ids):
    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext
        encoder = worker_encoder(path)
        base = TaskContext.get().partitionId() << 40
        made = 0
        queue, queued = [], 0  # (doc, start, ids of the piece, tokens of the document)

        def rows(placed, pieces, first):
            cost = {}
            for key, start, length, n, offset in placed:
                cost[n] = cost.get(n, 0.0) + linear * length + quadratic * length * length
            cols = [[] for _ in range(9 if with_ids else 8)]
            for key, start, length, n, offset in placed:
                doc, at, ids, total = pieces[key]
                part = ids[start:start + length]
                row = [doc, at + start, length, zlib.crc32(part.astype("<u4").tobytes()), total, base + first + n, offset, cost[n]]
                for c, v in zip(cols, row + [part] if with_ids else row):
                    c.append(v)
            kinds = [pa.int64()] * 7 + [pa.float64()] + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names + ["ids"] * with_ids)

        def pack(last):
            nonlocal queue, queued, made
            whole, rest, pieces = [], [], []
            for doc, at, ids, total in queue:
                for s in range(0, len(ids), size):
                    part = ids[s:s + size]
                    (whole if len(part) == size else rest).append(len(pieces))
                    pieces.append((doc, at + s, part, total))
            tokens = sum(len(pieces[x][2]) for x in rest)
            count = -(-tokens // size) if last else tokens // size
            kept, over = [], tokens - count * size
            if not last:  # the shortest pieces wait for the next window
                rest.sort(key=lambda x: (-len(pieces[x][2]), x))
                while over > 0:
                    x = rest.pop()
                    doc, at, ids, total = pieces[x]
                    if len(ids) > over:
                        rest.append(len(pieces))
                        pieces.append((doc, at, ids[:len(ids) - over], total))
                        kept.append((doc, at + len(ids) - over, ids[len(ids) - over:], total))
                        over = 0
                    else:
                        kept.append(pieces[x])
                        over -= len(ids)
            placed = [(x, 0, size, n, 0) for n, x in enumerate(whole)]
            more = place([(len(pieces[x][2]), x) for x in rest], count, size, linear, quadratic)
            placed += [(x, s, length, n + len(whole), o) for x, s, length, n, o in more]
            out = rows(placed, pieces, made)
            made += len(whole) + count
            queue, queued = kept, sum(len(p[2]) for p in kept)
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id))
                queue.append((doc, 0, ids, len(ids)))
                queued += len(ids)
                if queued >= window:
                    yield pack(False)
        if queue:
            yield pack(True)
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                   window: int = 1 << 20, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of every document with the sequence and offset that each lies at.

    ``with_ids`` adds the token ids of each piece.  The tokenizer file must lie at the
    same path on the executors."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(_packer(tokenizer_path, size, window, end_id, linear, quadratic, with_ids), schema)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
