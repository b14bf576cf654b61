"""Vectorised word and shingle hashes over Arrow text columns.

A whole Arrow batch is hashed on its UTF-8 buffer with numpy: no Python object is made
per word.  Texts are walked in chunks of about 256 KB that end between words, so
memory does not grow with the length of a text.  A null text counts as empty.

Hashes are 64 bits wide: every byte has a random 64-bit value, a word is the polynomial
of those values and is then mixed.  Two different words collide with a probability of
about 2**-64.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18


def mix(h):
    """A bijective finaliser on uint64 arrays."""
    h = np.asarray(h, dtype=np.uint64).copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C55)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(32)
    return h


def space_separators():
    """Bytes between words: space and \\x09-\\x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def alnum_separators():
    """Bytes between words of ASCII letters, digits and everything beyond ASCII."""
    t = np.ones(256, bool)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        t[a:b] = False
    return t


def small_batches(batches, text: int, limit: int = 1 << 20):
    """Slices of Arrow batches whose ``text`` column has about ``limit`` bytes (or one longer row):
    what is worked out from a slice then takes a bounded multiple of that."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(b):
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield b.slice(start, end - start)
            start = end


class WordHasher:
    """Hashes the words of text columns; ASCII letters count alike in either case."""

    def __init__(self, separators, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sep = separators
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        for c in range(65, 91):
            self.value[c] = self.value[c + 32]
        self.base = int(rng.integers(2**62, 2**63)) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.coef = rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
        self._powers(CHUNK + 4096)

    def _powers(self, n):
        for name, b in (("pow", self.base), ("inv", self.inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    @staticmethod
    def buffer(texts):
        """(bytes, offsets) of an Arrow string array, nulls as empty texts."""
        import pyarrow as pa
        import pyarrow.compute as pc
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        return data, off - (off[0] if n else 0)

    def spans(self, texts):
        """(word starts, ends as byte positions, words per text, buffer, offsets, hashes)."""
        data, off = self.buffer(texts)
        n = len(data)
        parts, pos = [], 0
        while pos < n:
            end = min(n, pos + CHUNK)
            if end < n:
                cut = np.flatnonzero(self.sep[data[pos:end]])
                best = pos + cut[-1] + 1 if len(cut) else pos
                border = off[np.searchsorted(off, end, "right") - 1]
                end = max(best, border)
                if end <= pos:  # one word longer than a chunk
                    nxt = np.flatnonzero(self.sep[data[pos:]])
                    after = off[np.searchsorted(off, pos, "right")]
                    end = int(min(after, pos + nxt[0] + 1 if len(nxt) else n))
            parts.append((pos, end))
            pos = end
        ss, ee, hh = [], [], []
        for a, b in parts:
            d = data[a:b]
            if len(d) > len(self.pow):
                self._powers(len(d))
            word = ~self.sep[d]
            first, last = word.copy(), word.copy()
            before = word[:-1].copy()
            inner = off[np.searchsorted(off, a, "right"):np.searchsorted(off, b, "left")] - a
            before[inner - 1] = False
            first[1:] &= ~before
            last[:-1] &= ~(word[1:] & before)
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            c = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(self.value[d] * self.pow[:len(d)], out=c[1:])
            hh.append(mix((c[e] - c[s]) * self.inv[s]))
            ss.append(s + a)
            ee.append(e + a)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        s = cat(ss, np.int64)
        counts = np.diff(np.searchsorted(s, off)) if len(off) > 1 else np.zeros(0, np.int64)
        return s, cat(ee, np.int64), counts, data, off, cat(hh, np.uint64)

    def words(self, texts):
        """(hashes of all words, words per text)."""
        _, _, counts, _, _, h = self.spans(texts)
        return h, counts

    def shingles(self, texts, k: int = 5, short_as_one: bool = True):
        """Yields one sorted array of distinct shingle hashes per text.

        A text with fewer than ``k`` words gives its whole sequence as one shingle
        (or none, if ``short_as_one`` is off); a text without words gives none.
        """
        h, counts = self.words(texts)
        total = len(h)
        rolled = np.zeros(0, np.uint64)
        if total >= k:
            acc = np.zeros(total - k + 1, np.uint64)
            for j in range(k):
                acc += mix(h[j:total - k + 1 + j] + self.coef[j]) * self.coef[j]
            rolled = mix(acc)
        at = 0
        for m in counts.tolist():
            if m >= k:
                yield np.unique(rolled[at:at + m - k + 1])
            elif m and short_as_one:
                yield mix((mix(h[at:at + m] + self.coef[:m]) * self.coef[:m]).sum(keepdims=True, dtype=np.uint64)
                          + self.coef[m:m + 1])
            else:
                yield np.zeros(0, np.uint64)
            at += m
