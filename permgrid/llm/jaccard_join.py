"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures (operator 7).

Sets are put in bands of nearly equal size.  Within a band two sets of similarity
``num/den`` or more differ in at most k elements, so when the feature domain is cut
into n > k ranges, at least n - k ranges hold the same elements in both.  Every
single-range subset is enumerated as a signature: (band, range, content).  A set signs
for its own band and for the next one that a larger partner may lie in.

*Empty ranges* are no signature.  A set with fewer than n - k empty ranges is safe: a
partner must agree with it on a range that holds something.  Unsafe sets sign again
under another permutation of the domain, up to ``SEEDS`` times, and a set that is still
unsafe signs with one fallback mark.  A signature names its band and its permutation.

*Groups.*  Rows of one signature meet in one partition in sorted order and are read as a
stream.  A group links its members to its smallest one (star), never all pairs.  When a
star pair of a small group turns out not to be linked, the members of that leader are
compared with it one by one.  A signature of more than ``big`` members counts as empty:
only sets that have too few other signatures of their last permutation left, or a hot one
of an earlier permutation (where a partner may have stopped), are compared beyond the
star, and these in blocks of bounded size which return a spanning forest, so that a group of near
copies never becomes a list of all its pairs.

*Verification* is exact: a parity sketch (its distance never exceeds that of the sets)
drops hopeless pairs, the rest is compared on whole shingle sets.

Edge cases: a null text is empty; a text without words has an empty set, links to
nothing and is its own component; a text with fewer than five words is one shingle; rows
with a null id keep a null component; rows that repeat an id share its component.
Columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import bounded, components, saved, text_batches
from permgrid.llm.wordhash import WordHasher, mix, small_batches, space_separators

NUM, DEN = 80, 100
SEEDS = 6


def bands(limit: int = 1 << 40) -> list[int]:
    """Smallest sizes of the bands: each band is half as wide again as the one before."""
    lo = [1]
    while lo[-1] < limit:
        lo.append(max(lo[-1] + 1, lo[-1] * 3 // 2))
    return lo


def parts_of(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """(k, n): the largest difference within a band, and how many ranges to cut."""
    k = int((den - num) * 2 * hi // (den + num))
    if k == 0:
        return 0, 1
    n, m = k + 1, max(1, lo * num // den)  # the smallest set that signs for this band
    while n * (1 - np.exp(-m / n)) < k + 1 + 0.3 * np.sqrt(n) and n < 2 * lo + 8:
        n += max(1, n // 100)
    return k, n


class Signer:
    """Signatures of sorted arrays of distinct shingle hashes."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lo, self.plan = num, den, np.array(bands(), np.int64), {}

    def parts(self, j):
        """k, the inner borders of the n ranges, and a mark for each range."""
        if j not in self.plan:
            k, n = parts_of(int(self.lo[j]), int(self.lo[j + 1]) - 1, self.num, self.den)
            border = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
            self.plan[j] = k, border, mix(np.arange(n, dtype=np.uint64) + np.uint64(j << 48))
        return self.plan[j]

    def sign(self, u):
        """(signatures, instances, slacks, last seeds) of one set; instance i has slack n - k - empty."""
        m = len(u)
        if not m:
            return np.zeros(0, np.int64), [], [], []
        first = int(np.searchsorted(self.lo, m, "right")) - 1
        last = int(np.searchsorted(self.lo, m * self.den // self.num, "right")) - 1
        orders, out, inst, slacks, seeds = [], [], [], [], []
        for j in range(first, last + 1):
            k, border, mark = self.parts(j)
            slack = 0
            for seed in range(SEEDS):
                if seed == len(orders):
                    w = u if seed == 0 else np.sort(mix(u + np.uint64(seed * 0x9E3779B9)))
                    c = np.zeros(m + 1, np.uint64)
                    np.cumsum(mix(w + np.uint64(0x51ED270B)), out=c[1:])
                    orders.append((w, c))
                w, c = orders[seed]
                edge = np.zeros(len(mark) + 1, np.int64)
                edge[1:-1] = np.searchsorted(w, border)
                edge[-1] = m
                full = np.flatnonzero(edge[1:] > edge[:-1])
                at = c[edge]
                out.append(self.tag(at[full + 1] - at[full] + mark[full] + np.uint64(seed << 40), j, seed))
                slack = len(full) - k
                if slack > 0:
                    break
            if slack <= 0:
                out.append(self.tag(np.array([j + 1], np.uint64) * np.uint64(0xABCDEF12345), j, SEEDS))
            inst.append(j)
            slacks.append(max(slack, 0))
            seeds.append(seed)
        return np.concatenate(out), inst, slacks, seeds

    @staticmethod
    def tag(h, j, seed):
        return ((mix(h) & ~np.uint64(0x7FF)) | np.uint64(seed << 8 | j)).view(np.int64)


def sketch(u):
    """Parity of the number of elements in each of at least 2 * len(u) cells, packed in longs."""
    cells = 1 << max(11, (2 * len(u) - 1).bit_length())
    odd = (np.bincount((u >> np.uint64(16)).astype(np.int64) & (cells - 1), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def parity_gap(x, y) -> int:
    """Cells that differ between two sketches; never more than the sets differ."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def folded(sk, other):
    """A sketch at the resolution of ``other``: halves of the finer one fold onto each other."""
    half = f"size({other})"
    return (f"if(size({sk}) > {half}, zip_with(slice({sk}, 1, {half}), slice({sk}, {half} + 1, {half}), (p, q) -> p ^ q), {sk})")


def _copy_key(u):
    return int(u.sum(dtype=np.uint64).view(np.int64)), int(mix(u).sum(dtype=np.uint64).view(np.int64))


def _profiles(words):
    def run(batches):
        import pyarrow as pa
        hasher = WordHasher(space_separators())
        for b in small_batches(batches, 1):
            n, h1, h2, sk = [], [], [], []
            for u in hasher.shingles(b.column(1), words):
                n.append(len(u))
                x, y = _copy_key(u) if len(u) else (0, 0)
                h1.append(x)
                h2.append(y)
                sk.append(sketch(u))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(sk, pa.list_(pa.int64()))], names=["doc", "n", "h1", "h2", "sk"])
    return run


def _slacks(words):
    def run(batches):
        import pyarrow as pa
        hasher, signer = WordHasher(space_separators()), Signer(NUM, DEN)
        for b in small_batches(batches, 1):
            doc, inst, slack, last = [], [], [], []
            for d, u in zip(b.column(0).to_pylist(), hasher.shingles(b.column(1), words)):
                _, i, s, t = signer.sign(u)
                doc += [d] * len(i)
                inst += i
                slack += s
                last += t
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(inst, pa.int32()), pa.array(slack, pa.int64()),
                                              pa.array(last, pa.int32())], names=["doc", "inst", "slack", "last"])
    return run


def _signatures(words):
    def run(batches):
        import pyarrow as pa
        hasher, signer, seen = WordHasher(space_separators()), Signer(NUM, DEN), set()
        for b in small_batches(batches, 1):
            ids, sigs = [], []
            for doc, u in zip(b.column(0).to_pylist(), hasher.shingles(b.column(1), words)):
                key = (len(u), *_copy_key(u)) if len(u) else None
                if doc is None or key is None or key in seen:
                    continue  # an equal set of this task already signs; copies are linked by their keys
                if len(seen) < 2_000_000:
                    seen.add(key)
                ids.append(doc)
                sigs.append(signer.sign(u)[0])
            values = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            off = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(values, pa.int64()))],
                names=["doc", "sigs"])
    return run


def _stars(big):
    """Streams rows sorted by (sig, doc); yields (a = leader, b = member, inst, hot); inst has the seed above its eighth bit."""
    def run(batches):
        import pyarrow as pa
        carry_s, carry_d, carry_big = np.zeros(0, np.int64), np.zeros(0, np.int64), False

        def groups(s, d, first_big):
            if not len(s):
                return None
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.concatenate([starts, [len(s)]]))
            lead, sizes = np.repeat(d[starts], size), np.repeat(size, size)
            hot = sizes > big
            if first_big:
                hot[:size[0]] = True
            small = (sizes > 1) & ~hot & (d != lead)
            inst = (s & 0x7FF).astype(np.int32)
            none = np.zeros(small.sum(), np.int64)
            rows = np.concatenate([
                np.stack([lead[small], d[small], none - 1, none], 1),
                np.stack([lead[hot], d[hot], inst[hot].astype(np.int64), np.ones(hot.sum(), np.int64)], 1)])
            if not len(rows):
                return None
            keys, n = np.unique(rows, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 2].astype(np.int32)),
                 pa.array(np.where(keys[:, 3] > 0, n, 0).astype(np.int64))], names=["a", "b", "inst", "hot"])

        for b in batches:
            s = np.concatenate([carry_s, b.column(0).to_numpy()])
            d = np.concatenate([carry_d, b.column(1).to_numpy()])
            if not len(s):
                continue
            cut = int(np.searchsorted(s, s[-1]))
            whole = cut == 0  # one run so far
            run_big = (carry_big and (whole or s[0] == s[-1])) or len(s) - cut > big
            if cut:
                out = groups(s[:cut], d[:cut], carry_big)
                if out is not None:
                    yield out
                run_big = len(s) - cut > big
            if run_big:
                out = groups(s[cut:], d[cut:], True)
                if out is not None:
                    yield out
                carry_s, carry_d = s[cut:cut + 1], d[cut:cut + 1]
            else:
                carry_s, carry_d = s[cut:], d[cut:]
            carry_big = run_big
        out = groups(carry_s, carry_d, carry_big) if not (carry_big and len(carry_s) == 1) else None
        if out is not None:
            yield out
    return run


def _verify(words, num, den):
    """Rows (a, b, text of a, text of b) -> the pairs that reach the similarity."""
    def run(batches):
        import pyarrow as pa
        hasher = WordHasher(space_separators())
        for b in small_batches(batches, 3):
            keep, last, left = [], None, None
            for key, x, y in zip(b.column(0).to_pylist(), range(len(b)), hasher.shingles(b.column(3), words)):
                if key != last:
                    last, left = key, next(hasher.shingles(b.column(2).slice(x, 1), words))
                both = len(np.intersect1d(left, y, assume_unique=True))
                keep.append(den * both >= num * (len(left) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _compare_blocks(words, num, den):
    """Rows (cluster, i, j, side, doc, text) of one pair of blocks -> a spanning forest of its links."""
    def run(pdf):
        import pandas as pd
        import pyarrow as pa
        hasher = WordHasher(space_separators())
        sets = list(hasher.shingles(pa.array(pdf.text, pa.string()), words))
        size = np.array([len(u) for u in sets])
        par = [sketch(u).view(np.uint64) for u in sets]
        docs, side, root = pdf.doc.to_numpy(), pdf.side.to_numpy(), pdf.root.to_numpy()
        names = {}
        up = np.array([names.setdefault(r, len(names)) for r in root])
        parent = list(range(len(names)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        same = len(set(side.tolist())) == 1
        found = []
        for x in range(len(docs)) if same else np.flatnonzero(side == 0):
            other = np.arange(x + 1, len(docs)) if same else np.flatnonzero(side == 1)
            both = size[other] + size[x]
            ok = (np.minimum(size[other], size[x]) * den >= np.maximum(size[other], size[x]) * num) & (size[x] > 0)
            other, both = other[ok], both[ok]
            for y, total in zip(other.tolist(), both.tolist()):
                p, q = find(up[x]), find(up[y])
                if p != q and parity_gap(par[x], par[y]) * (den + num) <= total * (den - num):
                    n = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * n >= num * (size[x] + size[y] - n):
                        parent[p] = q
                        found.append((docs[x], docs[y]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       num: int = NUM, den: int = DEN, big: int = 16, block: int = 400) -> DataFrame:
    """(doc, n, component) per row of ``docs``: linked when den * common >= num * united.

    ``big`` is where a signature group counts as hot, ``block`` the rows of a block;
    neither changes the result.
    """
    if (num, den) != (NUM, DEN):
        raise ValueError("the similarity is fixed at 80 of 100")
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    prof = saved(rows.mapInArrow(_profiles(words), "doc long, n long, h1 long, h2 long, sk array<long>"))
    # equal sets: one representative each
    key = ["n", "h1", "h2"]
    known = prof.where("doc is not null and n > 0")
    reps = known.groupBy(*key).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = saved(known.join(reps, key).where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct())

    signed = rows.mapInArrow(_signatures(words), "doc long, sigs array<long>")
    signed = signed.select(F.explode("sigs").alias("sig"), "doc").select("sig", "doc")
    stars = (signed.repartition("sig").sortWithinPartitions("sig", "doc")
             .mapInArrow(_stars(big), "a long, b long, inst int, hot long"))
    stars = saved(stars.groupBy("a", "b", "inst").agg(F.sum("hot").alias("hot")))

    one = known.dropDuplicates(["doc"]).select("doc", "n", "h1", "h2", "sk")

    def near(pairs):
        """Pairs that the parity sketches do not rule out."""
        x = one.select(*(F.col(c).alias("a" if c == "doc" else f"x_{c}") for c in one.columns))
        y = one.select(*(F.col(c).alias("b" if c == "doc" else f"y_{c}") for c in one.columns))
        gap = (f"aggregate(zip_with({folded('x_sk', 'y_sk')}, {folded('y_sk', 'x_sk')}, (p, q) -> bit_count(p ^ q)), "
               "0, (s, v) -> s + v)")
        return (pairs.join(x, "a").join(y, "b")
                .where("not (x_n = y_n and x_h1 = y_h1 and x_h2 = y_h2)")
                .where(f"least(x_n, y_n) * {den} >= greatest(x_n, y_n) * {num}")
                .where(f"greatest(size(x_sk), size(y_sk)) <= 2 * least(size(x_sk), size(y_sk))")
                .where(f"{gap} * {den + num} <= (x_n + y_n) * {den - num}").select("a", "b"))

    def verified(pairs):
        pairs = saved(near(pairs))
        ids = saved(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct())
        texts = rows.join(bounded(ids), "doc", "left_semi").dropDuplicates(["doc"])
        x = texts.select(F.col("doc").alias("a"), F.col("text").alias("x"))
        y = texts.select(F.col("doc").alias("b"), F.col("text").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return saved(both.mapInArrow(_verify(words, num, den), "a long, b long"))

    # sets that have too few signatures of their last seed besides hot ones; a partner that stopped at an
    # earlier seed shares signatures of that seed only, so there one hot signature is enough
    hot = stars.where("hot > 0").select("a", "b", (F.col("inst") % 256).alias("inst"), F.shiftright("inst", 8).alias("seed"), "hot")
    load = saved(hot.groupBy(F.col("b").alias("doc"), "inst", "seed").agg(F.sum("hot").alias("hot")))
    slack = (rows.join(bounded(saved(load.select("doc").distinct())), "doc", "left_semi")
             .mapInArrow(_slacks(words), "doc long, inst int, slack long, last int"))
    unsafe = saved(load.join(slack, ["doc", "inst"]).where("hot >= slack or seed < last").select("doc", "inst").distinct())
    # a safe set meets its partners in cold groups, so hot stars matter between unsafe sets only
    hot = hot.select("a", "b", "inst").distinct()
    tied = (hot.where("a <> b").join(unsafe.withColumnRenamed("doc", "a"), ["a", "inst"], "left_semi")
            .join(unsafe.withColumnRenamed("doc", "b"), ["b", "inst"], "left_semi").select("a", "b"))
    small = stars.where("hot = 0 and a <> b").select("a", "b")
    pairs = saved(small.unionByName(tied).distinct())
    edges = saved(copies.unionByName(verified(pairs)))
    roots = saved(components(edges))

    def rooted(df, *cols):
        for c in cols:
            r = roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
            df = df.join(r, c, "left").withColumn(f"r_{c}", F.coalesce(f"r_{c}", c))
        return df

    # members of one leader that the leader does not connect
    members = rooted(small.distinct(), "a", "b")
    apart = members.where("r_a <> r_b").select("a", F.col("b").alias("m"), F.col("r_b").alias("r_m"))
    cross = (apart.join(members.select("a", "b", "r_b"), "a").where("r_m <> r_b and m <> b")
             .select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).distinct())
    second = verified(cross.join(pairs, ["a", "b"], "left_anti"))

    shared = (hot.join(unsafe.withColumnRenamed("doc", "b"), ["b", "inst"])
              .select(F.concat_ws(":", "inst", "a").alias("lead"), "b", "inst"))
    third = _blocks(rows, prof, saved(rooted(shared, "b")), words, num, den, block)

    edges = edges.unionByName(second).unionByName(third)
    final = saved(components(edges))
    out = prof.select("doc", "n").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select("doc", "n", F.coalesce("root", "doc").alias("component"))


def _blocks(rows, prof, shared, words, num, den, block):
    """Links between unsafe sets that share hot signatures, compared in pairs of blocks."""
    if shared.select("r_b").distinct().limit(2).count() < 2:
        return saved(shared.select(F.col("b").alias("a"), "b").limit(0))
    # clusters of documents tied by hot signatures of an instance, with the roots known so far
    tie = shared.select("b", "inst", "lead").distinct()
    first = tie.groupBy("lead").agg(F.min("b").alias("m"))
    ties = tie.join(first, "lead").select("inst", F.col("m").alias("a"), "b").distinct()
    code = lambda c: F.col(c) * 256 + F.col("inst")
    comp = components(ties.select(code("a").alias("a"), code("b").alias("b")))
    who = (shared.select("b", "inst", "r_b").distinct().withColumn("node", code("b")).join(comp, "node")
           .select(F.col("root").alias("cluster"), F.col("b").alias("doc"), F.col("r_b").alias("root")))
    mixed = who.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("p"), F.max("root").alias("q"))
    mixed = mixed.where("p <> q").withColumn("blocks", F.ceil(F.col("c") / block).cast("int")).select("cluster", "blocks")
    who = saved(who.join(mixed, "cluster").withColumn("i", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")))
    pairs = who.select("cluster", "doc", "root", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    pairs = pairs.select("cluster", "doc", "root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
                         F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"))
    ids = saved(who.select("doc").distinct())
    texts = rows.join(bounded(ids), "doc", "left_semi").dropDuplicates(["doc"])
    found = pairs.join(texts, "doc").groupBy("cluster", "i", "j").applyInPandas(_compare_blocks(words, num, den), "a long, b long")
    return saved(found)


def near_duplicate_documents(docs: DataFrame) -> DataFrame:
    """The query: doc_id, n_shingles, component_id per document."""
    return jaccard_components(docs).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                                           F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a smaller linked id stands for (null ids stay)."""
    gone = saved(jaccard_components(docs).where("component <> doc").select("doc").distinct())
    return docs.join(bounded(gone.withColumnRenamed("doc", "doc_id")), "doc_id", "left_anti").select(*docs.columns)
