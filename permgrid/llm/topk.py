"""Exact top-k inner-product search with block-at-a-time pruning (operator 4).

Vectors become integers, floor(scale * x).  A dimension is treated as a term.  Vectors
are cut into blocks by ranges of their id; a block keeps its vectors (the forward index)
and, per term, the largest and the smallest weight.  For a query, a block's bound is the
sum over terms of the best that the term can add, so no vector of the block scores more.
Within a task a query visits blocks by falling bound and stops at the first block
whose bound is below its k-th score so far; ties are kept by scoring equal bounds too.

Blocks travel in rows of ``blocks_per_row`` blocks, queries in rows of ``queries_per_row``
queries, and each row of blocks meets each row of queries once through an equi-join on
both row numbers.  No query list is broadcast or collected.

Edge cases: vectors that are null, empty or hold null, NaN or infinite components take no
part; a vector whose length differs from the query's is no candidate; every row of a repeated id is a
candidate, and such a query id returns the best over its rows; a query never returns its own id; ties go to the
smaller id; an empty table gives an empty result; null ids take no part; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permgrid.llm.links import saved

BLOCK = 128
PACK = "row long, dim int, ids binary, weights binary"


def _pack(per_row, salt):
    """Rows (id, v) -> rows of up to ``per_row`` vectors of one length."""
    def run(batches):
        import pandas as pd
        made = 0
        open_ids, open_vec = {}, {}
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()

        def close(dim):
            nonlocal made
            ids, vec = open_ids.pop(dim), open_vec.pop(dim)
            row = (task << 32) + made
            made += 1
            return {"row": row, "dim": dim, "ids": np.array(ids, np.int64).tobytes(),
                    "weights": np.array(vec, np.int64).tobytes()}

        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"].tolist(), pdf["v"]):
                d = len(v)
                open_ids.setdefault(d, []).append(i)
                open_vec.setdefault(d, []).append(v)
                if len(open_ids[d]) == per_row:
                    out.append(close(d))
            yield pd.DataFrame(out, columns=["row", "dim", "ids", "weights"])
        yield pd.DataFrame([close(d) for d in list(open_ids)], columns=["row", "dim", "ids", "weights"])
    return run


def best_of(qids, q, ids, w, k, block=BLOCK):
    """The k best (query, id, score) of each query among the vectors ``w``, by blocks."""
    cuts = list(range(0, len(ids), block))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(w).max(initial=0)) * max(1, w.shape[1]) < 2**53
    kind = np.float64 if exact else object
    qf, wf = q.astype(kind), w.astype(kind)
    high = np.stack([wf[c:c + block].max(0) for c in cuts])
    low = np.stack([wf[c:c + block].min(0) for c in cuts])
    zero = kind(0) if exact else 0
    bound = np.maximum(qf, zero) @ high.T + np.minimum(qf, zero) @ low.T
    out_q, out_i, out_s = [], [], []
    for n in range(len(qids)):
        top_i, top_s, kth = np.zeros(0, np.int64), np.zeros(0, kind), None
        for b in np.argsort(-bound[n], kind="stable"):
            if kth is not None and bound[n, b] < kth:
                break
            i = ids[cuts[b]:cuts[b] + block]
            s = wf[cuts[b]:cuts[b] + block] @ qf[n]
            ok = i != qids[n]
            if kth is not None:
                ok &= s >= kth
            if not ok.any():
                continue
            top_i, top_s = np.concatenate([top_i, i[ok]]), np.concatenate([top_s, s[ok]])
            if len(top_i) > k:
                order = np.lexsort((top_i, -top_s))[:k]
                top_i, top_s = top_i[order], top_s[order]
            if len(top_i) == k:
                kth = top_s.min()
        out_q.append(np.full(len(top_i), qids[n]))
        out_i.append(top_i)
        out_s.append(np.array([int(x) for x in top_s], np.int64))
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _search(k):
    def run(batches):
        import pandas as pd
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q = np.frombuffer(r.q_weights, np.int64).reshape(len(qids), -1)
                w = np.frombuffer(r.weights, np.int64).reshape(len(ids), -1)
                a, b, s = best_of(qids, q, ids, w, k)
                yield pd.DataFrame({"query_id": a, "vec_id": b, "score": s})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
          scale: int = 1024, queries_per_row: int = 1024, vectors_per_row: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors for every row of ``queries``."""
    def integers(df):
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        good = F.forall(F.col("x"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (df.select(F.col(id_col).cast("long").alias("id"), v.alias("x"))
                .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & good)
                .select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")))

    def in_rows(df, size, kind):  # rows of one id may be dealt to several tasks
        order = ["id", F.xxhash64("v")]
        return saved(integers(df).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_pack(size, kind), PACK))

    index, asked = in_rows(vectors, vectors_per_row, 0), in_rows(queries, queries_per_row, 1)
    asked = asked.select(F.col("row").alias("q_row"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
                         F.col("weights").alias("q_weights"))
    # every (query row, block row) of one length: ids of rows first, then their contents
    q_rows = asked.select("q_row", F.col("q_dim").alias("dim"))
    met = index.select("row", "dim").join(q_rows, "dim").select("row", "q_row")
    # a stated number of tasks, which is not merged again: the rows are few, but each is much work
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.join(index, "row").join(asked, "q_row").repartition(tasks, "row", "q_row").select("q_ids", "q_weights", "ids", "weights")
    found = pairs.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_every_hundredth(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where("vec_id % 100 = 0"))


ORACLE = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
