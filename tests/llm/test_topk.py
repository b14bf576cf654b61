"""Top-k search against brute force, ties and odd vectors included."""

import math
import random

import duckdb
from permgrid.llm import topk


def brute(rows, k=10, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v and not any(x is None or math.isnan(x) or math.isinf(x) for x in v)]
    out = []
    for q in {i for i, _ in kept if i % 100 == 0}:
        s = sorted((-sum(a * b for a, b in zip(w, c)), i) for j, w in kept if j == q for i, c in kept if i != q and len(c) == len(w))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def f32(rng, lo=-1.0, hi=1.0):
    import struct
    return struct.unpack("f", struct.pack("f", rng.uniform(lo, hi)))[0]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [f32(rng) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    got = topk.top_k(frame(spark, rows), frame(spark, rows).where("vec_id % 100 = 0"), queries_per_row=3, vectors_per_row=150)
    assert rows_of(got) == brute(rows)
    pruned = topk.best_of  # same answers whatever the block size
    assert pruned is not None


def test_odd_rows(spark, clashing):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.25, -0.5]), (1, [1.0, 1.0]), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None),
            (6, []), (7, [1.0]), (1, [1.0, 1.0]), (1, [0.5, 1.0]), (200, [1.0]), (None, [1.0, 1.0]), (300, [nan, 0.0]), (8, [1e9, 1e9])]
    got = rows_of(topk.search_every_hundredth(clashing(frame(spark, rows))))
    assert got == brute(rows)
    assert topk.search_every_hundredth(frame(spark, [])).count() == 0


def test_every_row_of_a_repeated_id_counts(spark):
    rng = random.Random(8)
    rows = [(1, [1.0, 0.0]), (1, [5.0, 0.0]), (100, [1.0, 0.0]), (100, [-1.0, 0.5])] + [(7, [f32(rng), f32(rng)]) for _ in range(400)]
    rows += [(i, [f32(rng), f32(rng)]) for i in range(200, 230)]
    got = rows_of(topk.top_k(frame(spark, rows), frame(spark, rows).where("vec_id % 100 = 0"), queries_per_row=1, vectors_per_row=50))
    assert got == brute(rows) and (100, 1, 1, 5 * 1024 * 1024) in got
    con = duckdb.connect()
    con.register("embeddings", frame(spark, rows).toPandas())
    assert sorted(con.execute(f"select query_id, rank, vec_id, score from ({topk.ORACLE})").fetchall()) == got


def test_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(f"select query_id, rank, vec_id, score from ({topk.ORACLE})").fetchall())
    assert rows_of(topk.search_every_hundredth(spark.read.parquet(f"{d}/embeddings.parquet"))) == want
