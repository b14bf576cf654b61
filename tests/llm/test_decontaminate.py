"""Containment search against brute force and SQL, on both ways of joining."""

import random
import re

import duckdb
import pytest
from permgrid.llm import decontaminate as D

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            k = min(5, len(words(x))) or 1
            q, n = shingles(x, k), len(shingles(t, k) & shingles(x, k))
            if d is not None and i is not None and q and 100 * n >= 80 * len(q):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (n / len(q), len(q), n))
    return sorted((d, i, q, n) for (d, i), (_, q, n) in out.items())


def cases():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(3, 90)))) for i in range(30)] + [(40, None), (41, ""), (42, "a b c d"), (43, "w1 W2"), (44, "w7"), (45, " w5\tw6  w7 "), (46, "A b C"), (None, "x y z u v w"),
                                                                         (3, "again other words for one id here")]
    docs = []
    for d in range(80):
        t = say(rng.randint(0, 400))
        for _ in range(rng.randint(0, 2)):
            x = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(vocabulary)
            at = rng.randint(0, len(t))
            t[at:at] = x
        docs.append((d, " ".join(t)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[5][1].upper() + " \n " * 3), (502, "other"), (503, items[3][1]), (504, "x a B c D y"), (505, "w1 w2"), (506, "w1w2"), (507, "w7")]
    return docs, items


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_against_brute_force(spark, documents, clashing, most):
    docs, items = cases()
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = D.contained_items(clashing(documents(docs)), bench, max_shingles=most)
    assert sorted((r.doc, r.item, r.q, r.n) for r in got.collect()) == brute(docs, items)


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated_documents(documents([(1, "a b c d e f")]), none).count() == 0
    assert D.contaminated_documents(documents([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_drop(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    df = documents([(1, "x one two three four five six seven y"), (2, "one two three"), (None, "kept"), (3, None)])
    kept = D.drop_contaminated(df, bench)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3] and kept.columns == df.columns


def test_sql_on_short_items_and_repeated_ids(documents, spark):
    docs, items = cases()
    con = duckdb.connect()
    con.register("d", documents(docs).toPandas())
    con.register("b", spark.createDataFrame(items, "item_id long, text string").toPandas())
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, text from d where doc_id <> 502")
    con.execute("create view benchmark as select cast(item_id as bigint) as item_id, text from b where item_id <> 3")
    want = sorted(con.execute(f"select doc_id, item_id, item_shingles, shared from ({D.ORACLE})").fetchall())
    kept = [r for r in docs if r[0] != 502], [r for r in items if r[0] != 3]
    assert want == brute(*kept) and any(i in (42, 43, 44, 45) for _, i, _, _ in want)


def test_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    cols = "doc_id, item_id, item_shingles, shared"
    want = sorted(con.execute(f"select {cols} from ({D.ORACLE})").fetchall())
    got = D.contaminated_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert sorted(tuple(r) for r in got.select(*cols.split(", ")).collect()) == want and want
