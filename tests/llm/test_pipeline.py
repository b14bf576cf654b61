"""The corpus pipeline: every stage against what its own input must lead to."""

import corpus_pipeline as P
import pytest
from permgrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, documents, tmp_path):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(i, f"plain start {i} {words(f'd{i}x', 30)}\nshared closing line of all plain texts") for i in range(30)]
    rows += [(100 + i, f"{words(f't{i}x', 20)} grumbl {words(f'u{i}x', 9)}") for i in range(30)]
    near = [f"n{i}" for i in range(60)]
    rows += [(200, " ".join(near)), (201, " ".join(near[:30] + ["new"] + near[30:])), (202, " ".join(near))]
    rows += [(300, f"{words('q', 20)} {words('leak', 12)} {words('r', 20)}"), (400, None), (401, "")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words("leak", 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    ids, columns = {}, docs.columns
    for n, (name, stage) in enumerate(P.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    clean = list(range(30))
    assert ids["toxicity"] == clean + [200, 201, 202, 300, 400, 401]
    # line dedup takes the repeated line from all but the first text, and the copy that is one repeated line
    assert [i for i in ids["line_dedup"] if i < 200] == clean and 202 not in ids["line_dedup"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/line_dedup").collect()}
    assert sum("shared closing" in (t or "") for t in text.values()) == 1
    assert 201 not in ids["ngram_jaccard_join"] and 200 in ids["ngram_jaccard_join"]
    assert ids["decontamination"] == clean + [200, 400, 401]
    packed = P.STAGES[-1][1](spark, docs, folder)
    assert sorted({r.doc_id for r in packed.select("doc_id").collect()}) == ids["decontamination"]
    whole = P.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length").collect())) == \
        sorted(map(tuple, packed.select("doc_id", "start", "length").collect()))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
