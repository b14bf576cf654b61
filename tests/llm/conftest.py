"""Small builders shared by the operator tests."""

import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")  # as Spark sets it for Python workers on a cluster

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Makes a documents table from (id, text) rows."""
    def make(rows):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture()
def clashing():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["doc", "n", "a", "b", "row", "id", "v", "x", "key", "root", "node", "sig", "line", "ident", "h", "item", "q"]
        for name in names:
            df = df.withColumn(name, F.lit("clash"))
        return df
    return add
