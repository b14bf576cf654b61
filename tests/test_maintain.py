"""Buckets, and the maintained matrix against one made anew."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from permgrid.operators.changes import accepted_changes, bulk_change, delete_grants, update_grants
from permgrid.operators.importer import csv_import
from permgrid.plans import maintain as M
from permgrid.plans.entitlement import inventory_folders, principal_folder_ranks
from permgrid.schemas import GRANTS
from permgrid.sources import buckets as B
from permgrid.sources import fixtures as fx
from permgrid.sources.tables import conform

SF, WHEN = "/root/testdata/sf0.001", "2026-01-01 00:00:00"


@pytest.fixture()
def matrix(spark, tmpdir_path):
    m = M.MaintainedMatrix(spark, tmpdir_path, 16)
    m.build(conform(fx.grants(spark, SF), GRANTS), inventory_folders(fx.files(spark, SF)))
    return m


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def check(m):
    anew = M.support(m.folders(), M.cover_rules(m.grants()))
    assert same(m.support(), anew)
    assert same(M.strongest(m.support()), principal_folder_ranks(m.folders(), m.grants()))


def some(spark, n):
    """A few changes, some of which hit grants: those grants' keys with new values."""
    g = fx.grants(spark, SF).orderBy("principal_id", "volume", "folder_path").limit(n)
    return g.withColumn("seq", F.monotonically_increasing_id()).withColumn(
        "permission", F.when(F.col("seq") % 3 == 0, F.lit("")).when(F.col("seq") % 3 == 1, F.lit("DOWNLOAD")).otherwise(F.lit("READ")))


def test_built_state(matrix):
    check(matrix)


def test_whole_change_sets(spark, matrix):
    ok = accepted_changes(fx.changes(spark, SF))
    before = matrix.grants().count()
    matrix.change(ok, lambda g: bulk_change(g, ok, "admin", WHEN)[0])
    assert matrix.grants().count() != before
    check(matrix)
    matrix.change(ok, lambda g: update_grants(g, ok, fx.users(spark, SF), "admin", WHEN)[0])
    check(matrix)
    raw = fx.import_rows(spark, SF)
    rows = csv_import(raw, fx.users(spark, SF), matrix.grants(), "admin", WHEN)["rows"]
    matrix.change(rows, lambda g: csv_import(raw, fx.users(spark, SF), g, "admin", WHEN)["grants"])
    check(matrix)


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_small_change_touches_its_buckets_only(spark, matrix):
    few = some(spark, 3).where(F.col("volume").isNotNull())
    named = B.buckets_named(few, 16)
    assert 0 < len(named) < 16
    tables = (matrix.grants_path, matrix.support_path)
    before = [files_of(t) for t in tables]
    assert matrix.change(few, lambda g: bulk_change(g, few, "admin", WHEN)[0]) == named
    for t, old in zip(tables, before):
        new = files_of(t)
        changed = {int(f.split("bucket=")[1].split("/")[0]) for f in set(old) ^ set(new)}
        assert changed == set(named)
    plan = matrix.grants(named)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN|PartitionFilters: \[[^\]]*bucket#\d+ = ", plan)
    check(matrix)


def test_repeated_change_and_lost_write(spark, matrix):
    few = some(spark, 40)
    step = lambda g: bulk_change(g, few, "admin", WHEN)[0]
    old = matrix.grants().toPandas()
    matrix.change(few, step)
    once = matrix.support().toPandas()
    matrix.change(few, step)
    check(matrix)
    # the run is lost after the support was written: grants are old, support is new
    B.replace_buckets(spark.createDataFrame(old, GRANTS), matrix.grants_path, list(range(16)), 16)
    matrix.change(few, step)
    check(matrix)
    key = M.STATE_KEY
    assert matrix.support().toPandas().sort_values(key).reset_index(drop=True).equals(once.sort_values(key).reset_index(drop=True))


def test_emptied_bucket_and_no_change(spark, matrix):
    gone = matrix.grants().where(F.col("principal_type") != "x")
    keys = gone.withColumn("principal_id", F.col("principal_id"))
    matrix.change(keys, lambda g: g.limit(0))
    assert matrix.grants().isEmpty() and matrix.support().isEmpty()
    assert matrix.change(fx.changes(spark, SF).limit(0), lambda g: g) == []


def test_delete_uncovers_the_weaker_grant(spark, tmpdir_path):
    vol = ("ws", "c", "s", "v")
    rows = [("USER", "u", *vol, "/a/", "DOWNLOAD", "x", None, "FOLDER"), ("USER", "u", *vol, "/", "READ", "x", None, "FOLDER_TREE"),
            ("USER", "u", *vol, "/a", "READ", "x", None, "FOLDER_TREE")]
    m = M.MaintainedMatrix(spark, tmpdir_path, 4)
    m.build(spark.createDataFrame(rows, GRANTS), spark.createDataFrame([(*vol, "/a/"), (*vol, "/b/")], M.FOLDERS))
    get = lambda: {(r.folder, r["rank"]): r.n for r in m.support().collect()}
    assert get() == {("/a/", 1): 1, ("/a/", 0): 2, ("/b/", 0): 1}
    keys = spark.createDataFrame([rows[0]], GRANTS)
    m.change(keys, lambda g: delete_grants(g, keys)[0])
    assert get() == {("/a/", 0): 2, ("/b/", 0): 1}
