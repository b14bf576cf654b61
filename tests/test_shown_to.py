"""Permitted requests are sent to the rows of their folders where they are few, and shuffled where not."""

import pytest

from permgrid.operators import files as FL
from permgrid.schemas import VOL_KEY

VOL = ("ws1", "cat1", "sch1", "vol1")
VK = ", ".join(f"{c} string" for c in VOL_KEY)


def _tables(spark):
    asked = [(1, "READ", "/a/"), (1, "READ", "/a/"), (None, "READ", "/a/"), (None, "READ", "/a/"), (2, "DOWNLOAD", "/a/"), (3, "READ", "/b/"),
             (4, "READ", None), (5, None, "/b/"), (6, "READ", "/none/")]
    requests = spark.createDataFrame([(i, e, *VOL, f) for i, e, f in asked], f"request_id long, effective string, {VK}, folder string")
    names = [("/a/", "x"), ("/a/", "x"), ("/a/", None), ("/b/", "y"), (None, "z"), ("/c/", "w")]
    rows = spark.createDataFrame([(*VOL, f, n) for f, n in names], f"{VK}, folder string, name string")
    want = [(i, e, n) for i, e, f in asked for g, n in names if f is not None and f == g]
    return requests, rows, want


@pytest.mark.parametrize("limit", [None, 3])
def test_rows_listed_and_shuffled(spark, monkeypatch, limit):
    """Repeated requests, requests without an id or a folder, and repeated entries keep their rows."""
    if limit is not None:
        monkeypatch.setattr(FL, "LISTED_REQUESTS", limit)
    requests, rows, want = _tables(spark)
    got = [tuple(r) for r in FL.shown_to(requests, rows).select("request_id", "effective", "name").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def _big(spark):
    requests, rows, _ = _tables(spark)
    return requests, rows.crossJoin(spark.range(1000).selectExpr("id as n")).repartition(4)


def test_entries_are_not_shuffled_to_meet_few_requests(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests, rows = _big(spark)
        plan = FL.shown_to(requests, rows)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        asked = FL.asked_folders(requests)
        plan = rows.join(asked, FL.F.xxhash64(*FL.FOLDER_KEY) == FL.F.col("asked"), "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_gated_preview_sends_requests_to_the_rows(spark):
    from permgrid.plans.catalog import all_queries
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = all_queries()["gated_preview"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "explode(ids" in plan
