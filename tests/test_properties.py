"""Properties from the test strategy: the folder-level matrix agrees with
per-request decisions, decisions grow monotonically with grants, and a bulk
change is idempotent on its keys."""

from pyspark.sql import functions as F

from permgrid.operators.authorise import effective_permission
from permgrid.operators.changes import accepted_changes, bulk_change
from permgrid.plans.entitlement import inventory_folders, user_folder_ranks
from permgrid.schemas import GRANT_COLUMNS, VOL_KEY
from permgrid.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
FK = [*VOL_KEY, "folder"]


def rank():
    return F.when(F.col("effective") == "DOWNLOAD", 2).when(F.col("effective") == "READ", 1).otherwise(0)


def test_matrix_equals_per_request_decisions(spark):
    req, mem, gr = fx.requests(spark, SF), fx.memberships(spark, SF), fx.grants(spark, SF)
    folders = inventory_folders(fx.files(spark, SF))
    d = effective_permission(req.join(folders, FK, "left_semi"), mem, gr)
    uf = user_folder_ranks(folders, fx.principals(spark, SF), gr)
    j = d.join(uf, ["user_id", *FK], "left").select(
        "request_id", rank().alias("a"), F.coalesce(F.col("rank") + 1, F.lit(0)).alias("b"))
    assert j.count() > 0
    assert j.where(F.col("a") != F.col("b")).count() == 0


def test_more_grants_never_lower_a_decision(spark):
    req, mem, gr = fx.requests(spark, SF), fx.memberships(spark, SF), fx.grants(spark, SF)
    extra = bulk_change(gr.limit(0), accepted_changes(fx.changes(spark, SF)), "admin", "2026-01-01 00:00:00")[0]
    before = effective_permission(req, mem, gr).select("request_id", rank().alias("r1"))
    after = effective_permission(req, mem, gr.unionByName(extra)).select("request_id", rank().alias("r2"))
    j = before.join(after, "request_id")
    assert j.count() == req.count()
    assert j.where(F.col("r2") < F.col("r1")).count() == 0
    assert j.where(F.col("r2") > F.col("r1")).count() > 0


def test_bulk_change_idempotent(spark):
    gr, ch = fx.grants(spark, SF), accepted_changes(fx.changes(spark, SF))
    once = bulk_change(gr, ch, "admin", "2026-01-01 00:00:00")[0]
    twice = bulk_change(once, ch, "admin", "2026-01-01 00:00:00")[0]
    a, b = once.select(*GRANT_COLUMNS), twice.select(*GRANT_COLUMNS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
