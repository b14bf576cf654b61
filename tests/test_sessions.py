"""As-of lookup against brute force; streaming decisions equal batch ones."""

import datetime as dt
import random

from permgrid.streaming.asof import asof_latest


def test_asof_matches_brute_force(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    ev = [(f"u{rng.randint(0, 3)}", t0 + dt.timedelta(minutes=rng.randint(0, 3000))) for _ in range(150)]
    pr = [(i, f"u{rng.randint(0, 4)}", t0 + dt.timedelta(minutes=rng.randint(0, 3000))) for i in range(300)]
    pr += [(1000 + i, k, t) for i, (k, t) in enumerate(ev[:20])]  # exact ties
    ev += [(None, t0), (None, t0 + dt.timedelta(hours=2))]  # a null key equals no key
    pr += [(2000, None, t0 + dt.timedelta(days=9)), (2001, None, t0)]
    e = spark.createDataFrame(ev, "k string, et timestamp_ntz")
    p = spark.createDataFrame(pr, "pid long, k string, pt timestamp_ntz")
    for inclusive in (True, False):
        got = {r.pid: r.latest for r in asof_latest(p, e, "k", "pt", "et", "pid", inclusive=inclusive).collect()}
        assert len(got) == len(pr)
        for pid, k, t in pr:
            c = [x for kk, x in ev if k is not None and kk == k and (x <= t if inclusive else x < t)]
            assert got[pid] == (max(c) if c else None), (pid, inclusive)


def test_stream_equals_batch(spark):
    from permgrid.plans.catalog import all_queries
    q = all_queries()
    sf = "/root/testdata/sf0.001"
    s = q["stream_authorise"](spark, sf)
    b = q["action_gate"](spark, sf).select("request_id", "action", "effective", "allowed")
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0


def test_repeats_late_requests_and_restarts(spark, tmpdir_path):
    """Batches with repeats and a late event, a new run per batch: every request in time is decided once."""
    from pyspark.sql import functions as F

    from permgrid.operators.authorise import action_gate
    from permgrid.sources import fixtures as fx
    from permgrid.streaming import authorise_stream as T
    sf, landing, out = "/root/testdata/sf0.001", tmpdir_path + "/landing", tmpdir_path + "/out"
    ev = fx.table(spark, sf, "events")
    assert T.read_decisions  # an empty run has an empty result, not an error
    spark.createDataFrame([], ev.schema).write.parquet(landing)
    run = lambda: T.start_authorise_stream(
        spark, landing, "*.parquet", ev.schema, fx.requests_from_events,
        lambda: (fx.memberships(spark, sf), fx.grants(spark, sf)), out, delay="2 days").awaitTermination()
    run()
    assert T.read_decisions(spark, out).count() == 0
    cut = ev.agg(F.min("ts") + F.expr("interval 5 days")).first()[0]
    early, late = ev.where(F.col("ts") < F.lit(cut)), ev.where(F.col("ts") >= F.lit(cut))
    held = early.where(F.col("event_type") != "signup").orderBy("ts").limit(3)  # arrive after everything else
    for part in (early.join(held, "event_id", "left_anti").select(*ev.columns), late, early.limit(5).unionByName(held)):
        part.unionByName(part.where(F.col("event_id") % 3 == 0)).write.mode("append").parquet(landing)
        run()
    got = T.read_decisions(spark, out)
    req = fx.requests(spark, sf)
    want = action_gate(req, fx.memberships(spark, sf), fx.grants(spark, sf)).join(held.select(F.col("event_id").alias("request_id")), "request_id", "left_anti")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and want.select(*got.columns).exceptAll(got).isEmpty()
    assert sorted(r.request_id for r in T.undecided(req, got).collect()) == sorted(r.event_id for r in held.collect())
