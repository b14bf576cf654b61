"""Streamed session answers against the batch form: order, ties, late events, restarts."""

import datetime as dt
import os
import random
from zlib import crc32

import pytest

from permgrid.sources import fixtures as fx
from permgrid.streaming import sessions as S
from permgrid.streaming import sessions_stream as T

T0 = dt.datetime(2024, 5, 1)
DELAY, HOUR = "1 hour", dt.timedelta(hours=1)
REQ, MINT = "request_id long, user_id string, ts timestamp_ntz", "user_id string, minted_at timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def batch_form(spark, req, mints):
    return {tuple(r) for r in S.session_groups_asof(spark.createDataFrame(req, REQ), spark.createDataFrame(mints, MINT)).collect()}


@pytest.fixture()
def folders(tmpdir_path):
    return os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "out")


def test_batches_in_any_order_equal_the_batch_form(spark, folders):
    landing, out = folders
    rnd = random.Random(2)
    mints = [(f"u{rnd.randint(0, 3)}", at(rnd.randint(0, 600) / 2)) for _ in range(60)]
    req = [(i, f"u{rnd.randint(0, 4)}", at(rnd.randint(0, 600) / 2)) for i in range(120)]
    req += [(500 + i, u, t) for i, (u, t) in enumerate(mints[:10])]  # ties with a mint
    mints += mints[:5]  # tied mints
    req += [(900, None, at(10)), (901, None, at(200))]
    mints += [(None, at(9))]
    seen = set()
    def arrives(row, t):
        """Minute at which an event arrives: a third of them 20 minutes late."""
        return min((row[t] - T0).total_seconds() / 60 + (20 if crc32(str(row).encode()) % 3 == 0 else 0), 299)

    for low in range(0, 300, 50):
        part = lambda rows, t: [r for r in rows if low <= arrives(r, t) < low + 50]
        ev = T.session_events(spark.createDataFrame(part(req, 2), REQ), spark.createDataFrame(part(mints, 1), MINT))
        land(ev, landing)
        got = {tuple(r) for r in T.run_available(spark, landing, out, DELAY).collect()}  # every run starts anew from the checkpoint
        assert seen <= got
        seen = got
    assert len(seen) < len(req)
    land(T.closing_event(spark, at(320), HOUR), landing)
    got = [tuple(r) for r in T.run_available(spark, landing, out, DELAY).collect()]
    assert len(got) == len(req) and set(got) == batch_form(spark, req, mints)


def test_late_mints_and_requests(spark, folders):
    landing, out = folders
    first_req, first_mints = [(1, "u", at(100)), (2, "v", at(400))], [("u", at(50)), ("v", at(390))]
    land(T.session_events(spark.createDataFrame(first_req, REQ), spark.createDataFrame(first_mints, MINT)), landing)
    got = T.run_available(spark, landing, out, DELAY).collect()
    assert [(r.request_id, r.minted_at) for r in got] == [(1, at(50))]  # the watermark stands at 340
    # late: a mint that would have changed the answer, and a request; in time: a mint behind the other request
    late_req, late_mints = [(3, "u", at(120)), (4, "v", at(500))], [("u", at(99)), ("v", at(399))]
    land(T.session_events(spark.createDataFrame(late_req, REQ), spark.createDataFrame(late_mints, MINT)), landing)
    T.run_available(spark, landing, out, DELAY)
    land(T.closing_event(spark, at(500), HOUR), landing)
    answers = T.run_available(spark, landing, out, DELAY)
    assert sorted((r.request_id, r.minted_at) for r in answers.collect()) == [(1, at(50)), (2, at(399)), (4, at(399))]
    everyone = spark.createDataFrame(first_req + late_req, REQ)
    assert [r.request_id for r in T.unanswered(everyone, answers).collect()] == [3]


def test_equal_to_batch_over_the_fixture(spark, folders):
    landing, out = folders
    sf = "/root/testdata/sf0.001"
    req, mints = fx.requests(spark, sf), fx.mints(spark, sf)
    T.session_events(req, mints).write.parquet(landing)
    last = T.session_events(req, mints).agg({"ts": "max"}).first()[0]
    land(T.closing_event(spark, last, HOUR), landing)
    got, want = T.run_available(spark, landing, out, DELAY), S.session_groups_asof(req, mints)
    assert got.count() == req.count()
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_users_share_states(spark, folders):
    """States are one per bucket of users, not one per user, and answers stay those of each user."""
    landing, out = folders
    rnd = random.Random(5)
    mints = [(f"u{rnd.randint(0, 80)}", at(rnd.randint(0, 300))) for _ in range(150)] + [(None, at(5))]
    req = [(i, f"u{rnd.randint(0, 90)}", at(rnd.randint(0, 300))) for i in range(200)] + [(900, None, at(10)), (901, None, at(299))]
    land(T.session_events(spark.createDataFrame(req, REQ), spark.createDataFrame(mints, MINT)), landing)
    assert T.run_available(spark, landing, out, DELAY, buckets=4).count() < len(req)  # the others wait in the state
    assert 0 < spark.read.format("statestore").load(os.path.join(out, "_checkpoint")).count() <= 4
    land(T.closing_event(spark, at(300), HOUR), landing)
    got = [tuple(r) for r in T.run_available(spark, landing, out, DELAY, buckets=4).collect()]
    assert len(got) == len(req) and set(got) == batch_form(spark, req, mints)
