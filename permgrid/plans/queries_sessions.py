"""Registered queries: streaming decisions, session validity, removal exposure."""

from __future__ import annotations

import datetime as dt

from permgrid.plans.catalog import register
from permgrid.session import scratch_path
from permgrid.sources import fixtures as fx
from permgrid.streaming import sessions as S
from permgrid.streaming import sessions_stream as ST
from permgrid.streaming.authorise_stream import stream_authorise


@register("stream_authorise", """
select request_id, action, effective,
       coalesce(effective = 'DOWNLOAD' or (effective = 'READ' and action <> 'download'), false) as allowed
from decisions""")
def q_stream_authorise(spark, sf):
    return stream_authorise(spark, sf, scratch_path(spark, "stream_authorise"))


_SESSIONS = """
with a as (
  select r.request_id, r.user_id, r.ts,
         (select max(m.minted_at) from mints m where m.user_id = r.user_id and m.minted_at <= r.ts) as minted_at
  from requests r)
select *, date_trunc('second', minted_at) + interval 600 second as expires_at,
       coalesce(ts < date_trunc('second', minted_at) + interval 600 second, false) as session_valid
from a"""


@register("session_groups_asof", _SESSIONS)
def q_session_groups_asof(spark, sf):
    return S.session_groups_asof(fx.requests(spark, sf), fx.mints(spark, sf))


@register("session_groups_stream", _SESSIONS)
def q_session_groups_stream(spark, sf):
    """The same answers from a stream of mint and request events, closed by an event of no user."""
    root = scratch_path(spark, "session_stream")
    events = ST.session_events(fx.requests(spark, sf), fx.mints(spark, sf))
    last = events.agg({"ts": "max"}).first()[0]  # one time
    if last is not None:
        events = events.unionByName(ST.closing_event(spark, last, dt.timedelta(hours=1)))
    events.write.parquet(root + "/landing")
    return ST.run_available(spark, root + "/landing", root + "/out", "1 hour")


@register("removal_exposure", """
with a as (
  select r.removal_id, r.user_id, r.removed_at,
         (select max(m.minted_at) from mints m
           where m.user_id = r.user_id and m.minted_at < r.removed_at + interval 40 minute) as last_mint_at
  from removals r)
select *, case when last_mint_at is not null
               then greatest(removed_at, date_trunc('second', last_mint_at) + interval 600 second) end as access_until,
       case when last_mint_at is not null
            then (epoch_us(greatest(removed_at, date_trunc('second', last_mint_at) + interval 600 second))
                  - epoch_us(removed_at)) / 1e6 end as exposure_seconds
from a""")
def q_removal_exposure(spark, sf):
    return S.removal_exposure(fx.removals(spark, sf), fx.mints(spark, sf))
