"""Timestamp expressions for grant writes and session validity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from permgrid.schemas import TOKEN_TTL_SECONDS


def now_stamp(as_of: dt.datetime | str | None = None) -> Column:
    """Write time of a grant change: ``as_of`` when given (tests, replays),
    otherwise the query's current local timestamp (session zone, no zone)."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(str(as_of)).cast("timestamp_ntz")


def seconds(n: int | Column) -> Column:
    return F.make_dt_interval(secs=n if isinstance(n, Column) else F.lit(n))


def token_expiry(minted_at: Column | str, ttl_seconds: int = TOKEN_TTL_SECONDS) -> Column:
    """A token is minted with whole-second expiry: trunc(mint) + TTL."""
    m = F.col(minted_at) if isinstance(minted_at, str) else minted_at
    # date_trunc yields a zoned timestamp; keep the wall-clock type of the input
    return F.date_trunc("second", m).cast("timestamp_ntz") + seconds(ttl_seconds)
