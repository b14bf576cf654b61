"""Session validity (T2) and group-removal exposure.

A session token caches the user's groups until it expires: expiry is the
whole-second mint time plus the TTL.  A removed group therefore keeps working
for sessions minted before the directory reflects the removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.functions.time import seconds, token_expiry
from permgrid.schemas import TOKEN_TTL_SECONDS
from permgrid.streaming.asof import asof_latest

# Up to this long the identity directory may still list a removed group.
SYNC_DELAY_SECONDS = 40 * 60


def session_groups_asof(requests: DataFrame, mints: DataFrame,
                        ttl_seconds: int = TOKEN_TTL_SECONDS) -> DataFrame:
    """Per request, the user's latest mint at or before the request, its
    expiry, and whether the request falls inside it (``ts < expiry``)."""
    r = asof_latest(requests.select("request_id", "user_id", "ts"), mints.select("user_id", "minted_at"),
                    "user_id", "ts", "minted_at", "request_id", out="minted_at", inclusive=True)
    exp = token_expiry("minted_at", ttl_seconds)
    return r.select("request_id", "user_id", "ts", "minted_at", exp.alias("expires_at"),
                    F.coalesce(F.col("ts") < exp, F.lit(False)).alias("session_valid"))


def removal_exposure(removals: DataFrame, mints: DataFrame, ttl_seconds: int = TOKEN_TTL_SECONDS,
                     sync_delay_seconds: int = SYNC_DELAY_SECONDS) -> DataFrame:
    """Per removal, the last mint that could still carry the group (minted
    before removal + sync delay) and the instant its token expires; access
    ends at the later of that and the removal.  No such mint: no exposure."""
    probe = removals.withColumn("_horizon", F.col("removed_at") + seconds(sync_delay_seconds))
    r = asof_latest(probe.select("removal_id", "user_id", "removed_at", "_horizon"),
                    mints.select("user_id", "minted_at"), "user_id", "_horizon", "minted_at",
                    "removal_id", out="last_mint_at", inclusive=False)
    end = F.greatest(F.col("removed_at"), token_expiry("last_mint_at", ttl_seconds))
    return r.select("removal_id", "user_id", "removed_at", "last_mint_at",
                    F.when(F.col("last_mint_at").isNotNull(), end).alias("access_until"),
                    F.when(F.col("last_mint_at").isNotNull(),
                           (F.unix_micros(end.cast("timestamp"))
                            - F.unix_micros(F.col("removed_at").cast("timestamp"))) / F.lit(1e6))
                    .alias("exposure_seconds"))
