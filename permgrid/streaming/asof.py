"""As-of lookup: for each probe, the latest event of the same key at or
before (or strictly before) the probe time.

Spark has no as-of join.  Probes and events are unioned, ordered by
(time, kind) within the key, and the latest event time before each probe is
a running max (``operators.ranking.prefix_agg``) over hours of time, so a hot
key is spread over its hours.  Ties at equal time: inclusive orders events before
probes, exclusive probes before events.  A NULL key equals no key (as in SQL): its
probes get NULL and its events take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.operators.ranking import hour, prefix_agg


def asof_latest(probes: DataFrame, events: DataFrame, key: str, probe_time: str,
                event_time: str, probe_id: str, out: str = "latest", inclusive: bool = True) -> DataFrame:
    """``probes`` plus column ``out`` = max ``event_time`` of ``events`` with the
    same ``key`` and time <= (``inclusive``) or < the probe's ``probe_time``.
    ``probe_id`` must identify a probe row (it carries the answer back)."""
    ev_kind, pr_kind = (0, 1) if inclusive else (1, 0)
    pu = (probes.where(F.col(key).isNotNull() & F.col(probe_time).isNotNull())
          .select(F.col(key).alias("k"), F.col(probe_time).alias("t"), F.lit(pr_kind).alias("kind"),
                  F.lit(None).cast("timestamp_ntz").alias("et"), F.col(probe_id).cast("string").alias("pid")))
    eu = (events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
          .select(F.col(key).alias("k"), F.col(event_time).alias("t"), F.lit(ev_kind).alias("kind"),
                  F.col(event_time).cast("timestamp_ntz").alias("et"), F.lit(None).cast("string").alias("pid")))
    # rows of one (key, time, kind) have equal answers, so ties need no further order
    r = prefix_agg(pu.unionByName(eu), ["k"], ["t", "kind"], "et", "max", out="_latest", bucket=hour("t"))
    ans = r.where(F.col("pid").isNotNull()).select(F.col("pid").alias("__pid"), F.col("_latest").alias(out))
    return probes.join(ans, F.col(probe_id).cast("string") == F.col("__pid"), "left").drop("__pid")
