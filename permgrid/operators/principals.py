"""Principals: who a user acts as (their own id plus their groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.schemas import GROUP_PAYLOAD


def principal_table(user_ids: DataFrame, memberships: DataFrame) -> DataFrame:
    """Long table ``(user_id, principal_type, principal_id)``: one USER row per
    user id, one GROUP row per distinct membership.

    ``user_ids`` needs a ``user_id`` column (the users table, or the ids seen in
    requests: the reference matches USER grants on the session's own id whether
    or not a users row exists).
    """
    u = (user_ids.select("user_id").where(F.col("user_id").isNotNull()).distinct()
         .select("user_id", F.lit("USER").alias("principal_type"),
                 F.col("user_id").alias("principal_id")))
    g = (memberships.select("user_id", F.lit("GROUP").alias("principal_type"),
                            F.col("group_name").alias("principal_id"))
         .where(F.col("principal_id").isNotNull()).distinct())
    return u.unionByName(g)


def principal_filter(grants: DataFrame, principals: DataFrame) -> DataFrame:
    """Grants held by each user directly or through a group: an equi-join on
    (principal_type, principal_id); never an OR condition (that would plan as a
    nested-loop join).  Large groups are split into member buckets."""
    from permgrid.operators.skew import expand_to_users
    return expand_to_users(grants, principals)


def group_names(payload_col: str = "payload", cap: int | None = None) -> F.Column:
    """Group names of one directory answer: parse JSON (bad JSON -> no groups),
    keep non-empty names, de-duplicate keeping first order.  All names are kept unless
    the caller sets ``cap`` (see :func:`names_beyond`).  Row-local array work: no shuffle."""
    parsed = F.from_json(F.col(payload_col), GROUP_PAYLOAD, {"mode": "PERMISSIVE"})
    names = F.transform(F.coalesce(parsed["groups"], F.array().cast("array<struct<display:string>>")),
                        lambda g: g["display"])
    kept = F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != F.lit(""))))
    return kept if cap is None else F.slice(kept, 1, cap)


def names_beyond(cap: int, payload_col: str = "payload") -> F.Column:
    """How many distinct group names a cap leaves out of an answer."""
    return F.greatest(F.size(group_names(payload_col)) - F.lit(cap), F.lit(0))


def scan_memberships(payloads: DataFrame, cap: int | None = None) -> DataFrame:
    """Directory payloads ``(user_id, payload)`` -> memberships
    ``(user_id, group_name, position)``, position 1-based in payload order."""
    return (payloads.select("user_id", F.posexplode(group_names("payload", cap)).alias("pos", "group_name"))
            .select("user_id", "group_name", (F.col("pos") + 1).alias("position")))
