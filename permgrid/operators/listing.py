"""Admin listings and login identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permgrid.session import saved

LISTING_ORDER = ["display_name", "workspace_id", "uc_catalog", "uc_schema", "volume", "folder_path"]


def grants_listing(grants: DataFrame, users: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Every grant with names.  LEFT users on (principal_type = 'USER' and
    id), INNER workspaces, LEFT users again on granted_by; fans out like the SQL
    when ids repeat.  The constant condition stays in the first join's ON."""
    p = grants.alias("p")
    u = users.select(F.col("user_id").alias("u_id"), F.col("display_name").alias("u_name"),
                     F.col("sso_email").alias("u_email")).alias("u")
    w = workspaces.select(F.col("workspace_id").alias("w_id"),
                          F.col("display_name").alias("workspace_name"))
    g = users.select(F.col("user_id").alias("g_id"), F.col("display_name").alias("g_name"))
    j = (p.join(u, (F.col("p.principal_type") == F.lit("USER")) & (F.col("p.principal_id") == F.col("u_id")), "left")
         .join(w, F.col("p.workspace_id") == F.col("w_id"))
         .join(g, F.col("p.granted_by") == F.col("g_id"), "left"))
    return j.select(
        "p.principal_type", "p.principal_id",
        F.coalesce("u_name", "p.principal_id").alias("display_name"),
        F.col("u_email").alias("sso_email"),
        "p.workspace_id", "workspace_name", "p.uc_catalog", "p.uc_schema", "p.volume",
        "p.folder_path", "p.permission", "p.scope",
        F.coalesce("g_name", "p.granted_by").alias("granted_by"), "p.granted_at")


def sorted_listing(listing: DataFrame) -> DataFrame:
    """The listing in the reference's order (a global, range-partitioned sort)."""
    return listing.orderBy(*LISTING_ORDER)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position`` (from 1) in the order of the columns ``order``.

    A range-partitioned sort numbers rows within its partitions; one count per partition gives the
    rows before it, so no task sees all rows."""
    part, at = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    rows = saved(df.orderBy(*order).select("*", part, at))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = (rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return rows.join(offset, "_part").withColumn("position", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def numbered_listing(listing: DataFrame) -> DataFrame:
    """The listing with its rows' positions in that order, ties by the other columns."""
    return numbered(listing, [*LISTING_ORDER, "principal_type", "principal_id", "sso_email", "workspace_name", "permission", "scope",
                              "granted_by", "granted_at"])


def identity_resolve(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Login e-mail -> (user_id, display_name, is_admin).  A users row with
    that e-mail wins (lowest user_id if several); otherwise the e-mail is the id,
    the preferred name (or the e-mail when empty) the name, and not admin."""
    known = (users.groupBy(F.col("sso_email").alias("email"))
             .agg(F.min_by(F.struct("user_id", "display_name", "is_admin"), F.col("user_id")).alias("u")))
    j = logins.join(known, "email", "left")
    fallback_name = F.coalesce(F.nullif(F.col("preferred_name"), F.lit("")), F.col("email"))
    return j.select(
        "email",
        F.coalesce(F.col("u.user_id"), F.col("email")).alias("user_id"),
        F.when(F.col("u").isNotNull(), F.col("u.display_name")).otherwise(fallback_name).alias("display_name"),
        F.coalesce(F.col("u.is_admin"), F.lit(False)).alias("is_admin"),
        F.col("u").isNotNull().alias("provisioned"))
