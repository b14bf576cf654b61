"""Grant audits: rows that the listings hide or that break the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.schemas import GRANT_KEY, PERMISSIONS, PRINCIPAL_TYPES, SCOPES


def admin_ids(users: DataFrame) -> DataFrame:
    """Distinct user ids that are admins (any admin row for the id)."""
    return users.where(F.col("is_admin")).select("user_id").distinct()


def orphan_grants(grants: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Grants whose workspace has no workspace row."""
    return grants.join(workspaces.select("workspace_id"), "workspace_id", "left_anti")


def unreachable_grants(grants: DataFrame, users: DataFrame) -> DataFrame:
    """USER grants keyed by something that is no user_id but is the e-mail of
    a user (whose sessions carry the user_id, so the grant never matches)."""
    ids = users.select(F.col("user_id").alias("principal_id")).distinct()
    emails = users.select(F.col("sso_email").alias("principal_id")).distinct()
    u = grants.where(F.col("principal_type") == "USER")
    return u.join(ids, "principal_id", "left_anti").join(emails, "principal_id", "left_semi")


def volume_scope_violations(grants: DataFrame, users: DataFrame) -> DataFrame:
    """VOLUME grants held by a group or by a user who is not an admin."""
    adm = admin_ids(users).select(F.col("user_id").alias("principal_id"), F.lit(True).alias("_admin"))
    v = grants.where(F.col("scope") == "VOLUME").join(adm, "principal_id", "left")
    reason = (F.when(F.col("principal_type") != "USER", F.lit("group"))
               .when(F.col("_admin").isNull(), F.lit("non_admin")))
    return v.withColumn("violation", reason).where(F.col("violation").isNotNull()).drop("_admin")


def duplicate_grants(grants: DataFrame) -> DataFrame:
    """Grant keys held by more than one row."""
    return (grants.groupBy(*GRANT_KEY).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def unknown_values(grants: DataFrame) -> DataFrame:
    """Per checked column, the values outside its domain and their row counts
    (NULL or '' scope is valid: it reads as FOLDER)."""
    checks = [("permission", PERMISSIONS, False), ("scope", SCOPES, True),
              ("principal_type", PRINCIPAL_TYPES, False)]
    parts = []
    for col, domain, blank_ok in checks:
        v = F.col(col)
        known = v.isin(*domain)
        if blank_ok:
            known = known | v.isNull() | (v == "")
        parts.append(grants.where(~F.coalesce(known, F.lit(False)))
                     .select(F.lit(col).alias("column_name"), v.alias("value")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def no_access_users(users: DataFrame, visible: DataFrame) -> DataFrame:
    """Users (admins too) without any visible workspace."""
    return users.join(visible.select("user_id").distinct(), "user_id", "left_anti")
