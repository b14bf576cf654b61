"""Grant and workspace changes as snapshot-to-snapshot transforms.

Every operator takes the current snapshot and a DataFrame of change requests
and returns the next snapshot (plus, where useful, the rejected requests).
Deletes are equi anti-joins on the grant key (never a huge OR of keys);
inserts are ``unionByName``.  Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permgrid.functions.text import has_quote, py_strip
from permgrid.functions.time import now_stamp
from permgrid.operators.audit import admin_ids
from permgrid.schemas import GRANT_COLUMNS, GRANT_KEY, PRINCIPAL_TYPES, SCOPES, VOL_KEY


def norm_principal_type(c: Column | str = "principal_type") -> Column:
    """``(type or 'USER').upper()``: NULL or '' -> USER."""
    x = F.col(c) if isinstance(c, str) else c
    return F.upper(F.coalesce(F.nullif(x, F.lit("")), F.lit("USER")))


def norm_scope(c: Column | str = "scope") -> Column:
    """``(scope or 'FOLDER').upper()``: NULL or '' -> FOLDER."""
    x = F.col(c) if isinstance(c, str) else c
    return F.upper(F.coalesce(F.nullif(x, F.lit("")), F.lit("FOLDER")))


def with_admin_flag(df: DataFrame, users: DataFrame, id_col: str = "principal_id") -> DataFrame:
    """Add ``grantee_is_admin`` (the id has an admin users row)."""
    adm = admin_ids(users).select(F.col("user_id").alias("_adm_id"), F.lit(True).alias("_adm"))
    j = df.join(adm, F.col(id_col) == F.col("_adm_id"), "left")
    return j.withColumn("grantee_is_admin", F.coalesce("_adm", F.lit(False))).drop("_adm_id", "_adm")


# Rejection reasons, in the order the reference checks them.
REASONS = ("quote_in_field", "bad_principal_type", "quote_in_principal", "bad_scope",
           "volume_for_group", "volume_for_non_admin")
# Fields that a request must carry; NULL is missing, and so is a blank one when asked for.
REQUIRED = ("principal_id", *VOL_KEY, "folder_path", "permission")


def missing_field(blank_too: bool = False, columns: tuple[str, ...] = REQUIRED) -> Column:
    """True when a required field is NULL (or blank, with ``blank_too``)."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
        if blank_too:
            out = out | (py_strip(c) == "")
    return F.coalesce(out, F.lit(True))


def key_rejection() -> Column:
    """First failing rule of a delete or bulk change: a missing key field, an unknown
    principal type, or a quote in the principal; NULL when accepted."""
    keys = tuple(c for c in REQUIRED if c != "permission")
    return (F.when(missing_field(columns=keys), F.lit("missing_field"))
             .when(~norm_principal_type().isin(*PRINCIPAL_TYPES), F.lit(REASONS[1]))
             .when(has_quote("principal_id"), F.lit(REASONS[2])))


def accepted_changes(changes: DataFrame) -> DataFrame:
    """The changes that :func:`key_rejection` lets pass."""
    return changes.where(key_rejection().isNull())


def grant_rejection(check_fields: bool = True) -> Column:
    """First failing rule of an add (``check_fields``) or update request, NULL
    when accepted.  Needs ``grantee_is_admin`` (see :func:`with_admin_flag`)."""
    pt = norm_principal_type()
    sc = norm_scope()
    rules: list[tuple[Column, str]] = [(missing_field(blank_too=check_fields), "missing_field")]
    if check_fields:
        rules.append((has_quote("uc_catalog") | has_quote("uc_schema") | has_quote("volume")
                      | has_quote("folder_path"), REASONS[0]))
    rules += [
        (~pt.isin(*PRINCIPAL_TYPES), REASONS[1]),
        (has_quote("principal_id"), REASONS[2]),
        (~sc.isin(*SCOPES), REASONS[3]),
        ((sc == "VOLUME") & (pt != "USER"), REASONS[4]),
        ((sc == "VOLUME") & ~F.col("grantee_is_admin"), REASONS[5]),
    ]
    out = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def validate_grants(requests: DataFrame, users: DataFrame, check_fields: bool = True) -> DataFrame:
    """Adds ``reason`` (NULL = accepted) to grant add/update requests."""
    return (with_admin_flag(requests, users, "principal_id")
            .withColumn("reason", grant_rejection(check_fields)))


def add_grants(grants: DataFrame, requests: DataFrame, users: DataFrame, granter: str,
               as_of=None) -> tuple[DataFrame, DataFrame]:
    """Validate, then append accepted requests (no de-duplication).
    Returns (next snapshot, rejected requests with reason)."""
    v = validate_grants(requests, users)
    ok = v.where(F.col("reason").isNull()).select(
        norm_principal_type().alias("principal_type"), "principal_id", *VOL_KEY, "folder_path",
        "permission", F.lit(granter).alias("granted_by"), now_stamp(as_of).alias("granted_at"),
        norm_scope().alias("scope"))
    return grants.unionByName(ok.select(*GRANT_COLUMNS)), v.where(F.col("reason").isNotNull())


def _norm_keys(changes: DataFrame) -> DataFrame:
    return changes.withColumn("principal_type", norm_principal_type())


def delete_grants(grants: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove every row matching an accepted key (SQL equality: NULL never matches).
    Returns (next snapshot, rejected keys with reason)."""
    k = _norm_keys(accepted_changes(keys)).select(*GRANT_KEY).distinct()
    rejected = keys.withColumn("reason", key_rejection()).where(F.col("reason").isNotNull())
    return grants.join(k, GRANT_KEY, "left_anti"), rejected


def update_grants(grants: DataFrame, changes: DataFrame, users: DataFrame, granter: str,
                  as_of=None, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """For rows matching a change's key set permission, scope, granted_by,
    granted_at.  Changes apply in ``order_col`` order, so for a repeated key the
    last accepted change wins.  Returns (next snapshot, rejected changes)."""
    v = validate_grants(_norm_keys(changes), users, check_fields=False)
    ok = v.where(F.col("reason").isNull())
    last = (ok.groupBy(*GRANT_KEY)
            .agg(F.max_by(F.struct(F.col("permission").alias("new_permission"),
                                   norm_scope().alias("new_scope")), F.col(order_col)).alias("c"))
            .select(*GRANT_KEY, "c.new_permission", "c.new_scope", F.lit(True).alias("_hit")))
    j = grants.join(last, GRANT_KEY, "left")
    hit = F.col("_hit").isNotNull()
    out = j.select(
        *[F.col(c) for c in GRANT_KEY],
        F.when(hit, F.col("new_permission")).otherwise(F.col("permission")).alias("permission"),
        F.when(hit, F.lit(granter)).otherwise(F.col("granted_by")).alias("granted_by"),
        F.when(hit, now_stamp(as_of)).otherwise(F.col("granted_at")).alias("granted_at"),
        F.when(hit, F.col("new_scope")).otherwise(F.col("scope")).alias("scope"))
    return out.select(*GRANT_COLUMNS), v.where(F.col("reason").isNotNull())


class RejectedChange(ValueError):
    """A bulk change holds a request that must not pass; nothing of it is applied."""


def bulk_change(grants: DataFrame, changes: DataFrame, granter: str, as_of=None) -> tuple[DataFrame, DataFrame]:
    """B1: delete every key named by a change, then insert the changes that carry
    a non-empty permission, with scope FOLDER (duplicates inserted as given).

    Returns (next snapshot, one row with ``applied``, the number of changes).  One
    change with a quote in its principal fails the whole call; a type is taken as given
    (upper-cased, empty means USER).  Filter with :func:`accepted_changes` to apply the rest."""
    bad = changes.where(has_quote("principal_id")).limit(1).count()
    if bad:
        raise RejectedChange("a principal of the bulk change contains a quote; nothing was applied")
    c = _norm_keys(changes)
    kept = grants.join(c.select(*GRANT_KEY).distinct(), GRANT_KEY, "left_anti")
    add = c.where(F.coalesce(F.col("permission") != "", F.lit(False))).select(
        *GRANT_KEY, "permission", F.lit(granter).alias("granted_by"),
        now_stamp(as_of).alias("granted_at"), F.lit("FOLDER").alias("scope"))
    return kept.unionByName(add.select(*GRANT_COLUMNS)), changes.agg(F.count(F.lit(1)).alias("applied"))


def workspace_rejection() -> Column:
    wid = py_strip("workspace_id")
    return (F.when(has_quote("workspace_id") | has_quote("display_name") | has_quote("host_url"),
                   F.lit("quote_in_field"))
             .when(F.coalesce(wid == "", F.lit(True)), F.lit("missing_id")))


def add_workspaces(workspaces: DataFrame, candidates: DataFrame, order_col: str = "seq"
                   ) -> tuple[DataFrame, DataFrame]:
    """B3 (with J4): validate, reject ids that exist, and within the batch keep
    the first request per id (the batch stands for sequential calls).
    Returns (next workspaces, decisions per candidate with reason)."""
    v = (candidates.withColumn("workspace_id", F.when(workspace_rejection().isNull(), py_strip("workspace_id"))
                               .otherwise(F.col("workspace_id")))
         .withColumn("reason", workspace_rejection()))
    existing = workspaces.select("workspace_id").distinct().withColumn("_exists", F.lit(True))
    v = v.join(existing, "workspace_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_exists"), F.lit("exists")))).drop("_exists")
    first = (v.where(F.col("reason").isNull()).groupBy("workspace_id")
             .agg(F.min(order_col).alias("_first")))
    v = (v.join(first, "workspace_id", "left")
         .withColumn("reason", F.coalesce("reason", F.when(F.col(order_col) != F.col("_first"),
                                                           F.lit("exists"))))
         .drop("_first"))
    new = v.where(F.col("reason").isNull()).select("workspace_id", "display_name", "host_url")
    return workspaces.unionByName(new), v


def seed_users(users: DataFrame, admins: DataFrame) -> DataFrame:
    """Insert-if-absent by e-mail for a batch of admins ``(email, name)``: both are stripped,
    a blank e-mail is skipped, a blank name becomes the e-mail; the id is the e-mail's slug
    without collision suffix."""
    from permgrid.functions.text import user_slug
    batch = admins.select(py_strip("email").alias("email"), F.nullif(py_strip("name"), F.lit("")).alias("name"))
    new = (batch.where(F.col("email") != "")
           .join(users.select(F.col("sso_email").alias("email")), "email", "left_anti")
           .groupBy("email").agg(F.min("name").alias("name")))
    rows = new.select(user_slug("email").alias("user_id"), F.coalesce("name", "email").alias("display_name"),
                      F.col("email").alias("sso_email"), F.lit(True).alias("is_admin"))
    return users.unionByName(rows)
