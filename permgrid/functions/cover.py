"""Column expressions for scopes, permissions and the cover test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_default(scope: Column | str = "scope") -> Column:
    """NULL or empty scope reads as FOLDER; other values are kept as they are."""
    c = F.col(scope) if isinstance(scope, str) else scope
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("FOLDER"))


def permission_rank(permission: Column | str = "permission") -> Column:
    """1 for DOWNLOAD (case-sensitive), 0 for anything else, NULL included."""
    c = F.col(permission) if isinstance(permission, str) else permission
    return F.when(c == F.lit("DOWNLOAD"), F.lit(1)).otherwise(F.lit(0))


def rank_to_permission(rank: Column | str) -> Column:
    c = F.col(rank) if isinstance(rank, str) else rank
    return F.when(c == 1, F.lit("DOWNLOAD")).when(c == 0, F.lit("READ"))


def scope_cover(scope: Column, grant_folder: Column, folder: Column) -> Column:
    """Row-level cover test: VOLUME always, FOLDER_TREE raw string prefix,
    anything else exact equality.  A NULL folder never matches (except VOLUME).

    Used as a residual only on small inputs and in tests; the set-at-a-time
    jobs turn it into an equi-join with :func:`grant_match_keys`.
    """
    s = scope_default(scope)
    return (F.when(s == "VOLUME", F.lit(True))
             .when(s == "FOLDER_TREE", F.coalesce(folder.startswith(grant_folder), F.lit(False)))
             .otherwise(F.coalesce(folder == grant_folder, F.lit(False))))


def grant_match_keys(scope: Column | str = "scope",
                     folder_path: Column | str = "folder_path") -> list[Column]:
    """Turn each grant into an equi-join key for the cover test.

    Returns ``(match_kind, match_key)``:

    * VOLUME           -> ('T', '')       every folder starts with ''
    * FOLDER_TREE on X -> ('T', X)        X covers F iff F starts with X (raw prefix semantics)
    * FOLDER on X      -> ('E', X)        exact folder
    A FOLDER or FOLDER_TREE grant with a NULL folder gets a NULL key (no match).
    The other side is ``paths.folder_probes``.
    """
    s = scope_default(F.col(scope) if isinstance(scope, str) else scope)
    x = F.col(folder_path) if isinstance(folder_path, str) else folder_path
    kind = F.when(s.isin("VOLUME", "FOLDER_TREE"), F.lit("T")).otherwise(F.lit("E"))
    key = F.when(s == "VOLUME", F.lit("")).otherwise(x)
    return [kind.alias("match_kind"), key.alias("match_key")]
