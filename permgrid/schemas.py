"""Declared schemas, key tuples and value domains.

Stored tables are read with these schemas; base tables carry theirs in Parquet footers.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

# --- fixed values that must equal the reference's behaviour -----------------
# Permission values; anything other than DOWNLOAD counts as READ when decided.
PERMISSIONS = ("READ", "DOWNLOAD")
# Scope values; NULL or empty scope reads as FOLDER, an unknown one acts as FOLDER.
SCOPES = ("VOLUME", "FOLDER_TREE", "FOLDER")
# Principal types; an empty type defaults to USER.
PRINCIPAL_TYPES = ("USER", "GROUP")
# Lifetime of a minted session (its cached group list), seconds.
TOKEN_TTL_SECONDS = 600
# Path prefix of a volume file: /Volumes/<catalog>/<schema>/<volume><folder><file>
VOLUME_ROOT = "/Volumes"
# ---------------------------------------------------------------------------

VOL_KEY = ["workspace_id", "uc_catalog", "uc_schema", "volume"]
GRANT_KEY = ["principal_type", "principal_id"] + VOL_KEY + ["folder_path"]

GRANTS = T.StructType([
    T.StructField("principal_type", S),
    T.StructField("principal_id", S),
    T.StructField("workspace_id", S),
    T.StructField("uc_catalog", S),
    T.StructField("uc_schema", S),
    T.StructField("volume", S),
    T.StructField("folder_path", S),
    T.StructField("permission", S),
    T.StructField("granted_by", S),
    T.StructField("granted_at", T.TimestampNTZType()),
    T.StructField("scope", S),
])
GRANT_COLUMNS = [f.name for f in GRANTS.fields]

USERS = T.StructType([
    T.StructField("user_id", S),
    T.StructField("display_name", S),
    T.StructField("sso_email", S),
    T.StructField("is_admin", T.BooleanType()),
])

WORKSPACES = T.StructType([
    T.StructField("workspace_id", S),
    T.StructField("display_name", S),
    T.StructField("host_url", S),
])

# Uploaded CSV: every column is text; optional columns may be missing.
CSV_REQUIRED = ["email", "display_name", "workspace_id", "uc_catalog", "uc_schema",
                "volume", "folder_path", "permission"]
CSV_OPTIONAL = ["scope", "principal_type", "principal_id", "group"]

# Group payload of the identity directory: {"groups": [{"display": ...}, ...]}
GROUP_PAYLOAD = T.StructType([
    T.StructField("groups", T.ArrayType(T.StructType([
        T.StructField("display", S)]))),
])
