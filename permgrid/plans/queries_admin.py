"""Registered queries: listings, visibility, audits, changes and import."""

from __future__ import annotations

from pyspark.sql import functions as F

from permgrid.operators import audit as X
from permgrid.operators import changes as C
from permgrid.operators import importer as I
from permgrid.operators import listing as L
from permgrid.operators import visibility as V
from permgrid.plans.catalog import register
from permgrid.plans.oracle import AS_OF
from permgrid.schemas import GRANTS, USERS, VOL_KEY, WORKSPACES
from permgrid.sources import fixtures as fx
from permgrid.sources import tables as TB

VK = ", ".join(VOL_KEY)
GK = "principal_type, principal_id, workspace_id, uc_catalog, uc_schema, volume, folder_path"
GRANTER = "user_0_x"
SELECTION = {"workspace_name": "NATION_7", "permission": "DOWNLOAD"}


def _key_eq(a: str, b: str) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in GK.split(", "))


# --- scans ---------------------------------------------------------------------

@register("scan_grants", "select * from grants")
def q_scan_grants(spark, sf):
    return TB.conform(fx.grants(spark, sf), GRANTS)


@register("scan_users", "select * from users")
def q_scan_users(spark, sf):
    return TB.conform(fx.users(spark, sf), USERS)


@register("scan_workspaces", "select * from workspaces order by display_name")
def q_scan_workspaces(spark, sf):
    return TB.conform(fx.workspaces(spark, sf), WORKSPACES).orderBy("display_name")


@register("volume_filter", f"""
select * from grants where ({VK}) in (select ({VK}) from requests)""")
def q_volume_filter(spark, sf):
    vols = fx.requests(spark, sf).select(*VOL_KEY).distinct()
    return fx.grants(spark, sf).join(vols, VOL_KEY, "left_semi")


@register("scope_default", """
select *, coalesce(nullif(scope, ''), 'FOLDER') as effective_scope from grants""")
def q_scope_default(spark, sf):
    from permgrid.functions.cover import scope_default
    return fx.grants(spark, sf).withColumn("effective_scope", scope_default("scope"))


# --- visibility ----------------------------------------------------------------

@register("visible_workspaces", "select * from user_ws")
def q_visible_workspaces(spark, sf):
    return V.visible_workspaces(fx.principals(spark, sf), fx.grants(spark, sf), fx.workspaces(spark, sf))


@register("volumes_with_folders", f"""
select p.user_id, {", ".join("g." + c for c in VOL_KEY)}, g.folder_path, g.permission,
       coalesce(nullif(g.scope, ''), 'FOLDER') as scope,
       case when coalesce(nullif(g.scope, ''), 'FOLDER') = 'VOLUME' then '/' else g.folder_path end as entry_folder
from principals p join grants g on g.principal_type = p.principal_type and g.principal_id = p.principal_id""")
def q_volumes_with_folders(spark, sf):
    return V.volumes_with_folders(fx.principals(spark, sf), fx.grants(spark, sf))


@register("folders_granted", f"""
select p.user_id, {", ".join("g." + c for c in VOL_KEY)}, count(*) as folders
from principals p join grants g on g.principal_type = p.principal_type and g.principal_id = p.principal_id
group by all""")
def q_folders_granted(spark, sf):
    return V.folders_granted(fx.principals(spark, sf), fx.grants(spark, sf))


def _listing(spark, sf):
    return L.grants_listing(fx.grants(spark, sf), fx.users(spark, sf), fx.workspaces(spark, sf))


@register("grants_listing", "select * from listing")
def q_grants_listing(spark, sf):
    return _listing(spark, sf)


_BY = "display_name, workspace_id, uc_catalog, uc_schema, volume, folder_path"
_REST = "principal_type, principal_id, sso_email, workspace_name, permission, scope, granted_by, granted_at"


@register("sorted_listings", f"""
select *, row_number() over (order by {", ".join(c + " nulls first" for c in (_BY + ", " + _REST).split(", "))}) as position
from listing""")
def q_sorted_listings(spark, sf):
    """The listing with every row's place in the reference's order."""
    return L.numbered_listing(_listing(spark, sf))


@register("facet_values", """
select facet, value, row_number() over (order by facet, value nulls first) as position
from (select distinct facet, value from (
  select 'display_name' as facet, display_name as value from listing
  union all select 'workspace_name', workspace_name from listing
  union all select 'uc_catalog', uc_catalog from listing
  union all select 'volume', volume from listing))""")
def q_facet_values(spark, sf):
    """The values of each facet with their places in the sorted list."""
    return L.numbered(V.facet_values(_listing(spark, sf)), ["facet", "value"])


@register("facet_filter", """
select * from listing where workspace_name = 'NATION_7' and permission = 'DOWNLOAD'""")
def q_facet_filter(spark, sf):
    return V.facet_filter(_listing(spark, sf), SELECTION)


@register("facet_counts", """
select count(*) filter (where workspace_name = 'NATION_7' and permission = 'DOWNLOAD') as matched,
       count(*) as total
from listing""")
def q_facet_counts(spark, sf):
    return V.facet_counts(_listing(spark, sf), SELECTION)


_ANY = " and ".join(f"(coalesce(s.{c}, '') = '' or l.{c} = s.{c})" for c in V.FILTERS)


@register("facet_counts_many", f"""
with kept as (select display_name, workspace_name, uc_catalog, volume, permission, count(*) as n from listing group by all)
select s.selection_id, cast(coalesce(sum(l.n), 0) as bigint) as matched, (select count(*) from listing) as total
from facet_selections s left join kept l on {_ANY}
group by s.selection_id""")
def q_facet_counts_many(spark, sf):
    """How many listing rows each of many filter requests leaves, over every subset of the five filters."""
    return V.facet_counts_many(_listing(spark, sf), fx.facet_selections(spark, sf))


@register("identity_resolve", """
select l.email, coalesce(k.user_id, l.email) as user_id,
       case when k.user_id is not null then k.display_name
            else coalesce(nullif(l.preferred_name, ''), l.email) end as display_name,
       coalesce(k.is_admin, false) as is_admin, k.user_id is not null as provisioned
from logins l left join (
  select sso_email as email, min(user_id) as user_id, arg_min(display_name, user_id) as display_name,
         arg_min(is_admin, user_id) as is_admin
  from users group by sso_email) k on k.email = l.email""")
def q_identity_resolve(spark, sf):
    return L.identity_resolve(fx.logins(spark, sf), fx.users(spark, sf))


# --- audits --------------------------------------------------------------------

@register("orphan_grants", """
select * from grants g where not exists (select 1 from workspaces w where w.workspace_id = g.workspace_id)""")
def q_orphan_grants(spark, sf):
    return X.orphan_grants(fx.grants(spark, sf), fx.workspaces(spark, sf))


@register("unreachable_grants", """
select * from grants g where principal_type = 'USER'
  and not exists (select 1 from users u where u.user_id = g.principal_id)
  and exists (select 1 from users u where u.sso_email = g.principal_id)""")
def q_unreachable_grants(spark, sf):
    return X.unreachable_grants(fx.grants(spark, sf), fx.users(spark, sf))


@register("volume_scope_violations", """
select g.*, case when g.principal_type <> 'USER' then 'group' else 'non_admin' end as violation
from grants g left join admin_ids a on a.user_id = g.principal_id
where g.scope = 'VOLUME' and (g.principal_type <> 'USER' or a.user_id is null)""")
def q_volume_scope_violations(spark, sf):
    return X.volume_scope_violations(fx.grants(spark, sf), fx.users(spark, sf))


@register("duplicate_grants", f"""
select {GK}, count(*) as n_rows from grants group by all having count(*) > 1""")
def q_duplicate_grants(spark, sf):
    return X.duplicate_grants(fx.grants(spark, sf))


@register("unknown_values", """
select 'permission' as column_name, permission as value, count(*) as n_rows from grants
where permission not in ('READ', 'DOWNLOAD') group by 1, 2
union all
select 'scope', scope, count(*) from grants where coalesce(scope, '') not in ('VOLUME', 'FOLDER_TREE', 'FOLDER', '') group by 1, 2
union all
select 'principal_type', principal_type, count(*) from grants where principal_type not in ('USER', 'GROUP') group by 1, 2""")
def q_unknown_values(spark, sf):
    return X.unknown_values(fx.grants(spark, sf))


@register("no_access_users", """
select * from users u where not exists (select 1 from user_ws v where v.user_id = u.user_id)""")
def q_no_access_users(spark, sf):
    p, g = fx.principals(spark, sf), fx.grants(spark, sf)
    vis = V.visible_workspaces(p, g, fx.workspaces(spark, sf))
    return X.no_access_users(fx.users(spark, sf), vis)


# --- changes -------------------------------------------------------------------

_REASON_SQL = """
case when c.permission is null or c.principal_id is null{blank} then 'missing_field'
     when {fields} then 'quote_in_field'
     when upper(coalesce(nullif(c.principal_type, ''), 'USER')) not in ('USER', 'GROUP') then 'bad_principal_type'
     when coalesce(contains(c.principal_id, chr(39)), false) then 'quote_in_principal'
     when upper(coalesce(nullif(c.scope, ''), 'FOLDER')) not in ('VOLUME', 'FOLDER_TREE', 'FOLDER') then 'bad_scope'
     when upper(coalesce(nullif(c.scope, ''), 'FOLDER')) = 'VOLUME'
          and upper(coalesce(nullif(c.principal_type, ''), 'USER')) <> 'USER' then 'volume_for_group'
     when upper(coalesce(nullif(c.scope, ''), 'FOLDER')) = 'VOLUME' and a.user_id is null then 'volume_for_non_admin'
end"""
_BLANK_SQL = " or trim(c.principal_id) = '' or trim(c.permission) = ''"
_FIELDS_SQL = " or ".join(f"coalesce(contains(c.{f}, chr(39)), false)"
                          for f in ("uc_catalog", "uc_schema", "volume", "folder_path"))


@register("validate_grant", f"""
select c.seq, {_REASON_SQL.format(fields=_FIELDS_SQL, blank=_BLANK_SQL)} as reason
from changes c left join admin_ids a on a.user_id = c.principal_id""")
def q_validate_grant(spark, sf):
    v = C.validate_grants(fx.changes(spark, sf), fx.users(spark, sf))
    return v.select("seq", "reason")


@register("is_admin_check", """
select distinct g.principal_id, a.user_id is not null as grantee_is_admin
from grants g left join admin_ids a on a.user_id = g.principal_id where g.principal_type = 'USER'""")
def q_is_admin_check(spark, sf):
    ids = fx.grants(spark, sf).where(F.col("principal_type") == "USER").select("principal_id").distinct()
    return C.with_admin_flag(ids, fx.users(spark, sf))


@register("add_grant", f"""
select * from grants
union all
select upper(coalesce(nullif(c.principal_type, ''), 'USER')), c.principal_id, {", ".join("c." + x for x in VOL_KEY)},
       c.folder_path, c.permission, '{GRANTER}', timestamp '{AS_OF}', upper(coalesce(nullif(c.scope, ''), 'FOLDER'))
from changes c left join admin_ids a on a.user_id = c.principal_id
where ({_REASON_SQL.format(fields=_FIELDS_SQL, blank=_BLANK_SQL)}) is null""")
def q_add_grant(spark, sf):
    nxt, _ = C.add_grants(fx.grants(spark, sf), fx.changes(spark, sf), fx.users(spark, sf),
                          GRANTER, AS_OF)
    return nxt


@register("append_rows", f"""
select * from grants
union all
select principal_type, principal_id, {VK}, folder_path, permission, '{GRANTER}', timestamp '{AS_OF}', 'FOLDER'
from changes_n where coalesce(permission <> '', false)""")
def q_append_rows(spark, sf):
    """Append the bulk-insert rows to a grants table on storage (by name), then
    read the table back with its declared schema."""
    from permgrid.session import scratch_path
    path = scratch_path(spark, "append_rows")
    TB.append_rows(TB.conform(fx.grants(spark, sf), GRANTS), path)
    c = fx.changes(spark, sf).withColumn("principal_type", C.norm_principal_type())
    rows = c.where(F.coalesce(F.col("permission") != "", F.lit(False))).select(
        "principal_type", "principal_id", *VOL_KEY, "folder_path", "permission",
        F.lit(GRANTER).alias("granted_by"), F.lit(AS_OF).cast("timestamp_ntz").alias("granted_at"),
        F.lit("FOLDER").alias("scope"))
    TB.append_rows(rows, path)
    return TB.read_table(spark, path, GRANTS)


@register("delete_grants", f"""
select * from grants g where not exists (select 1 from bulk_ok c where {_key_eq('c', 'g')})""")
def q_delete_grants(spark, sf):
    return C.delete_grants(fx.grants(spark, sf), fx.changes(spark, sf))[0]


@register("rejected_deletes", """
select seq, case when principal_id is null then 'missing_field'
                 when upper(coalesce(nullif(principal_type, ''), 'USER')) not in ('USER', 'GROUP') then 'bad_principal_type'
                 else 'quote_in_principal' end as reason
from changes where seq not in (select seq from bulk_ok)""")
def q_rejected_deletes(spark, sf):
    return C.delete_grants(fx.grants(spark, sf), fx.changes(spark, sf))[1].select("seq", "reason")


@register("update_grants", f"""
with v as (
  select c.*, {_REASON_SQL.format(fields='false', blank='')} as reason
  from changes_n c left join admin_ids a on a.user_id = c.principal_id),
last as (
  select {GK}, arg_max(permission, seq) as new_permission,
         arg_max(upper(coalesce(nullif(scope, ''), 'FOLDER')), seq) as new_scope
  from v where reason is null group by all)
select g.principal_type, g.principal_id, {", ".join("g." + x for x in VOL_KEY)}, g.folder_path,
       case when l.principal_type is null then g.permission else l.new_permission end as permission,
       case when l.principal_type is null then g.granted_by else '{GRANTER}' end as granted_by,
       case when l.principal_type is null then g.granted_at else timestamp '{AS_OF}' end as granted_at,
       case when l.principal_type is null then g.scope else l.new_scope end as scope
from grants g left join last l on {_key_eq('l', 'g')}""")
def q_update_grants(spark, sf):
    nxt, _ = C.update_grants(fx.grants(spark, sf), fx.changes(spark, sf), fx.users(spark, sf),
                             GRANTER, AS_OF)
    return nxt


@register("bulk_change", f"""
select * from grants g where not exists (select 1 from bulk_ok c where {_key_eq('c', 'g')})
union all
select principal_type, principal_id, {VK}, folder_path, permission, '{GRANTER}', timestamp '{AS_OF}', 'FOLDER'
from bulk_ok where coalesce(permission <> '', false)""")
def q_bulk_change(spark, sf):
    return C.bulk_change(fx.grants(spark, sf), C.accepted_changes(fx.changes(spark, sf)), GRANTER, AS_OF)[0]


@register("bulk_applied", "select count(*) as applied from bulk_ok")
def q_bulk_applied(spark, sf):
    return C.bulk_change(fx.grants(spark, sf), C.accepted_changes(fx.changes(spark, sf)), GRANTER, AS_OF)[1]


_WS_DECISIONS = """
with v0 as (
  select seq, display_name, host_url,
         case when coalesce(contains(workspace_id, chr(39)), false) or coalesce(contains(display_name, chr(39)), false)
                   or coalesce(contains(host_url, chr(39)), false) then 'quote_in_field'
              when coalesce(trim(workspace_id), '') = '' then 'missing_id' end as reason0,
         workspace_id as raw_id
  from workspace_candidates),
v1 as (
  select seq, display_name, host_url,
         case when reason0 is null then trim(raw_id) else raw_id end as workspace_id, reason0
  from v0),
v2 as (
  select v1.*, coalesce(reason0, case when exists (select 1 from workspaces w where w.workspace_id = v1.workspace_id)
                                      then 'exists' end) as reason1
  from v1),
v3 as (
  select seq, workspace_id, display_name, host_url,
         coalesce(reason1, case when seq <> min(seq) filter (where reason1 is null) over (partition by workspace_id)
                                then 'exists' end) as reason
  from v2)
"""


@register("workspace_exists", _WS_DECISIONS + "select seq, workspace_id, reason from v3")
def q_workspace_exists(spark, sf):
    _, d = C.add_workspaces(fx.workspaces(spark, sf), fx.workspace_candidates(spark, sf))
    return d.select("seq", "workspace_id", "reason")


@register("validate_workspace", """
select seq, case when coalesce(contains(workspace_id, chr(39)), false) or coalesce(contains(display_name, chr(39)), false)
                      or coalesce(contains(host_url, chr(39)), false) then 'quote_in_field'
                 when coalesce(trim(workspace_id), '') = '' then 'missing_id' end as reason
from workspace_candidates""")
def q_validate_workspace(spark, sf):
    c = fx.workspace_candidates(spark, sf)
    return c.select("seq", C.workspace_rejection().alias("reason"))


@register("add_workspace", _WS_DECISIONS + """
select workspace_id, display_name, host_url from workspaces
union all
select workspace_id, display_name, host_url from v3 where reason is null""")
def q_add_workspace(spark, sf):
    nxt, _ = C.add_workspaces(fx.workspaces(spark, sf), fx.workspace_candidates(spark, sf))
    return nxt


@register("seed_users", """
select * from users
union all
select replace(replace(split_part(e, '@', 1), '.', '_'), '-', '_'), coalesce(min(n), e), e, true
from (select trim(email) as e, nullif(trim(name), '') as n from admin_batch)
where e <> '' and e not in (select sso_email from users where sso_email is not null)
group by e""")
def q_seed_users(spark, sf):
    return C.seed_users(fx.users(spark, sf), fx.admin_batch(spark, sf))


# --- CSV import ----------------------------------------------------------------

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_IMPORT_ROWS = f"""
with recursive n0 as (
  select row_no,
         trim(coalesce(email, ''), {_STRIP}) as email, trim(coalesce(display_name, ''), {_STRIP}) as name,
         trim(coalesce(workspace_id, ''), {_STRIP}) as workspace_id,
         trim(coalesce(uc_catalog, ''), {_STRIP}) as uc_catalog,
         trim(coalesce(uc_schema, ''), {_STRIP}) as uc_schema,
         trim(coalesce(volume, ''), {_STRIP}) as volume,
         trim(coalesce(folder_path, ''), {_STRIP}) as folder_path,
         upper(trim(coalesce(permission, ''), {_STRIP})) as permission,
         upper(trim(case when coalesce(scope, '') = '' then 'FOLDER' else scope end, {_STRIP})) as scope0,
         upper(trim(case when coalesce(principal_type, '') = '' then 'USER' else principal_type end, {_STRIP})) as type0,
         trim(coalesce(nullif(principal_id, ''), ''), {_STRIP}) as group_name
  from import_rows),
n1 as (
  select * exclude (scope0, type0),
         case when scope0 in ('VOLUME', 'FOLDER_TREE', 'FOLDER') then scope0 else 'FOLDER' end as scope1,
         case when type0 in ('USER', 'GROUP') then type0 else 'USER' end as principal_type
  from n0),
kept as (
  select * from n1
  where workspace_id <> '' and uc_catalog <> '' and uc_schema <> '' and volume <> '' and folder_path <> ''
    and permission <> ''
    and case when principal_type = 'GROUP' then group_name <> '' else email <> '' end),
known as (select sso_email as email, max(user_id) as known_id from users group by sso_email),
fresh as (
  select email, min(row_no) as first_row from kept
  where principal_type = 'USER' and email not in (select email from known where email is not null) group by email),
slugged as (
  select email, first_row, replace(replace(split_part(email, '@', 1), '.', '_'), '-', '_') as base from fresh),
rooted as (
  select *, regexp_replace(base, '(_[0-9]+)+$', '') as root from slugged),
queued as (
  select *, row_number() over (partition by root order by first_row) as n from rooted),
given(root, n, email, user_id, taken) as (
  select r.root, cast(0 as bigint), cast(null as varchar), cast(null as varchar),
         coalesce((select list(k.known_id) from known k where regexp_replace(k.known_id, '(_[0-9]+)+$', '') = r.root), [])
  from (select distinct root from rooted) r
  union all
  select root, n, email, pick, list_append(taken, pick)
  from (select g.root, q.n, q.email, g.taken,
               list_filter(list_prepend(q.base, list_transform(range(1, len(g.taken) + 2), lambda i: q.base || '_' || i)),
                           lambda x: not list_contains(g.taken, x))[1] as pick
        from given g join queued q on q.root = g.root and q.n = g.n + 1)),
irows as (
  select k.row_no, k.principal_type,
         case when k.principal_type = 'GROUP' then k.group_name
              else coalesce(kn.known_id, gi.user_id) end as principal_id,
         k.workspace_id, k.uc_catalog, k.uc_schema, k.volume, k.folder_path, k.permission,
         case when k.principal_type = 'GROUP' and k.scope1 = 'VOLUME' then 'FOLDER_TREE' else k.scope1 end as scope,
         k.email, k.name, kn.known_id
  from kept k left join known kn on k.principal_type = 'USER' and kn.email = k.email
  left join given gi on k.principal_type = 'USER' and gi.email = k.email)
"""


@register("csv_import", _IMPORT_ROWS + f"""
select * from grants g where not exists (select 1 from irows r where {_key_eq('r', 'g')})
union all
select principal_type, principal_id, {VK}, folder_path, permission, '{GRANTER}', timestamp '{AS_OF}', scope
from irows""")
def q_csv_import(spark, sf):
    out = I.csv_import(fx.import_rows(spark, sf), fx.users(spark, sf), fx.grants(spark, sf), GRANTER, AS_OF)
    return out["grants"]


@register("import_normalise", _IMPORT_ROWS + """
select row_no, principal_type, workspace_id, uc_catalog, uc_schema, volume, folder_path, permission, scope
from irows""")
def q_import_normalise(spark, sf):
    rows = I.kept_rows(fx.import_rows(spark, sf))
    return rows.select("row_no", "principal_type", *VOL_KEY, "folder_path", "permission", "scope")


@register("import_counts", _IMPORT_ROWS + """
select (select count(distinct email) from irows where principal_type = 'USER' and known_id is null) as users_added,
       (select count(*) from irows) as permissions_added""")
def q_import_counts(spark, sf):
    out = I.csv_import(fx.import_rows(spark, sf), fx.users(spark, sf), fx.grants(spark, sf), GRANTER, AS_OF)
    return out["counts"]


@register("user_slug", _IMPORT_ROWS + """
select principal_id as user_id, arg_min(name, row_no) as display_name, email as sso_email, false as is_admin
from irows where principal_type = 'USER' and known_id is null group by principal_id, email""")
def q_user_slug(spark, sf):
    out = I.csv_import(fx.import_rows(spark, sf), fx.users(spark, sf), fx.grants(spark, sf), GRANTER, AS_OF)
    return out["new_users"]


@register("user_lookup", f"""
select r.row_no, trim(coalesce(r.email, ''), {_STRIP}) as email, k.known_id as user_id
from import_rows r left join (select sso_email, max(user_id) as known_id from users group by sso_email) k
  on k.sso_email = trim(coalesce(r.email, ''), {_STRIP})""")
def q_user_lookup(spark, sf):
    n = I.normalise_rows(fx.import_rows(spark, sf))
    known = fx.users(spark, sf).groupBy(F.col("sso_email").alias("email")).agg(F.max("user_id").alias("user_id"))
    return n.select("row_no", "email").join(known, "email", "left")

