"""DuckDB oracle: SQL twins of the fixtures and of every registered query.

The driver registers only the base tables, so each query is emitted as
``WITH <needed views> <body>``.  The views restate ``permgrid.sources.fixtures``
in plain SQL; the bodies restate the operators the *naive* way (for example the
cover test as a residual on a join over VOL_KEY, not the probe equi-join), so the
two sides are independent formulations.
"""

from __future__ import annotations

import re

# Fixed literal used by change operators in place of current_timestamp().
AS_OF = "2026-01-01 00:00:00"

VIEWS: list[tuple[str, str]] = [
    ("users", """
select 'user_' || cast(c_custkey as varchar) || '_x' as user_id, c_name as display_name,
       'user.' || cast(c_custkey as varchar) || '-x@example.com' as sso_email,
       c_custkey % 25 = 0 as is_admin
from customer"""),
    ("memberships", """
select 'user_' || cast(c_custkey as varchar) || '_x' as user_id,
       'nat-' || cast(c_nationkey as varchar) as group_name from customer where c_custkey % 7 <> 3
union all
select 'user_' || cast(c_custkey as varchar) || '_x', 'seg-' || lower(c_mktsegment) from customer where c_custkey % 7 <> 3"""),
    ("principals", """
select user_id, 'USER' as principal_type, user_id as principal_id from users
union all
select distinct user_id, 'GROUP', group_name from memberships"""),
    ("workspaces", """
select 'ws' || cast(n_nationkey as varchar) as workspace_id, n_name as display_name,
       'https://ws' || cast(n_nationkey as varchar) || '.example.com' as host_url
from nation"""),
    ("grants", """
select case when (o_orderkey % 18 < 6 or o_custkey % 49 = 3) then 'GROUP' else 'USER' end as principal_type,
       case when (o_orderkey % 18 < 6 or o_custkey % 49 = 3) then 'nat-' || cast(c_nationkey as varchar)
            when o_orderkey % 13 = 0 then 'user.' || cast(case when o_orderkey % 2 = 0 then o_custkey % 150 else o_custkey end as varchar) || '-x@example.com'
            else 'user_' || cast(case when o_orderkey % 2 = 0 then o_custkey % 150 else o_custkey end as varchar) || '_x' end as principal_id,
       'ws' || cast(case when (o_orderkey % 18 < 6 or o_custkey % 49 = 3) then (c_nationkey + o_orderkey % 4) % 27
                         else o_orderkey % 27 end as varchar) as workspace_id,
       'cat' || cast(o_orderkey % 2 as varchar) as uc_catalog,
       'sch' || cast(o_orderkey % 3 as varchar) as uc_schema,
       'vol' || cast(case when o_orderkey % 3 <> 1 then o_orderkey % 4 else 4 + (o_orderkey // 32) % 1000 end as varchar) as volume,
       case when o_orderkey % 7 = 0 then '/'
            when o_orderkey % 7 in (1, 2) then '/y' || cast(year(o_orderdate) as varchar) || '/'
            when o_orderkey % 7 = 6 then '/y' || substr(cast(year(o_orderdate) as varchar), 1, 3)
            else '/y' || cast(year(o_orderdate) as varchar) || '/m'
                 || lpad(cast(month(o_orderdate) as varchar), 2, '0') || '/' end as folder_path,
       case when o_orderkey % 97 = 0 then 'WRITE' when o_orderstatus = 'F' then 'DOWNLOAD' else 'READ' end as permission,
       case when o_orderkey % 11 = 0 then 'bootstrap' else 'user_0_x' end as granted_by,
       o_orderdate as granted_at,
       case when o_orderkey % 89 = 0 then 'SUBTREE' when o_orderkey % 7 = 0 then 'VOLUME' when o_orderkey % 7 in (1, 2, 6) then 'FOLDER_TREE'
            when o_orderkey % 7 in (3, 4) then 'FOLDER' else null end as scope
from orders join customer on o_custkey = c_custkey"""),
    ("files", """
select 'ws' || cast(l_orderkey % 27 as varchar) as workspace_id,
       'cat' || cast(l_orderkey % 2 as varchar) as uc_catalog,
       'sch' || cast(l_orderkey % 3 as varchar) as uc_schema,
       'vol' || cast(case when l_orderkey % 3 <> 1 then l_orderkey % 4 else 4 + (l_orderkey // 32) % 1000 end as varchar) as volume,
       case when l_linenumber = 1 then '/y' || cast(year(l_shipdate) as varchar) || '/'
            else '/y' || cast(year(l_shipdate) as varchar) || '/m'
                 || lpad(cast(month(l_shipdate) as varchar), 2, '0') || '/' end as folder,
       'f_' || cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) || '_'
            || cast(l_partkey as varchar) || '.csv' as name,
       cast(l_quantity as bigint) * 4096 as size, l_shipdate as modified
from lineitem"""),
    ("requests", """
select event_id as request_id, ts, case when event_id % 211 <> 0 then 'user_' || cast(user_id as varchar) || '_x' end as user_id,
       'ws' || cast(event_id % 27 as varchar) as workspace_id,
       'cat' || cast(event_id % 2 as varchar) as uc_catalog,
       'sch' || cast(event_id % 3 as varchar) as uc_schema,
       'vol' || cast(case when event_id % 3 <> 1 then event_id % 4 else 4 + (event_id // 32) % 1000 end as varchar) as volume,
       case when event_id % 5 = 0 then '/y' || cast(1995 + event_id % 7 as varchar) || '/'
            else '/y' || cast(1995 + event_id % 7 as varchar) || '/m'
                 || lpad(cast(1 + event_id % 12 as varchar), 2, '0') || '/' end as folder,
       case event_type when 'purchase' then 'download' when 'click' then 'preview'
            else 'browse' end as action
from events where event_type <> 'signup'"""),
    ("mints", """
select case when event_id % 211 <> 0 then 'user_' || cast(user_id as varchar) || '_x' end as user_id, ts as minted_at, event_id as mint_id
from events where event_type = 'signup'"""),
    ("removals", """
select case when event_id % 211 <> 0 then 'user_' || cast(user_id as varchar) || '_x' end as user_id, ts as removed_at, event_id as removal_id
from events where event_type = 'error'"""),
    ("import_rows", """
select o_orderkey as row_no,
       case when o_orderkey % 70 = 0 then '' else ' ' || case o_orderkey % 30
              when 0 then 'new.' || (o_custkey // 8) || '@d' || ((o_orderkey // 30) % 4) || '.example.com'
              when 10 then 'user.' || (o_custkey // 8) || '-x@d' || ((o_orderkey // 30) % 4) || '.example.com'
              when 20 then 'user.' || (o_custkey // 8) || '-x-' || (1 + o_orderkey % 3) || '@d' || ((o_orderkey // 30) % 4)
                   || '.example.com'
              else 'user.' || o_custkey || '-x@example.com' end || ' ' end as email,
       case when o_orderkey % 45 = 0 then 'Imported "' || o_custkey || '",' || chr(10) || 'second line'
            else 'Imported ' || cast(o_custkey as varchar) end as display_name,
       'ws' || cast(o_orderkey % 27 as varchar) as workspace_id,
       'cat' || cast(o_orderkey % 2 as varchar) as uc_catalog,
       'sch' || cast(o_orderkey % 3 as varchar) as uc_schema,
       case when o_orderkey % 110 = 0 then ' ' else 'vol' || cast(case when o_orderkey % 3 <> 1 then o_orderkey % 4 else 4 + (o_orderkey // 32) % 1000 end as varchar) end as volume,
       '/y' || cast(year(o_orderdate) as varchar) || '/' as folder_path,
       case when o_orderstatus = 'F' then ' download' else 'Read ' end as permission,
       case o_orderkey % 50 when 0 then 'volume' when 10 then 'folder_tree' when 20 then 'bogus'
            when 30 then '' else null end as scope,
       case when o_orderkey % 40 = 0 then 'group' when o_orderkey % 60 = 0 then 'robot' else null end
            as principal_type,
       case when o_orderkey % 80 = 0 then 'nat-1' else null end as principal_id
from orders"""),
    ("changes", """
select o_orderkey as seq,
       case when o_orderkey % 101 = 0 then 'robot' when o_orderkey % 18 < 6 then (case when o_orderkey % 4 = 0 then 'group' else 'GROUP' end)
            when o_orderkey % 9 = 0 then '' else 'USER' end as principal_type,
       case when o_orderkey % 103 = 0 then 'o''neil' when o_orderkey % 107 = 0 then ' ' when o_orderkey % 18 < 6 then 'nat-' || cast(c_nationkey as varchar)
            when o_orderkey % 13 = 0 then 'user.' || cast(case when o_orderkey % 2 = 0 then o_custkey % 150 else o_custkey end as varchar) || '-x@example.com'
            else 'user_' || cast(case when o_orderkey % 2 = 0 then o_custkey % 150 else o_custkey end as varchar) || '_x' end as principal_id,
       'ws' || cast(case when o_orderkey % 18 < 6 then (c_nationkey + o_orderkey % 4) % 27
                         else o_orderkey % 27 end as varchar) as workspace_id,
       'cat' || cast(o_orderkey % 2 as varchar) as uc_catalog,
       'sch' || cast(o_orderkey % 3 as varchar) as uc_schema,
       'vol' || cast(case when o_orderkey % 3 <> 1 then o_orderkey % 4 else 4 + (o_orderkey // 32) % 1000 end as varchar) as volume,
       '/y' || cast(year(o_orderdate) as varchar) || '/' as folder_path,
       case when o_orderkey % 4 = 1 then null when o_orderkey % 4 = 2 then ''
            when starts_with(o_orderpriority, '1') then 'DOWNLOAD' else 'READ' end as permission,
       case o_orderkey % 5 when 0 then 'volume' when 1 then 'FOLDER_TREE' when 3 then 'folder'
            else null end as scope
from orders join customer on o_custkey = c_custkey"""),
    ("changes_n", """
select * replace (upper(coalesce(nullif(principal_type, ''), 'USER')) as principal_type) from changes"""),
    # changes that a delete or bulk change lets pass
    ("bulk_ok", """
select * from changes_n
where principal_type in ('USER', 'GROUP') and not contains(principal_id, chr(39))
  and principal_id is not null and workspace_id is not null and uc_catalog is not null and uc_schema is not null
  and volume is not null and folder_path is not null"""),
    ("workspace_candidates", """
select cast(n_nationkey as bigint) as seq,
       case when n_nationkey % 6 = 5 then '  ' else ' ws' || cast(20 + n_nationkey % 15 as varchar) || ' ' end
           as workspace_id,
       case when n_nationkey % 9 = 4 then n_name || chr(39) || 's' else n_name end as display_name,
       'https://new' || cast(n_nationkey as varchar) || '.example.com' as host_url
from nation"""),
    ("logins", """
select case when user_id % 7 = 3 then 'guest.' || cast(user_id as varchar) || '@example.com'
            else 'user.' || cast(user_id as varchar) || '-x@example.com' end as email,
       case when user_id % 2 = 0 then '' else 'Guest ' || cast(user_id as varchar) end as preferred_name
from (select distinct user_id from events)"""),
    ("admin_batch", """
select case when n_nationkey % 8 = 5 then '  '
            when n_nationkey % 2 = 0 then ' user.' || cast(n_nationkey as varchar) || '-x@example.com'
            else 'admin.' || cast(n_regionkey as varchar) || '@example.com ' end as email,
       case when n_nationkey % 5 = 1 then ' ' else ' ' || n_name end as name
from nation"""),
    ("selections", """
select event_id as request_id, 'f_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '.csv' as name
from events join lineitem on l_orderkey = event_id where event_type = 'purchase'
union all
select event_id, 'none.csv' from events where event_type = 'purchase'"""),
    ("facet_selections", """
select event_id as selection_id,
       case when event_id % 2 = 0 then case when event_id % 11 = 0 then '' else c_name end end as display_name,
       case when (event_id // 2) % 2 = 0 then 'NATION_' || (event_id % 26) end as workspace_name,
       case when (event_id // 4) % 2 = 0 then 'cat' || (event_id % 3) end as uc_catalog,
       case when (event_id // 8) % 2 = 0 then 'vol' || (event_id % 9) end as volume,
       case when (event_id // 16) % 2 = 0 then case when event_id % 3 = 0 then 'READ' else 'DOWNLOAD' end end as permission
from events left join customer on c_custkey = user_id"""),
    ("admin_ids", """
select distinct user_id from users where is_admin"""),
    ("names", """
select user_id as id, any_value(display_name) as shown, any_value(sso_email) as mail from users group by user_id"""),
    ("listing", """
select gr.* replace (
         case when gr.granted_by in (select id from names)
              then (select shown from names where id = gr.granted_by) else gr.granted_by end as granted_by),
       ws.display_name as workspace_name,
       coalesce(case when principal_type = 'USER' then (select shown from names where id = principal_id) end,
                principal_id) as display_name,
       case when principal_type = 'USER' then (select mail from names where id = principal_id) end as sso_email
from workspaces ws, grants gr
where ws.workspace_id = gr.workspace_id"""),
    ("user_ws", """
select distinct p.user_id, w.workspace_id, w.display_name, w.host_url
from principals p
join grants g on g.principal_type = p.principal_type and g.principal_id = p.principal_id
join workspaces w on w.workspace_id = g.workspace_id"""),
    # request principals: the request's own id as USER, plus its groups
    ("req_principals", """
select distinct user_id, 'USER' as principal_type, user_id as principal_id from requests
union all
select distinct m.user_id, 'GROUP', m.group_name from memberships m
where m.user_id in (select user_id from requests)"""),
    # naive cover test: join on principal + VOL_KEY, residual on scope
    ("covering", """
select r.request_id, r.user_id, r.workspace_id, r.uc_catalog, r.uc_schema, r.volume, r.folder,
       g.principal_type, g.principal_id, g.folder_path, g.scope, g.permission
from requests r
join req_principals p on p.user_id = r.user_id
join grants g on g.principal_type = p.principal_type and g.principal_id = p.principal_id
 and g.workspace_id = r.workspace_id and g.uc_catalog = r.uc_catalog
 and g.uc_schema = r.uc_schema and g.volume = r.volume
where case coalesce(nullif(g.scope, ''), 'FOLDER')
        when 'VOLUME' then true
        when 'FOLDER_TREE' then starts_with(r.folder, g.folder_path)
        else r.folder = g.folder_path end"""),
    ("decisions", """
select r.*, coalesce(c.effective, 'DENIED') as effective
from requests r left join (
  select request_id, case when max(case when permission = 'DOWNLOAD' then 1 else 0 end) = 1
                          then 'DOWNLOAD' else 'READ' end as effective
  from covering group by request_id) c on r.request_id = c.request_id"""),
    # distinct inventory folders and their entitlement per user (naive)
    ("folders", """
select distinct workspace_id, uc_catalog, uc_schema, volume, folder from files"""),
    ("user_folder", """
select p.user_id, f.workspace_id, f.uc_catalog, f.uc_schema, f.volume, f.folder,
       max(case when g.permission = 'DOWNLOAD' then 1 else 0 end) as rnk
from folders f
join grants g on g.workspace_id = f.workspace_id and g.uc_catalog = f.uc_catalog
 and g.uc_schema = f.uc_schema and g.volume = f.volume
join principals p on p.principal_type = g.principal_type and p.principal_id = g.principal_id
where case coalesce(nullif(g.scope, ''), 'FOLDER')
        when 'VOLUME' then true
        when 'FOLDER_TREE' then starts_with(f.folder, g.folder_path)
        else f.folder = g.folder_path end
group by all"""),
]

_VIEW_NAMES = [n for n, _ in VIEWS]
_VIEW_SQL = dict(VIEWS)


def _needed(sql: str) -> list[str]:
    """Views referenced by ``sql``, transitively, in definition order."""
    need: set[str] = set()
    frontier = [sql]
    while frontier:
        text = frontier.pop()
        for name in _VIEW_NAMES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                frontier.append(_VIEW_SQL[name])
    return [n for n in _VIEW_NAMES if n in need]


def with_views(body: str) -> str:
    names = _needed(body)
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({_VIEW_SQL[n].strip()})" for n in names)
    b = body.strip()
    m = re.match(r"(?is)^with\s+(recursive\s+)?", b)
    if m:
        # the body has CTEs of its own: continue the same WITH list
        return f"WITH {m.group(1) or ''}{ctes},\n{b[m.end():]}"
    return f"WITH {ctes}\n{b}"
