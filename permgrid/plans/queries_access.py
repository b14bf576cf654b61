"""Registered queries: access decisions, entitlement matrix, principals."""

from __future__ import annotations

from permgrid.functions.cover import rank_to_permission
from permgrid.operators import authorise as A
from permgrid.operators import principals as P
from permgrid.plans import entitlement as E
from permgrid.plans.catalog import register
from permgrid.schemas import VOL_KEY
from permgrid.sources import fixtures as fx

VK = ", ".join(VOL_KEY)


@register("effective_permission", """
select request_id, user_id, workspace_id, uc_catalog, uc_schema, volume, folder, effective
from decisions""")
def q_effective_permission(spark, sf):
    d = A.effective_permission(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf))
    return d.select("request_id", "user_id", *VOL_KEY, "folder", "effective")


@register("action_gate", """
select request_id, action, effective,
       coalesce(effective = 'DOWNLOAD' or (effective = 'READ' and action <> 'download'), false) as allowed
from decisions""")
def q_action_gate(spark, sf):
    return A.action_gate(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf))


@register("strongest_permission", f"""
select user_id, {VK}, folder,
       case when max(case when permission = 'DOWNLOAD' then 1 else 0 end) = 1 then 'DOWNLOAD'
            else 'READ' end as effective
from covering group by user_id, {VK}, folder""")
def q_strongest_permission(spark, sf):
    return A.strongest_permission(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf))


@register("scope_cover", """
select request_id, principal_type, principal_id, folder_path, scope, permission from covering""")
def q_scope_cover(spark, sf):
    return A.covering_grants(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf))


@register("principal_filter", """
select p.user_id, g.* from principals p
join grants g on g.principal_type = p.principal_type and g.principal_id = p.principal_id""")
def q_principal_filter(spark, sf):
    return P.principal_filter(fx.grants(spark, sf), fx.principals(spark, sf))


@register("entitlement_matrix", f"""
select u.user_id, f.workspace_id, f.uc_catalog, f.uc_schema, f.volume, f.folder, f.name, f.size,
       case when u.rnk = 1 then 'DOWNLOAD' else 'READ' end as effective
from user_folder u join files f using ({VK}, folder)""")
def q_entitlement_matrix(spark, sf):
    return E.entitlement_matrix(fx.files(spark, sf), fx.principals(spark, sf), fx.grants(spark, sf))


_CLASSES = f"""
folder_ranks as (
  select distinct on (f.workspace_id, f.uc_catalog, f.uc_schema, f.volume, f.folder, g.principal_type, g.principal_id)
         f.workspace_id || '|' || f.uc_catalog || '|' || f.uc_schema || '|' || f.volume || '|' || f.folder as fname,
         g.principal_type, g.principal_id, case when g.permission = 'DOWNLOAD' then 1 else 0 end as rnk
  from folders f join grants g on g.workspace_id = f.workspace_id and g.uc_catalog = f.uc_catalog
   and g.uc_schema = f.uc_schema and g.volume = f.volume
  where case coalesce(nullif(g.scope, ''), 'FOLDER')
          when 'VOLUME' then true
          when 'FOLDER_TREE' then starts_with(f.folder, g.folder_path)
          else f.folder = g.folder_path end
  order by rnk desc),
folder_sets as (
  select fname, md5(string_agg(principal_type || chr(1) || principal_id || chr(1) || rnk, chr(2)
                               order by principal_type, principal_id)) as s
  from folder_ranks group by fname),
fclass as (
  select fname, min(fname) over (partition by s) as folder_class, count(*) over (partition by s) as n_folders from folder_sets),
user_sets as (
  select user_id, md5(string_agg(principal_id, chr(2) order by principal_id)) as s
  from principals where principal_type = 'GROUP' group by user_id),
uclass as (
  select user_id, min(user_id) over (partition by s) as user_class, count(*) over (partition by s) as n_users from user_sets),
class_ranks as (
  select u.user_class, f.folder_class, max(u.n_users) as n_users, max(f.n_folders) as n_folders, max(r.rnk) as rnk
  from fclass f join folder_ranks r on r.fname = f.folder_class and f.fname = f.folder_class and r.principal_type = 'GROUP'
  join principals p on p.principal_type = 'GROUP' and p.principal_id = r.principal_id
  join uclass u on u.user_id = p.user_id and u.user_id = u.user_class
  group by u.user_class, f.folder_class)"""


def _classes(spark, sf):
    return E.entitlement_classes(fx.files(spark, sf), fx.principals(spark, sf), fx.grants(spark, sf))


@register("entitlement_classes", f"""
with {_CLASSES}
select user_class, folder_class, n_users, n_folders, case when rnk = 1 then 'DOWNLOAD' else 'READ' end as effective
from class_ranks""")
def q_entitlement_classes(spark, sf):
    """The matrix at class grain: what the groups of a class of users open in a class of folders."""
    return _classes(spark, sf).matrix().select("user_class", "folder_class", "n_users", "n_folders",
                                               rank_to_permission("rank").alias("effective"))


@register("entitlement_corrections", f"""
with {_CLASSES}
select p.user_id, r.fname as folder_class, case when r.rnk = 1 then 'DOWNLOAD' else 'READ' end as effective
from folder_ranks r join fclass f on f.fname = r.fname and f.fname = f.folder_class
join principals p on p.principal_type = 'USER' and r.principal_type = 'USER' and p.principal_id = r.principal_id
left join uclass u on u.user_id = p.user_id
left join class_ranks c on c.user_class = u.user_class and c.folder_class = f.folder_class
where r.rnk > coalesce(c.rnk, -1)""")
def q_entitlement_corrections(spark, sf):
    """Where users' own grants give more than their class has."""
    return _classes(spark, sf).own.select("user_id", "folder_class", rank_to_permission("rank").alias("effective"))


@register("folder_access_summary", f"""
select {VK}, folder, count(*) as readers, cast(sum(rnk) as bigint) as downloaders
from user_folder group by all""")
def q_folder_access_summary(spark, sf):
    return E.folder_access_summary(fx.files(spark, sf), fx.principals(spark, sf), fx.grants(spark, sf))
