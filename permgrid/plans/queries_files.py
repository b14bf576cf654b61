"""Registered queries: inventory, contents, previews, bundles, paths, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from permgrid.functions.paths import folder_ancestors, parse_volume_path, volume_path
from permgrid.operators import files as FL
from permgrid.operators import importer as I
from permgrid.operators import principals as P
from permgrid.operators.authorise import action_allowed, effective_permission
from permgrid.plans import entitlement as E
from permgrid.plans.catalog import register
from permgrid.plans.oracle import AS_OF
from permgrid.schemas import GRANTS, VOL_KEY
from permgrid.session import scratch_path
from permgrid.sources import fixtures as fx
from permgrid.sources import files as SF
from permgrid.sources import tables as TB
from permgrid.sources.store import LAYOUT, volume_store

VK = ", ".join(VOL_KEY)
FK = VK + ", folder"
def _bundle_day():
    return F.lit(AS_OF[:10]).cast("date")


@register("dir_file_split", f"""
with pos as (
  select {VK}, folder, unnest(range(1, length(folder) + 1)) as i from folders),
parents as (
  select {VK}, folder, substr(folder, 1, i) as parent, substr(folder, i + 1) as rest
  from pos where substr(folder, i, 1) = '/'),
dirs as (
  select distinct {VK}, parent as folder, split_part(rest, '/', 1) as name
  from parents where strpos(rest, '/') > 0)
select {VK}, folder, 'dir' as entry_type, name, folder || name || '/' as path from dirs
union all
select {VK}, folder, 'file', name, folder || name from files""")
def q_dir_file_split(spark, sf):
    return FL.dir_file_split(fx.files(spark, sf))


@register("folder_ancestors", f"""
with pos as (
  select {VK}, folder, unnest(range(1, length(folder))) as i from folders)
select {VK}, folder, substr(folder, 1, i) as ancestor from pos where substr(folder, i, 1) = '/'""")
def q_folder_ancestors(spark, sf):
    f = E.inventory_folders(fx.files(spark, sf))
    return f.select(*VOL_KEY, "folder", F.explode(folder_ancestors("folder")).alias("ancestor"))


@register("parse_volume_path", """
select '/Volumes/' || uc_catalog || '/' || uc_schema || '/' || volume || folder || name as path,
       uc_catalog, uc_schema, volume, folder, name
from files""")
def q_parse_volume_path(spark, sf):
    p = fx.files(spark, sf).select(volume_path("uc_catalog", "uc_schema", "volume", "folder", "name").alias("path"))
    return p.select("path", *parse_volume_path("path"))


_SELECTED = f"""
sel as (
  select distinct r.request_id, s.name, f.name is not null as found, f.size
  from (select distinct request_id, name from selections) s
  join requests r on r.request_id = s.request_id and r.action = 'download'
  left join files f on f.name = s.name and f.folder = r.folder
    and f.workspace_id = r.workspace_id and f.uc_catalog = r.uc_catalog and f.uc_schema = r.uc_schema and f.volume = r.volume),
tot as (
  select request_id, count(*) as n_selected, count(*) filter (where found) as n_files,
         count(*) filter (where not found) as n_missing, cast(coalesce(sum(size), 0) as bigint) as total_bytes
  from sel group by request_id)"""


@register("selection_totals", f"with {_SELECTED} select * from tot")
def q_selection_totals(spark, sf):
    r = fx.requests(spark, sf).where(F.col("action") == "download")
    return FL.selection_totals(r, fx.selections(spark, sf), fx.files(spark, sf))


_DL = """
select d.request_id, d.effective,
       coalesce(d.effective = 'DOWNLOAD' or (d.effective = 'READ' and d.action <> 'download'), false) as allowed,
       d.workspace_id, d.uc_catalog, d.uc_schema, d.volume, d.folder
from decisions d where d.action = 'download'"""


@register("bundle_manifest", f"""
with dl as ({_DL}), {_SELECTED}
select dl.request_id, dl.effective, dl.allowed, coalesce(t.n_selected, 0) as n_selected, coalesce(t.n_files, 0) as n_files,
       coalesce(t.n_missing, 0) as n_missing, coalesce(t.total_bytes, 0) as total_bytes,
       replace(trim(dl.folder, '/'), '/', '_') || '_' || strftime(date '{AS_OF[:10]}', '%Y%m%d') || '.zip'
           as bundle_name
from dl left join tot t on t.request_id = dl.request_id""")
def q_bundle_manifest(spark, sf):
    return FL.bundle_manifest(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf),
                              fx.files(spark, sf), fx.selections(spark, sf), _bundle_day())


@register("bundle_files", f"""
with dl as ({_DL}), {_SELECTED}
select dl.request_id, '/Volumes/' || dl.uc_catalog || '/' || dl.uc_schema || '/' || dl.volume || dl.folder || s.name
           as path, cast(coalesce(s.size, 0) as bigint) as size, s.found
from dl join sel s on s.request_id = dl.request_id where dl.allowed""")
def q_bundle_files(spark, sf):
    return FL.bundle_files(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf),
                           fx.files(spark, sf), fx.selections(spark, sf))


@register("gated_listing", f"""
with entries as (
  select {FK}, count(*) filter (where kind = 'dir') as n_dirs, count(*) filter (where kind = 'file') as n_files
  from (
    select {VK}, folder, 'file' as kind, name from files
    union all
    select distinct {VK}, substr(folder, 1, i) as folder, 'dir', split_part(substr(folder, i + 1), '/', 1)
    from (select {VK}, folder, unnest(range(1, length(folder) + 1)) as i from folders)
    where substr(folder, i, 1) = '/' and strpos(substr(folder, i + 1), '/') > 0)
  group by all)
select d.request_id, d.effective,
       case when d.effective = 'DENIED' then 0 else coalesce(e.n_dirs, 0) end as n_dirs,
       case when d.effective = 'DENIED' then 0 else coalesce(e.n_files, 0) end as n_files
from (select * from decisions where action = 'browse') d left join entries e using ({FK})""")
def q_gated_listing(spark, sf):
    """What each browse request is shown: nothing unless the caller may read the folder."""
    return FL.gated_listing_totals(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf), fx.files(spark, sf))


@register("gated_listing_rows", f"""
with entries as (
  select {FK}, 'file' as entry_type, name, folder || name as path from files
  union all
  select distinct {VK}, substr(folder, 1, i), 'dir', split_part(substr(folder, i + 1), '/', 1),
         substr(folder, 1, i) || split_part(substr(folder, i + 1), '/', 1) || '/'
  from (select {VK}, folder, unnest(range(1, length(folder) + 1)) as i from folders)
  where substr(folder, i, 1) = '/' and strpos(substr(folder, i + 1), '/') > 0)
select d.request_id, d.effective, e.entry_type, e.name, e.path
from decisions d join entries e using ({FK}) where d.action = 'browse' and d.effective <> 'DENIED'""")
def q_gated_listing_rows(spark, sf):
    """The entries that each permitted browse request sees."""
    return FL.gated_listing(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf), fx.files(spark, sf))


@register("bounded_up", """
select distinct c.request_id, substr(c.folder, 1, u.i) as ancestor
from covering c, unnest(range(1, length(c.folder))) u(i)
where substr(c.folder, u.i, 1) = '/'
  and (coalesce(c.scope, '') = 'VOLUME' or (c.scope = 'FOLDER_TREE' and starts_with(substr(c.folder, 1, u.i), c.folder_path)))""")
def q_bounded_up(spark, sf):
    return FL.reachable_ancestors(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf))


# --- directory payloads ---------------------------------------------------------

_MEMBERSHIP_SQL = """
select 'user_' || cast(c_custkey as varchar) || '_x' as user_id, 'nat-' || cast(c_nationkey as varchar) as group_name,
       1 as position
from customer where c_custkey % 97 <> 0
union all
select 'user_' || cast(c_custkey as varchar) || '_x', 'seg-' || lower(c_mktsegment), 2
from customer where c_custkey % 97 <> 0
union all
select 'user_' || cast(c_custkey as varchar) || '_x', 'team-' || i, 2 + i
from customer, range(1, 601) t(i) where c_custkey % 97 <> 0 and c_custkey % 1000 = 7"""


@register("scan_memberships", "select user_id, group_name, cast(position as integer) as position from (" + _MEMBERSHIP_SQL + ")")
def q_scan_memberships(spark, sf):
    return P.scan_memberships(fx.payloads(spark, sf)).withColumn("position", F.col("position").cast("int"))


@register("group_dedup_cap", f"""
select c.user_id, coalesce(string_agg(m.group_name, ',' order by m.position), '') as group_list,
       cast(count(m.group_name) as integer) as n_groups,
       cast(greatest(count(m.group_name) - 500, 0) as integer) as beyond_500
from (select 'user_' || cast(c_custkey as varchar) || '_x' as user_id from customer) c
left join ({_MEMBERSHIP_SQL}) m using (user_id) group by c.user_id""")
def q_group_dedup_cap(spark, sf):
    g = P.group_names()
    return fx.payloads(spark, sf).select("user_id", F.array_join(g, ",").alias("group_list"), F.size(g).alias("n_groups"),
                                         P.names_beyond(500).cast("int").alias("beyond_500"))


# --- files on storage -----------------------------------------------------------

# the store of ``sources.store``, restated: which folder a lineitem row is filed under
_STORE = """
store as (
  select 'ws' || (l_orderkey % 27) as workspace_id, 'cat' || (l_orderkey % 2) as uc_catalog, 'sch' || (l_orderkey % 3) as uc_schema,
         'vol' || (l_orderkey % 4) as volume,
         case when l_orderkey % 2 = 1 then '/' else '/y' || year(l_shipdate) || '/' end as folder,
         l_orderkey, l_linenumber, l_partkey, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') as l_shipdate
  from lineitem)"""
_HEADER = "l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_returnflag,l_shipdate"


def _lines(spark, sf):
    return SF.read_lines(spark, volume_store(spark, sf), LAYOUT)


@register("inventory_scan", f"""
with {_STORE} select distinct {FK}, true as has_files from store""")
def q_inventory_scan(spark, sf):
    """Folders that hold files, from a listing (how many part files a folder has is up to the writer)."""
    inv = SF.inventory_from_store(SF.list_files(spark, volume_store(spark, sf), "*.csv"))
    return inv.groupBy(*VOL_KEY, "folder").agg((F.count_if(F.col("size") > 0) > 0).alias("has_files"))


@register("content_source", f"""
with {_STORE} select {FK}, count(*) as n_rows, 6 * count(*) as n_commas from store group by all""")
def q_content_source(spark, sf):
    """Whole contents, read in splits: data lines and commas per folder."""
    data = _lines(spark, sf).where(F.col("line") != _HEADER)
    return data.groupBy(*VOL_KEY, "folder").agg(F.count(F.lit(1)).alias("n_rows"),
                                                F.sum(F.regexp_count("line", F.lit(","))).cast("bigint").alias("n_commas"))


@register("byte_limit", f"""
with {_STORE} select distinct {FK}, '{_HEADER[:40]}' as head, true as cut from store""")
def q_byte_limit(spark, sf):
    """The first 40 bytes of every file, and that more were left out."""
    heads = SF.read_heads(spark, volume_store(spark, sf), 40, "*.csv")
    return SF.inventory_from_store(heads.withColumn("modified", F.lit(None))).drop("modified", "size").join(
        heads, "path").select(*VOL_KEY, "folder", F.col("text").alias("head"), (F.col("bytes_left") > 0).alias("cut")).distinct()


@register("preview_rows", f"""
with {_STORE}
select {FK}, cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber,
       cast(l_partkey as varchar) as l_partkey, l_returnflag, l_shipdate from store""")
def q_preview_rows(spark, sf):
    """Every preview row of every file, as cells."""
    p = FL.preview(_lines(spark, sf)).where(F.col("row_no") > 0)
    return p.select(*VOL_KEY, "folder", *(F.get("cells", i).alias(c) for i, c in enumerate(_HEADER.split(","))
                                          if c not in ("l_quantity", "l_extendedprice")))


@register("preview_batch", f"""
with {_STORE},
per as (select {FK}, count(*) as n_rows, 7 * count(*) as n_cells, sum(l_partkey) as part_sum from store group by all)
select d.request_id, p.n_rows, p.n_cells, cast(p.part_sum as bigint) as part_sum
from (select * from decisions where action = 'preview' and effective <> 'DENIED') d join per p using ({FK})""")
def q_preview_batch(spark, sf):
    """Gated previews, totalled per permitted request over the rows of its folder's files."""
    r = fx.requests(spark, sf)
    d = effective_permission(r.where(F.col("action") == "preview"), fx.memberships(spark, sf), fx.grants(spark, sf))
    ok = d.where(action_allowed()).select("request_id", *VOL_KEY, "folder")
    shown = _lines(spark, sf).join(ok.select(*VOL_KEY, "folder").distinct(), [*VOL_KEY, "folder"], "left_semi")
    rows = FL.preview(shown).where(F.col("row_no") > 0)
    per = rows.groupBy(*VOL_KEY, "folder").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).cast("bigint").alias("n_cells"),
                                               F.sum(F.get("cells", 2).cast("bigint")).alias("part_sum"))
    return ok.join(per, [*VOL_KEY, "folder"]).select("request_id", "n_rows", "n_cells", "part_sum")


@register("gated_preview", f"""
with {_STORE}
select d.request_id, cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber,
       cast(l_partkey as varchar) as l_partkey, l_returnflag, l_shipdate
from decisions d join store using ({FK}) where d.action = 'preview' and d.effective <> 'DENIED'""")
def q_gated_preview(spark, sf):
    """The preview rows that each permitted preview request sees, as cells."""
    p = FL.gated_preview(fx.requests(spark, sf), fx.memberships(spark, sf), fx.grants(spark, sf), _lines(spark, sf))
    return p.where(F.col("row_no") > 0).select("request_id", *(
        F.get("cells", i).alias(c) for i, c in enumerate(_HEADER.split(",")) if c not in ("l_quantity", "l_extendedprice")))


_CSV_COLUMNS = ("email", "display_name", "workspace_id", "uc_catalog", "uc_schema", "volume", "folder_path", "permission", "scope",
                "principal_type", "principal_id")


@register("csv_source", "select row_no as line, " + ", ".join(f"nullif({c}, '') as {c}" for c in _CSV_COLUMNS) + " from import_rows")
def q_csv_source(spark, sf):
    """Write the import rows as CSV files in parallel, then read them back as text in splits.
    The rows' own number shows that every record came back whole, line breaks in names included."""
    path = scratch_path(spark, "upload") + ".csv"
    raw = fx.import_rows(spark, sf).withColumnRenamed("row_no", "line")
    raw.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = I.read_import_csv(spark, path).drop("row_no")
    return back.select(F.col("line").cast("bigint").alias("line"), *(F.nullif(F.col(c), F.lit("")).alias(c) for c in _CSV_COLUMNS))


@register("create_tables", """
select 'download_workspaces' as table_name, (select count(*) from workspaces) as n_rows
union all select 'download_user', (select count(*) from users)
union all select 'download_permissions', (select count(*) from grants)""")
def q_create_tables(spark, sf):
    """Create the three tables (twice, it is idempotent), fill them by name, and report their
    row counts; the database goes again, the files stay below the scratch folder."""
    db = "permgrid_" + uuid.uuid4().hex[:8]
    loc = scratch_path(spark, "tables")
    for _ in range(2):
        TB.create_tables(spark, db, loc)
    for name, rows in (("download_workspaces", fx.workspaces(spark, sf)), ("download_user", fx.users(spark, sf)),
                       ("download_permissions", fx.grants(spark, sf))):
        TB.conform(rows, TB.TABLES[name]).write.mode("append").format("parquet").saveAsTable(f"{db}.{name}")
    counts = [(t, spark.table(f"{db}.{t}").count()) for t in TB.TABLES]
    spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return spark.createDataFrame(counts, "table_name string, n_rows bigint")


@register("snapshot_sink", """
select * from grants g where not exists (
  select 1 from bulk_ok c where c.principal_type = g.principal_type and c.principal_id = g.principal_id
    and c.workspace_id = g.workspace_id and c.uc_catalog = g.uc_catalog and c.uc_schema = g.uc_schema
    and c.volume = g.volume and c.folder_path = g.folder_path)
union all
select principal_type, principal_id, workspace_id, uc_catalog, uc_schema, volume, folder_path, permission,
       'user_0_x', timestamp '""" + AS_OF + """', 'FOLDER'
from bulk_ok where coalesce(permission <> '', false)""")
def q_snapshot_sink(spark, sf):
    """Grants in buckets of volumes; a bulk change rewrites the buckets it names."""
    from permgrid.operators.changes import accepted_changes, bulk_change
    from permgrid.sources import buckets as B
    path = scratch_path(spark, "grants")
    B.write_buckets(TB.conform(fx.grants(spark, sf), GRANTS), path)
    ok = accepted_changes(fx.changes(spark, sf))
    named = B.buckets_named(ok)
    B.replace_buckets(bulk_change(B.read_buckets(spark, path, GRANTS, named), ok, "user_0_x", AS_OF)[0], path, named)
    return B.read_buckets(spark, path, GRANTS)


@register("matrix_maintenance", f"""
with after as (
  select principal_type, principal_id, {VK}, folder_path, permission, scope from grants g where not exists (
    select 1 from bulk_ok c where c.principal_type = g.principal_type and c.principal_id = g.principal_id
      and c.workspace_id = g.workspace_id and c.uc_catalog = g.uc_catalog and c.uc_schema = g.uc_schema
      and c.volume = g.volume and c.folder_path = g.folder_path)
  union all
  select principal_type, principal_id, {VK}, folder_path, permission, 'FOLDER'
  from bulk_ok where coalesce(permission <> '', false))
select a.principal_type, a.principal_id, f.workspace_id, f.uc_catalog, f.uc_schema, f.volume, f.folder,
       case when a.permission = 'DOWNLOAD' then 1 else 0 end as rank, count(*) as n
from folders f join after a on a.workspace_id = f.workspace_id and a.uc_catalog = f.uc_catalog
 and a.uc_schema = f.uc_schema and a.volume = f.volume
where case coalesce(nullif(a.scope, ''), 'FOLDER')
        when 'VOLUME' then true
        when 'FOLDER_TREE' then starts_with(f.folder, a.folder_path)
        else f.folder = a.folder_path end
group by all""")
def q_matrix_maintenance(spark, sf):
    """How many grants support each principal's ranks on each folder, kept up to date through a bulk change."""
    from permgrid.operators.changes import accepted_changes, bulk_change
    from permgrid.plans.maintain import MaintainedMatrix
    m = MaintainedMatrix(spark, scratch_path(spark, "matrix"))
    m.build(TB.conform(fx.grants(spark, sf), GRANTS), fx.files(spark, sf))
    ok = accepted_changes(fx.changes(spark, sf))
    m.change(ok, lambda g: bulk_change(g, ok, "user_0_x", AS_OF)[0])
    return m.support()
