"""Registered queries of the general data-processing operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import guid, table
from tessera.operators.hierarchy import descendants, hierarchy
from tessera.operators.orphans import broken
from tessera.operators.snapshots import changes, snapshot_pairs


def _packages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "context_packages").select(guid("id").alias("id"), guid("parent_package_id").alias("parent"), F.col("created_at").alias("at"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_packages(spark, sf)).where("parent is not null").select("id", "root_id", "depth")


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Every package with its path from the root (or from its loop), and the number of its descendants."""
    placed = hierarchy(_packages(spark, sf))
    above = descendants(placed).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))).alias("a"))
    path = F.concat_ws("/", F.coalesce(F.col("a.ancestor_id"), F.array().cast("array<string>")), F.array("id"))
    return placed.join(above, "id", "left").select("id", "root_id", "depth", path.alias("path"), "descendants", "cyclic")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(hierarchy(_packages(spark, sf)))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    snaps = table(spark, sf, "index_snapshots").groupBy(guid("id").alias("sid")).agg(F.max("completed_at").alias("made_at"), F.date_format(F.max("created_at"), "yyyy-MM").alias("period"))

    def of(name: str) -> DataFrame:
        t = table(spark, sf, name).select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), guid("file_id").alias("key"), guid("snapshot_id").alias("sid"))
        return t.where("key is not null").join(snaps, "sid", "left").select("table_name", "row_id", "key", "made_at", "period", F.lit("files").alias("into"))

    feedback = table(spark, sf, "context_feedback").select(F.lit("context_feedback").alias("table_name"), F.col("id").alias("row_id"), guid("context_package_id").alias("key"), F.col("created_at").alias("made_at"), F.date_format("created_at", "yyyy-MM").alias("period"), F.lit("context_packages").alias("into"))
    files = table(spark, sf, "files").select(guid("id").alias("key"), (~F.col("status").eqNullSafe("Deleted")).alias("alive"), F.col("created_at").alias("at"))
    packages = table(spark, sf, "context_packages").select(guid("id").alias("key"), F.lit(True).alias("alive"), F.col("created_at").alias("at"))
    to_files = of("file_symbols").unionByName(of("file_imports")).drop("into")
    return broken(to_files, files).unionByName(broken(feedback.drop("into"), packages))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf).select("table_name", "row_id", "reason").distinct()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Broken references per table, month of the referring snapshot or feedback, and reason."""
    return _broken(spark, sf).groupBy("table_name", "period", "reason").agg(F.count("*").alias("broken"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    snaps = table(spark, sf, "index_snapshots").select(guid("id").alias("id"), guid("workspace_id").alias("workspace_id"), "branch", "status", "created_at")
    files = table(spark, sf, "files").select(guid("snapshot_id").alias("snapshot_id"), "normalized_path", "content_hash", "status", "created_at")
    return changes(files, snapshot_pairs(snaps))


def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Changes per later snapshot and kind."""
    return p6_found(spark, sf).groupBy("snapshot_id", "change").agg(F.count("*").alias("paths"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p5_found, p5_report, p6_found, p6_summary)}


def _guid(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '^\\s+|\\s+$|[{{}}-]', '', 'g'), '')"


_WALK = f"""with recursive pk as (
  select id, parent from (select {_guid('id')} id, {_guid('parent_package_id')} parent, row_number() over (partition by {_guid('id')} order by created_at desc, {_guid('parent_package_id')} desc nulls last) k from context_packages) where k = 1),
up as (select a.id, b.id as p from pk a join pk b on a.parent = b.id),
walk as (
  select id, id as cur, 0 as depth, [id] as seen, false as looped from pk
  union all
  select w.id, up.p, w.depth + 1, list_append(w.seen, up.p), list_contains(w.seen, up.p)
  from walk w join up on up.id = w.cur where not w.looped),
last as (select id, cur, depth, seen, looped from (select *, row_number() over (partition by id order by depth desc) k from walk) where k = 1),
done as (select id, case when looped then list_min(list_slice(seen, list_position(seen, cur), len(seen))) else cur end as root_id, case when looped then -1 else depth end as depth, seen, looped, cur from last)"""

_REFS = f"""with snaps as (select {_guid('id')} sid, max(completed_at) done, strftime(max(created_at), '%Y-%m') period from index_snapshots group by 1),
refs as (
  select 'file_symbols' as table_name, s.id as row_id, {_guid('s.file_id')} as k, 'f' as into_, done as made_at, period from file_symbols s left join snaps on sid = {_guid('s.snapshot_id')}
  union all select 'file_imports', s.id, {_guid('s.file_id')}, 'f', done, period from file_imports s left join snaps on sid = {_guid('s.snapshot_id')}
  union all select 'context_feedback', id, {_guid('context_package_id')}, 'p', created_at, strftime(created_at, '%Y-%m') from context_feedback),
par as (
  select 'f' as into_, {_guid('id')} as k, min(case when status is distinct from 'Deleted' then created_at end) as first_at, max(case when status is distinct from 'Deleted' then 1 else 0 end) as alive from files group by 1, 2
  union all select 'p', {_guid('id')}, min(created_at), 1 from context_packages group by 1, 2),
broken as (select distinct table_name, row_id, period, case when par.k is null then 'missing' when alive = 0 then 'deleted' when first_at > made_at then 'late' end as reason
  from refs left join par on par.k = refs.k and par.into_ = refs.into_ where refs.k is not null)"""

_CHANGES = f"""with sn as (select distinct {_guid('id')} id, {_guid('workspace_id')} w, branch, created_at from index_snapshots where status in ('Active', 'ActiveDegraded', 'Superseded') and branch is not null),
pairs as (select * from (select id as snapshot_id, lag(id) over (partition by w, branch order by created_at, id) as previous_id from sn) where previous_id is not null),
f as (select sid, path, gone, case when h in ('', 'pending') then null else h end as h from (
  select *, row_number() over (partition by sid, path order by created_at desc, gone desc, h desc nulls last) k from (
    select {_guid('snapshot_id')} sid, regexp_replace(replace(normalized_path, chr(92), '/'), '^\\./', '') path, status = 'Deleted' gone, regexp_replace(lower(trim(content_hash)), '^sha256:', '') h, created_at from files)) where k = 1 and not gone),
a as (select snapshot_id, path, h from pairs join f on sid = snapshot_id),
b as (select snapshot_id, path, h from pairs join f on sid = previous_id),
diff as (select coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.path, b.path) as normalized_path,
  case when b.path is null then 'added' when a.path is null then 'removed' when a.h <> b.h then 'changed' end as change
  from a full join b on a.snapshot_id = b.snapshot_id and a.path = b.path)"""

SQL = {
    "p1_found": _WALK + " select done.id, root_id, depth::int as depth from done join pk on pk.id = done.id where parent is not null",
    "p1_descendants": _WALK + " select seen[k] as ancestor_id, id, (k - 1)::int as distance from (select id, seen, unnest(range(2, case when looped then len(seen) else len(seen) + 1 end)) k from last)",
    "p1_hierarchy": _WALK + ", tr as (select id, case when looped then seen[1 : len(seen) - 1] else seen end s, looped from last), ds as (select a, count(*) n from (select unnest(s[2:]) a from tr) group by 1) select done.id, root_id, depth::int as depth, array_to_string(list_reverse(s), '/') as path, coalesce(n, 0) as descendants, tr.looped as cyclic from done join tr using (id) left join ds on a = done.id",
    "p5_found": _REFS + " select distinct table_name, row_id, reason from broken where reason is not null",
    "p5_report": _REFS + " select table_name, period, reason, count(*) as broken from broken where reason is not null group by 1, 2, 3",
    "p6_found": _CHANGES + " select * from diff where change is not null",
    "p6_summary": _CHANGES + " select snapshot_id, change, count(*) as paths from diff where change is not null group by 1, 2",
}
