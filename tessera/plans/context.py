"""What goes into a context and why: kinds of files, ignore rules, recall by paths and names, payloads by line ranges, folder maps, freshness, and prompts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import guid, guid_sql, table
from tessera.functions.paths import base_name, extension
from tessera.plans import lookups, texts, usage
from tessera.plans.lookups import ACTIVE
from tessera.plans.texts import keywords, parse_task_paths
from tessera.plans.usage import packages_json
from tessera.sources.index import contents, feedback, files, packages

# Kinds of files by extension, and rules by which files are ignored, in order; of those that match the last counts, "!" takes a file back.
CERTIFICATES = ("pem", "crt", "cer", "der", "p12", "pfx", "key")
BINARIES = ("png", "jpg", "jpeg", "gif", "ico", "webp", "zip", "gz", "tar", "7z", "jar", "dll", "exe", "so", "dylib", "pdf", "woff", "woff2", "ttf", "eot", "mp3", "mp4")
LANGUAGES = {
    "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "php": "php", "rb": "ruby", "swift": "swift", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html", "css": "css", "md": "markdown", "sql": "sql", "sh": "shell", "toml": "toml", "ini": "ini", "txt": "text",
}
IGNORED = ("node_modules/", "bin/", "obj/", "dist/", "*.min.js", "*.min.css", "*.lock", "package-lock.json", "vendor/", "!vendor/*/README.md", "/target/", ".venv/", "docs/**/*.png", "*.log")
ENTRY_POINTS = ("main.go", "main.py", "index.js", "index.ts", "program.cs", "lib.rs", "main.rs", "app.py", "readme.md", "package.json")
#: Lines that an expansion adds around a symbol; days for which a package stays valid.
AROUND, VALID_DAYS = 10, 90


def rule_pattern(rule: str) -> str:
    """A rule as a pattern over plain paths: anchored at the root by a leading slash, a folder by a trailing one; * within a name, ** over folders; without a wildcard any part of the path."""
    body = rule.lstrip("!")
    anchored, dir_ = body.startswith("/"), body.endswith("/")
    core = re.escape(body.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace(r"\-", "-")
    return ("^" if anchored else "(?:^|/)") + core + ("/" if dir_ else "$")


def file_types(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each kind: empty, certificate, binary, of a known language, or other."""
    path = F.col("normalized_path")
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    kind = F.when(F.col("size") == 0, "empty").when(extension(path).isin(*CERTIFICATES), "certificate").when(F.coalesce("is_binary", F.lit(False)) | extension(path).isin(*BINARIES), "binary").when(known[extension(path)].isNotNull(), known[extension(path)]).otherwise("other")
    return files(spark, sf).where("normalized_path is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("files"))


def ignore_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each snapshot that the rules leave, and those they take out."""
    path = F.regexp_replace(F.regexp_replace("normalized_path", r"\\", "/"), r"^\./", "")
    last = F.greatest(*[F.when(path.rlike(rule_pattern(r)), k) for k, r in enumerate(IGNORED)], F.lit(-1))
    back = F.array(*[F.lit(r.startswith("!")) for r in IGNORED])
    out = (last >= 0) & ~F.coalesce(F.get(back, last), F.lit(False))
    return files(spark, sf).where("normalized_path is not null").groupBy("snapshot_id").agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("ignored"))


def recall_path(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose path ends with one that stands in a task, met by their name."""
    asked = parse_task_paths(spark, sf).select("task_text", F.lower(F.regexp_replace("path", r"\\", "/")).alias("asked"))
    here = files(spark, sf).where("normalized_path is not null").select("snapshot_id", "normalized_path").distinct()
    hits = here.withColumn("name", base_name(F.col("normalized_path"))).join(asked.withColumn("name", base_name(F.col("asked"))), "name")
    return hits.where(F.endswith(F.lower("normalized_path"), F.col("asked"))).select("task_text", "snapshot_id", "normalized_path").distinct()


def recall_filename(spark: SparkSession, sf: str) -> DataFrame:
    """Active files whose path has a task's keyword as a word, with the number of such keywords."""
    snaps = table(spark, sf, "index_snapshots").where(F.col("status").isin(*ACTIVE)).select(guid("id").alias("snapshot_id")).distinct()
    here = files(spark, sf).where("normalized_path is not null").join(snaps, "snapshot_id", "left_semi").select("snapshot_id", "normalized_path").distinct()
    words = here.select("snapshot_id", "normalized_path", F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("normalized_path", "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+"))).alias("keyword"))
    per_word = words.join(keywords(spark, sf).groupBy("keyword").agg(F.count("*").alias("tasks")), "keyword")
    return per_word.groupBy("snapshot_id", "normalized_path").agg(F.count("*").alias("keywords"), F.sum("tasks").alias("task_hits"))


def recall_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of a snapshot where nothing was found: up to ten entry points, or else its five smallest files."""
    f = files(spark, sf).where("normalized_path is not null and size is not null").groupBy("snapshot_id", "normalized_path").agg(F.min("size").alias("size"))
    entries = f.where(base_name(F.col("normalized_path")).isin(*ENTRY_POINTS))
    by_path = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("normalized_path"))
    by_size = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("size", "normalized_path"))
    small = f.join(entries.select("snapshot_id").distinct(), "snapshot_id", "left_anti").select("snapshot_id", "normalized_path", by_size.alias("k")).where("k <= 5")
    return entries.select("snapshot_id", "normalized_path", by_path.alias("k")).where("k <= 10").unionByName(small).select("snapshot_id", "normalized_path", F.col("k").alias("place"))


def file_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of each file in order of line and name."""
    s = table(spark, sf, "file_symbols").select(guid("file_id").alias("file_id"), "name", "kind", "start_line").where("file_id is not null").distinct()
    return s.select("file_id", "name", "kind", "start_line", F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "name", "kind")).alias("place"))


def repomap_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes under each folder of each snapshot, with the share of the snapshot's files."""
    path = F.regexp_replace(F.regexp_replace("normalized_path", r"\\", "/"), r"^\./", "")
    f = files(spark, sf).where("normalized_path is not null").select("snapshot_id", path.alias("path"), "size").groupBy("snapshot_id", "path").agg(F.max("size").alias("size"))
    parts = F.split("path", "/")
    dirs = f.where(F.size(parts) > 1).select("snapshot_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    whole = f.groupBy("snapshot_id").agg(F.count("*").alias("all"))
    return dirs.groupBy("snapshot_id", "dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).join(whole, "snapshot_id").select("snapshot_id", "dir", "files", "bytes", F.round(F.col("files") / F.col("all"), 4).alias("share"))


def _ranges(spark: SparkSession, sf: str, around: int) -> DataFrame:
    s = table(spark, sf, "file_symbols").select(guid("file_id").alias("file_id"), "name", "start_line", "end_line").where("file_id is not null and start_line > 0 and end_line >= start_line").distinct()
    at = s.join(files(spark, sf).select("file_id", "snapshot_id", F.col("normalized_path").alias("path")).distinct(), "file_id")
    lines = contents(spark, sf).select("snapshot_id", "path", F.split("content", "\n").alias("lines"))
    a, z = F.greatest(F.col("start_line") - around, F.lit(1)), F.col("end_line") + around
    return at.join(lines, ["snapshot_id", "path"]).where(a <= F.size("lines")).select("snapshot_id", "path", "name", a.alias("start_line"), F.least(z, F.size("lines")).alias("end_line"), F.md5(F.array_join(F.slice("lines", a, z - a + 1), "\n")).alias("text_md5"))


def payload_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each symbol of an indexed content, by their digest."""
    return _ranges(spark, sf, 0)


def expand_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the lines around it."""
    return _ranges(spark, sf, AROUND)


def stale_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of each workspace by whether the snapshot they were made from still has the fingerprint of the newest active one; without a fingerprint a package counts as fresh."""
    s = table(spark, sf, "index_snapshots").distinct().select(guid("id").alias("index_snapshot_id"), guid("workspace_id").alias("w"), "status", "created_at", "workspace_fingerprint")
    now = s.where(F.col("status").isin(*ACTIVE)).groupBy("w").agg(F.max(F.struct("created_at", "index_snapshot_id", "workspace_fingerprint")).alias("n")).select("w", F.col("n.workspace_fingerprint").alias("current"))
    own = s.groupBy("index_snapshot_id").agg(F.max("workspace_fingerprint").alias("made_from"))
    rows = packages(spark, sf).join(own, "index_snapshot_id", "left").join(now, F.col("workspace_id") == F.col("w"), "left")
    fresh = F.coalesce(F.col("made_from") == F.col("current"), F.lit(True))
    return rows.groupBy("workspace_id").agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"))


def cache_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Packages by whether they may still be served: their snapshot replaced, else too old against the newest package, else valid."""
    s = table(spark, sf, "index_snapshots").groupBy(guid("id").alias("index_snapshot_id")).agg(F.max("status").alias("status"))
    last = packages(spark, sf).agg(F.max("created_at").alias("last"))
    rows = packages(spark, sf).join(s, "index_snapshot_id", "left").join(last)
    state = F.when(F.coalesce(F.col("status") == "Superseded", F.lit(False)), "replaced").when(F.col("created_at") < F.col("last") - F.expr(f"interval {VALID_DAYS} days"), "expired").otherwise("valid")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("packages"))


def cache_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of each workspace that stay when those of failed and cancelled snapshots are dropped."""
    gone = table(spark, sf, "index_snapshots").where(F.col("status").isin("Failed", "Cancelled")).select(guid("id").alias("index_snapshot_id")).distinct()
    return packages(spark, sf).join(gone, "index_snapshot_id", "left_anti").groupBy("workspace_id").agg(F.count("*").alias("packages"))


def rank_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a selected file is in: how high its score is and how it is shown."""
    reason = F.concat_ws("; ", F.when(F.col("score") >= 0.8, "strong match").when(F.col("score") >= 0.5, "match").otherwise("weak match"), F.when(F.col("mode") == "Full", "whole file").otherwise(F.concat(F.lit("shown as "), F.lower("mode"))))
    return packages_json(spark, sf).select("package_id", "path", "mode", "score", reason.alias("reason"))


def explain(spark: SparkSession, sf: str) -> DataFrame:
    """Of each package the files chosen and left out, the share of its budget used, and whether something was likely missed: more left out than chosen with budget to spare."""
    p = table(spark, sf, "context_packages").distinct().select(guid("id").alias("package_id"), "selected_file_count", "excluded_count", "actual_estimate", "context_target")
    used = F.round(F.col("actual_estimate") / F.greatest(F.col("context_target"), F.lit(1)), 4)
    return p.select("package_id", "selected_file_count", "excluded_count", used.alias("used"), ((F.col("excluded_count") > F.col("selected_file_count")) & (F.col("actual_estimate") < F.col("context_target") / 2)).alias("likely_missed"))


def revision(spark: SparkSession, sf: str) -> DataFrame:
    """Packages expanded from another, with the tokens and files that the expansion changed."""
    p = packages(spark, sf).select("package_id", "actual_estimate", "selected_file_count")
    child = table(spark, sf, "context_packages").groupBy(guid("id").alias("package_id")).agg(F.max_by(guid("parent_package_id"), F.struct("created_at", "actual_estimate", "selected_file_count", "excluded_count", "task_text", "parent_package_id")).alias("parent_id")).where("parent_id is not null")
    before = p.select(F.col("package_id").alias("parent_id"), F.col("actual_estimate").alias("e0"), F.col("selected_file_count").alias("f0"))
    return child.join(p, "package_id").join(before, "parent_id").select("package_id", "parent_id", (F.col("actual_estimate") - F.col("e0")).alias("added_tokens"), (F.col("selected_file_count") - F.col("f0")).alias("added_files"))


def feedback_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of each model by whether tests passed, failed or were not run."""
    state = F.when(F.col("tests_passed"), "passed").when(~F.col("tests_passed"), "failed").otherwise("unknown")
    return feedback(spark, sf).withColumn("state", state).groupBy("model").pivot("state", ["passed", "failed", "unknown"]).count().na.fill(0, ["passed", "failed", "unknown"])


def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each package: its task and its files by score, by digest."""
    listed = packages_json(spark, sf).groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", "mode"))).alias("f"))
    lines = F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["path"], F.lit(" ("), x["mode"], F.lit(")"))), "\n")
    return packages(spark, sf).join(listed, "package_id").select("package_id", F.md5(F.concat_ws("\n", F.concat(F.lit("# Task\n"), F.coalesce("task_text", F.lit(""))), F.lit("# Files"), lines)).alias("prompt_md5"))


def workspace_list(spark: SparkSession, sf: str) -> DataFrame:
    """Workspaces by their root's hash, the newest of each, with their snapshots."""
    w = table(spark, sf, "workspaces").distinct().groupBy("root_path_hash").agg(F.max(F.struct("updated_at", "id", "name", "status")).alias("w")).select("root_path_hash", guid("w.id").alias("workspace_id"), "w.name", "w.status", "w.updated_at")
    s = table(spark, sf, "index_snapshots").select(guid("workspace_id").alias("workspace_id"), guid("id").alias("s")).distinct().groupBy("workspace_id").agg(F.count("*").alias("snapshots"))
    return w.join(s, "workspace_id", "left").na.fill(0, ["snapshots"]).select("root_path_hash", "workspace_id", "name", "status", "updated_at", "snapshots")


QUERIES = {
    f.__name__: f
    for f in (
        file_types, ignore_rules, recall_path, recall_filename, recall_fallback, file_outline, repomap_tree, payload_ranges, expand_symbol, stale_gate, cache_validity, cache_invalidate, rank_reasons, explain, revision, feedback_pivot,
        prompt_assembly, workspace_list,
    )
}

_F = lookups._WITH
_P = usage._P
_PATH = "regexp_replace(replace(normalized_path, chr(92), '/'), '^\\./', '')"
_KIND = " ".join(f"when {lookups._EXT} = '{k}' then '{v}'" for k, v in LANGUAGES.items())
_LAST = "greatest(" + ", ".join(f"case when regexp_matches({_PATH}, '{rule_pattern(r)}') then {k} end" for k, r in enumerate(IGNORED)) + ", -1)"
_BACK = "(" + ", ".join(str(k) for k, r in enumerate(IGNORED) if r.startswith("!")) + ")"
_NAME = "lower(regexp_extract({c}, '([^/\\\\]*)$', 1))"


def _range_sql(around: int) -> str:
    a, z = f"greatest(start_line - {around}, 1)", f"(end_line + {around})"
    return texts._WITH + f""", sy as (select distinct {guid_sql('file_id')} file_id, name, start_line, end_line from file_symbols where {guid_sql('file_id')} is not null and start_line > 0 and end_line >= start_line),
      fl as (select distinct {guid_sql('id')} file_id, {guid_sql('snapshot_id')} snapshot_id, normalized_path path from files), lc as (select snapshot_id, path, string_split(content, chr(10)) ls from ct)
      select snapshot_id, path, name, {a}::int as start_line, least({z}, len(ls))::int as end_line, md5(array_to_string(ls[{a} : {z}], chr(10))) as text_md5 from sy join fl using (file_id) join lc using (snapshot_id, path) where {a} <= len(ls)"""


SQL = {
    "file_types": _F + f" select case when size = 0 then 'empty' when {lookups._EXT} in {lookups._in(CERTIFICATES)} then 'certificate' when coalesce(is_binary, false) or {lookups._EXT} in {lookups._in(BINARIES)} then 'binary' {_KIND} else 'other' end as kind, count(*) as files from f where normalized_path is not null group by 1",
    "ignore_rules": _F + f", l as (select snapshot_id, {_LAST} k from f where normalized_path is not null) select snapshot_id, count(*) filter (k < 0 or k in {_BACK}) as kept, count(*) filter (k >= 0 and k not in {_BACK}) as ignored from l group by 1",
    "recall_path": texts._WITH + f", tp as (select distinct task_text, lower(replace(path, chr(92), '/')) asked from (select task_text, unnest(regexp_extract_all(task_text, '(?:[A-Za-z0-9_\\-]+[/\\\\])+[A-Za-z0-9_\\-]+\\.[A-Za-z]{{1,10}}')) path from tasks)), ac as (select distinct {guid_sql('snapshot_id')} snapshot_id, normalized_path from files) select distinct task_text, snapshot_id, normalized_path from ac join tp on {_NAME.format(c='normalized_path')} = {_NAME.format(c='asked')} and ends_with(lower(normalized_path), asked)",
    "recall_filename": texts._WITH + f", ac as (select distinct {guid_sql('snapshot_id')} snapshot_id, normalized_path from files where normalized_path is not null and {guid_sql('snapshot_id')} in (select {guid_sql('id')} from index_snapshots where status in {lookups._in(ACTIVE)})), wd as (select distinct snapshot_id, normalized_path, unnest(regexp_split_to_array(lower(regexp_replace(normalized_path, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) keyword from ac) select snapshot_id, normalized_path, count(*) as keywords, sum(tasks)::bigint as task_hits from wd join (select keyword, count(*) tasks from kw group by 1) using (keyword) group by 1, 2",
    "recall_fallback": _F + f", g as (select snapshot_id, normalized_path, min(size) size from f where normalized_path is not null and size is not null group by 1, 2), e as (select * from g where {lookups._BASE} in {lookups._in(ENTRY_POINTS)}) select * from (select snapshot_id, normalized_path, row_number() over (partition by snapshot_id order by normalized_path)::int as place from e) where place <= 10 union all select * from (select snapshot_id, normalized_path, row_number() over (partition by snapshot_id order by size, normalized_path)::int as place from g where snapshot_id not in (select snapshot_id from e)) where place <= 5",
    "file_outline": f"select file_id, name, kind, start_line, row_number() over (partition by file_id order by start_line, name, kind)::int as place from (select distinct {guid_sql('file_id')} file_id, name, kind, start_line from file_symbols where {guid_sql('file_id')} is not null)",
    "repomap_tree": _F + f", g as (select snapshot_id, {_PATH} path, max(size) size from f where normalized_path is not null group by 1, 2), p as (select snapshot_id, size, string_split(path, '/') s from g), d as (select snapshot_id, size, array_to_string(s[1 : k], '/') dir from (select snapshot_id, size, s, unnest(range(1, len(s))) k from p where len(s) > 1)) select snapshot_id, dir, files, bytes, round(files / n, 4) as share from (select snapshot_id, dir, count(*) files, sum(size)::bigint bytes from d group by 1, 2) join (select snapshot_id, count(*) n from g group by 1) using (snapshot_id)",
    "payload_ranges": _range_sql(0),
    "expand_symbol": _range_sql(AROUND),
    "stale_gate": _P + f", sn as (select distinct {guid_sql('id')} index_snapshot_id, {guid_sql('workspace_id')} w, status, created_at, workspace_fingerprint from index_snapshots), cur as (select w, workspace_fingerprint current from (select *, row_number() over (partition by w order by created_at desc, index_snapshot_id desc) k from sn where status in {lookups._in(ACTIVE)}) where k = 1), own as (select index_snapshot_id, max(workspace_fingerprint) made_from from sn group by 1) select workspace_id, count(*) filter (coalesce(made_from = current, true)) as fresh, count(*) filter (not coalesce(made_from = current, true)) as stale from p left join own using (index_snapshot_id) left join cur on w = workspace_id group by 1",
    "cache_validity": _P + f", sn as (select {guid_sql('id')} index_snapshot_id, max(status) status from index_snapshots group by 1) select case when coalesce(status = 'Superseded', false) then 'replaced' when created_at < (select max(created_at) from p) - interval {VALID_DAYS} days then 'expired' else 'valid' end as state, count(*) as packages from p left join sn using (index_snapshot_id) group by 1",
    "cache_invalidate": _P + f" select workspace_id, count(*) as packages from p where index_snapshot_id is null or index_snapshot_id not in (select {guid_sql('id')} from index_snapshots where status in ('Failed', 'Cancelled')) group by 1",
    "rank_reasons": _P + " select package_id, path, mode, score, concat_ws('; ', case when score >= 0.8 then 'strong match' when score >= 0.5 then 'match' else 'weak match' end, case when mode = 'Full' then 'whole file' else 'shown as ' || lower(mode) end) as reason from pj",
    "explain": f"select {guid_sql('id')} as package_id, selected_file_count, excluded_count, round(actual_estimate / greatest(context_target, 1), 4) as used, excluded_count > selected_file_count and actual_estimate < context_target / 2 as likely_missed from (select distinct * from context_packages)",
    "revision": _P + f", ch as (select package_id, parent_id from (select {guid_sql('id')} package_id, {guid_sql('parent_package_id')} parent_id, row_number() over (partition by {guid_sql('id')} order by created_at desc, actual_estimate desc nulls last, selected_file_count desc nulls last, excluded_count desc nulls last, task_text desc nulls last, parent_package_id desc nulls last) k from context_packages) where k = 1 and parent_id is not null) select ch.package_id, parent_id, a.actual_estimate - b.actual_estimate as added_tokens, a.selected_file_count - b.selected_file_count as added_files from ch join p a on a.package_id = ch.package_id join p b on b.package_id = parent_id",
    "feedback_pivot": _P + " select model, count(*) filter (tests_passed) as passed, count(*) filter (not tests_passed) as failed, count(*) filter (tests_passed is null) as unknown from fb group by 1",
    "prompt_assembly": _P + " select package_id, md5('# Task' || chr(10) || coalesce(task_text, '') || chr(10) || '# Files' || chr(10) || f) as prompt_md5 from p join (select package_id, string_agg('- ' || path || ' (' || mode || ')', chr(10) order by score desc, path, mode) f from pj group by 1) using (package_id)",
    "workspace_list": f"select root_path_hash, workspace_id, name, status, updated_at, coalesce(snapshots, 0) as snapshots from (select root_path_hash, {guid_sql('id')} workspace_id, name, status, updated_at, row_number() over (partition by root_path_hash order by updated_at desc, id desc) k from (select distinct * from workspaces)) left join (select {guid_sql('workspace_id')} workspace_id, count(distinct {guid_sql('id')}) snapshots from index_snapshots group by 1) using (workspace_id) where k = 1",
}
