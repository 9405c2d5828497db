"""Lookups in indexed snapshots: files, symbols and imports by name and path, for whole tables of requests at once, and the recall of files for tasks. Requests are the identifiers that stand in the tasks of the packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import guid, guid_sql, table
from tessera.functions.paths import base_name, extension, folder
from tessera.sources.index import files, imports, symbols

UNUSABLE_HASHES = ("", "pending", "sha256:pending")
ACTIVE = ("Active", "ActiveDegraded")
# Names and extensions of files that are never shown, suffixes and folders of tests, and names of configuration files.
SENSITIVE = (".env", ".env.local", ".env.production", ".env.staging", "id_rsa", "id_ed25519", "id_ecdsa", "credentials.json", "service-account.json", "secrets.yaml", "secrets.yml", "secrets.json", "keystore", "keystore.jks")
SENSITIVE_EXTENSIONS = ("pem", "key", "p12", "pfx", "crt", "cer", "der", "mobileprovision")
TEST_FILE = r"(\.test\.|\.spec\.|_test\.|tests?\.|_spec\.)[a-z]+$|(^|/)(tests?|__tests__|specs?)/"
TEST_SUFFIX = r"(?i)(\.test|\.spec|_test|test|_spec)$"
CONFIG = (
    "appsettings.json", "appsettings.development.json", "appsettings.production.json", ".env", "config.json", "config.yaml", "config.yml", "config.toml", "package.json", "tsconfig.json", "webpack.config.js",
    "vite.config.ts", ".editorconfig", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "makefile", "cmakelists.txt", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "directory.build.props", "global.json",
)
BASELINE_OUT = (
    ".env", ".env.local", ".env.production", ".env.development", "id_rsa", "id_ed25519", ".npmrc", ".netrc", "secrets.json", "secrets.yaml", "secrets.yml", "credentials.json", "credentials.yaml", "credentials.yml",
    "credential.json", "credential.yaml", "credential.yml", "apikey.txt", "api_keys.json", "api-keys.json", ".htpasswd", ".git-credentials", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
)
BASELINE_OUT_EXTENSIONS = (
    "pem key pfx p12 crt pub jks keystore dll so dylib exe pdb pyd a lib png jpg jpeg gif svg webp ico bmp ttf otf woff woff2 eot zip gz tar 7z rar jar war parquet db sqlite".split()
)
CAMEL = "^([A-Z][a-z]+([A-Z][a-z]+)+|[a-z]+([A-Z][a-z]+)+)$"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(snapshot_id, symbol): identifiers in the task texts, their first letter as a capital, to be looked up in every snapshot of the package's workspace."""
    words = F.explode(F.regexp_extract_all("task_text", F.lit("[A-Za-z]+"), F.lit(0)))
    asked = table(spark, sf, "context_packages").select(guid("workspace_id").alias("w"), words.alias("word")).where(F.col("word").rlike(CAMEL)).select("w", F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")).alias("symbol")).distinct()
    snaps = table(spark, sf, "index_snapshots").select(guid("workspace_id").alias("w"), guid("id").alias("snapshot_id")).distinct()
    return asked.join(snaps, "w").select("snapshot_id", "symbol").distinct()


def files_by_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The files of each snapshot as the index reports them, nulls as their defaults."""
    return files(spark, sf).select("snapshot_id", "normalized_path", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("language", F.lit("unknown")).alias("language"), "content_hash", "mtime", "hash_kind", "parser_id", "parser_version")


def hash_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The least known content hash of each path of a snapshot; none if all are unknown."""
    known = F.when(~F.col("content_hash").isin(*UNUSABLE_HASHES), F.col("content_hash"))
    return files(spark, sf).groupBy("snapshot_id", "normalized_path").agg(F.min(known).alias("content_hash"))


def symbol_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of the requested identifiers in their snapshots."""
    hits = symbols(spark, sf).join(requests(spark, sf).withColumnRenamed("symbol", "name"), ["snapshot_id", "name"])
    return hits.join(files(spark, sf).select("file_id", "normalized_path"), "file_id").select("snapshot_id", "name", "kind", "start_line", "end_line", "normalized_path")


def _like(spark: SparkSession, sf: str, wanted: DataFrame) -> DataFrame:
    """Symbols whose name holds the requested identifier in any case, within the snapshot. Names are parted into their distinct words, so that each request meets the names that share its first word only."""
    first = F.regexp_extract(F.lower(F.regexp_replace("symbol", "([a-z])([A-Z])", "$1 $2")), "^([a-z]+)", 1)
    parts = F.array_distinct(F.split(F.lower(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"))
    asked = wanted.withColumn("w", first)
    names = symbols(spark, sf).select("*", F.explode(parts).alias("w")).where("w != ''")
    return names.join(asked, ["snapshot_id", "w"]).where(F.contains(F.lower("name"), F.lower("symbol"))).drop("w").distinct()


def symbol_like(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that hold a requested identifier as whole words, in any case."""
    return _like(spark, sf, requests(spark, sf)).join(files(spark, sf).select("file_id", "normalized_path"), "file_id").select("snapshot_id", "symbol", "name", "kind", "start_line", "end_line", "normalized_path")


def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    """Exact definitions of each requested identifier, and only where there are none those that hold it."""
    wanted = requests(spark, sf)
    exact = symbols(spark, sf).join(wanted.withColumn("name", F.col("symbol")), ["snapshot_id", "name"])
    held = exact.join(files(spark, sf).select("file_id", "normalized_path"), "file_id")
    near = _like(spark, sf, wanted.join(held.select("snapshot_id", "symbol").distinct(), ["snapshot_id", "symbol"], "left_anti")).join(files(spark, sf).select("file_id", "normalized_path"), "file_id")
    columns = ["snapshot_id", "symbol", "name", "kind", "start_line", "end_line", "normalized_path"]
    return held.select(*columns, F.lit(True).alias("exact_match")).unionByName(near.select(*columns, F.lit(False).alias("exact_match")))


def file_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of each file."""
    return symbols(spark, sf).drop("snapshot_id").join(files(spark, sf).select("file_id", "snapshot_id", "normalized_path"), "file_id").select("snapshot_id", "normalized_path", "name", "kind", "start_line", "end_line")


def file_imports(spark: SparkSession, sf: str) -> DataFrame:
    """The imports of each file."""
    return imports(spark, sf).drop("snapshot_id").join(files(spark, sf).select("file_id", "snapshot_id", "normalized_path"), "file_id").select("snapshot_id", "normalized_path", "module", "imported_name", "line")


def importers(spark: SparkSession, sf: str) -> DataFrame:
    """Files that import a requested identifier, by name or as a word of the module's path."""
    i = imports(spark, sf).where("file_id is not null")
    named = i.select("snapshot_id", "file_id", F.col("imported_name").alias("symbol")).unionByName(i.select("snapshot_id", "file_id", F.explode(F.split("module", "[^A-Za-z]+")).alias("symbol"))).distinct()
    hits = named.join(requests(spark, sf), ["snapshot_id", "symbol"])
    return hits.join(files(spark, sf).select("file_id", "normalized_path"), "file_id").select("snapshot_id", "symbol", "normalized_path").distinct()


def active_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of each workspace's active snapshots."""
    snaps = table(spark, sf, "index_snapshots").where(F.col("status").isin(*ACTIVE)).select(guid("id").alias("snapshot_id"), guid("workspace_id").alias("workspace_id")).distinct()
    return files(spark, sf).join(snaps, "snapshot_id").select("workspace_id", "snapshot_id", "normalized_path", "size", "mtime", "content_hash")


def sensitive_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are kept out of every package for their name or extension."""
    path = F.col("normalized_path")
    return files(spark, sf).where(base_name(path).isin(*SENSITIVE) | extension(path).isin(*SENSITIVE_EXTENSIONS)).select("file_id", "normalized_path")


def path_traversal(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as delivered, with whether they climb out of their root, escapes decoded."""
    plain = F.regexp_replace(F.regexp_replace("path", "(?i)%2e", "."), "(?i)%2f", "/")
    return table(spark, sf, "files").where("path is not null").select("path", F.array_contains(F.split(plain, "[/\\\\]"), "..").alias("climbs")).groupBy("climbs").agg(F.countDistinct("path").alias("paths"))


def baseline_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and files of each snapshot that a reader without an index would be given."""
    path = F.col("normalized_path")
    out = base_name(path).isin(*BASELINE_OUT) | extension(path).isin(*BASELINE_OUT_EXTENSIONS) | base_name(path).rlike("\\.min\\.(js|css)$")
    return files(spark, sf).where("normalized_path is not null").where(~out).groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    """(snapshot_id, normalized_path) of the files that define a requested identifier."""
    return symbol_exact(spark, sf).select("snapshot_id", "normalized_path").distinct()


def recall_repomap(spark: SparkSession, sf: str) -> DataFrame:
    """Files beside those that a task's identifiers lead to, which are left out themselves."""
    hit = _matched(spark, sf)
    every = files(spark, sf).where("normalized_path is not null").select("snapshot_id", "normalized_path").distinct()
    near = every.withColumn("dir", folder(F.col("normalized_path"))).join(hit.select("snapshot_id", folder(F.col("normalized_path")).alias("dir")).distinct(), ["snapshot_id", "dir"], "left_semi").drop("dir")
    return near.join(hit, ["snapshot_id", "normalized_path"], "left_anti").select("snapshot_id", "normalized_path", F.lit(0.3).alias("confidence"))


def recall_config(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration files in the folders of matched files, above them or below them."""
    hit = _matched(spark, sf)
    dirs = hit.select("snapshot_id", F.lower(folder(F.col("normalized_path"))).alias("d")).where("d != ''").distinct()
    conf = files(spark, sf).where(base_name(F.col("normalized_path")).isin(*CONFIG)).select("snapshot_id", "normalized_path").distinct().join(hit, ["snapshot_id", "normalized_path"], "left_anti").withColumn("dir", F.lower(folder(F.col("normalized_path"))))
    near = conf.join(dirs, "snapshot_id").where(F.startswith("dir", "d") | F.startswith("d", "dir"))
    return near.select("snapshot_id", "normalized_path", F.lit(0.5).alias("confidence")).distinct()


def recall_test(spark: SparkSession, sf: str) -> DataFrame:
    """Test files whose name without its test suffix is that of a matched file."""
    stem = F.regexp_replace(base_name(F.col("normalized_path")), "\\.[^.]*$", "")
    hit = _matched(spark, sf)
    tests = files(spark, sf).where(F.lower("normalized_path").rlike(TEST_FILE)).select("snapshot_id", "normalized_path").distinct().join(hit, ["snapshot_id", "normalized_path"], "left_anti").withColumn("stem", F.regexp_replace(stem, TEST_SUFFIX, ""))
    return tests.join(hit.select("snapshot_id", stem.alias("stem")).distinct(), ["snapshot_id", "stem"], "left_semi").select("snapshot_id", "normalized_path", F.lit(0.6).alias("confidence"))


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Each active snapshot's index against the listing of the newest one before it in its workspace: added, modified, deleted and unchanged paths. Sizes decide, then times, then known hashes."""
    s = table(spark, sf, "index_snapshots").select(guid("id").alias("snapshot_id"), guid("workspace_id").alias("w"), "status", "created_at").distinct()
    before = F.lag("snapshot_id").over(Window.partitionBy("w").orderBy("created_at", "snapshot_id"))
    pairs = s.where("w is not null").withColumn("previous_id", before).where(F.col("status").isin(*ACTIVE) & F.col("previous_id").isNotNull()).select("snapshot_id", "previous_id")
    known = F.when(~F.col("content_hash").isin(*UNUSABLE_HASHES), F.col("content_hash"))
    one = files(spark, sf).where("normalized_path is not null").groupBy("snapshot_id", "normalized_path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"), F.max(known).alias("hash"))
    disk = one.join(pairs.select("snapshot_id"), "snapshot_id", "left_semi").withColumn("on_disk", F.lit(True))
    index = one.withColumnRenamed("snapshot_id", "previous_id").join(pairs, "previous_id").select("snapshot_id", "normalized_path", F.col("size").alias("size0"), F.col("mtime").alias("mtime0"), F.col("hash").alias("hash0"), F.lit(True).alias("in_index"))
    both = disk.join(index, ["snapshot_id", "normalized_path"], "full")
    change = F.when(F.col("in_index").isNull(), "added").when(F.col("on_disk").isNull(), "deleted").when(~F.col("size").eqNullSafe(F.col("size0")) | (F.col("mtime") != F.col("mtime0")) | (F.col("hash") != F.col("hash0")), "modified").otherwise("unchanged")
    return both.select("snapshot_id", change.alias("change")).groupBy("snapshot_id", "change").agg(F.count("*").alias("paths"))


def snapshot_clone(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of active snapshots under the ids of a clone; those of files that are not there are dropped."""
    snaps = table(spark, sf, "index_snapshots").where(F.col("status").isin(*ACTIVE)).select(guid("id").alias("snapshot_id")).distinct()
    new = lambda c: F.md5(F.concat(F.lit("clone "), c))
    kept = files(spark, sf).join(snaps, "snapshot_id", "left_semi").select("file_id", new(F.col("snapshot_id")).alias("snapshot_id")).distinct()
    return symbols(spark, sf).drop("snapshot_id").join(kept, "file_id").select(new(F.col("file_id")).alias("file_id"), "snapshot_id", "name", "kind", "start_line", "end_line")


def orphan_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback that stays when that of missing packages is removed, per model."""
    packages = table(spark, sf, "context_packages").select(guid("id").alias("k")).distinct()
    kept = table(spark, sf, "context_feedback").distinct().withColumn("k", guid("context_package_id")).join(packages, "k", "left_semi")
    return kept.groupBy("model").agg(F.count("*").alias("rows"))


def payload_hash_check(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed contents whose stored hash, if it is a whole SHA-256, is not theirs; per snapshot, with those that were compared."""
    rows = table(spark, sf, "file_contents_fts").where("content is not null").select(guid("snapshot_id").alias("snapshot_id"), F.lower(F.trim("content_hash")).alias("h"), "content").where(F.col("h").rlike("^sha256:[0-9a-f]{64}$"))
    return rows.groupBy("snapshot_id").agg(F.count("*").alias("compared"), F.count_if(F.col("h") != F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("different"))


def snapshot_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status, commit and branch of each snapshot, with whether it counts as current: the newest active one of its workspace."""
    s = table(spark, sf, "index_snapshots").distinct().select(guid("id").alias("snapshot_id"), guid("workspace_id").alias("workspace_id"), "status", "repository_commit", "branch", "is_dirty", "created_at")
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy((~F.col("status").isin(*ACTIVE)).cast("int"), F.col("created_at").desc(), "snapshot_id"))
    return s.select("snapshot_id", "status", "repository_commit", "branch", "is_dirty", (F.col("status").isin(*ACTIVE) & (place == 1)).alias("current"))


def snapshot_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table that stay when failed and cancelled snapshots are deleted with all that belongs to them."""
    gone = table(spark, sf, "index_snapshots").where(F.col("status").isin("Failed", "Cancelled")).select(guid("id").alias("snapshot_id")).distinct()
    of = lambda name: table(spark, sf, name).select(guid("snapshot_id").alias("snapshot_id")).join(gone, "snapshot_id", "left_anti").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
    return of("files").unionByName(of("file_symbols")).unionByName(of("file_imports"))


QUERIES = {
    f.__name__: f
    for f in (
        files_by_snapshot, hash_resolve, symbol_exact, symbol_like, symbol_search, file_symbols, file_imports, importers, active_files, sensitive_files, path_traversal, baseline_files, recall_repomap, recall_config,
        recall_test, reconcile, snapshot_clone, orphan_cleanup, payload_hash_check, snapshot_status, snapshot_cascade,
    )
}


def _in(values: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_G = guid_sql
_BASE = "lower(regexp_extract(normalized_path, '([^/\\\\]*)$', 1))"
_EXT = f"regexp_extract({_BASE}, '\\.([^.]*)$', 1)"
_FOLDER = "regexp_replace(normalized_path, '/?[^/]*$', '')"
_HASH = f"case when content_hash in {_in(UNUSABLE_HASHES)} then null else content_hash end"
_WITH = f"""with f as (select distinct {_G('id')} file_id, {_G('snapshot_id')} snapshot_id, normalized_path, size, language, content_hash, mtime, hash_kind, parser_id, parser_version, status, is_binary from files),
s as (select distinct {_G('file_id')} file_id, {_G('snapshot_id')} snapshot_id, name, kind, start_line, end_line from file_symbols),
i as (select distinct {_G('file_id')} file_id, {_G('snapshot_id')} snapshot_id, module, imported_name, line from file_imports),
r as (select distinct sn.snapshot_id, upper(word[1]) || substr(word, 2) symbol from (select {_G('workspace_id')} w, unnest(regexp_extract_all(task_text, '[A-Za-z]+')) word from context_packages) p join (select distinct {_G('workspace_id')} w, {_G('id')} snapshot_id from index_snapshots) sn on sn.w = p.w where regexp_matches(word, '{CAMEL}')),
sx as (select s.snapshot_id, r.symbol, s.name, s.kind, s.start_line, s.end_line, f.normalized_path from s join r on r.snapshot_id = s.snapshot_id and r.symbol = s.name join f on f.file_id = s.file_id),
sl as (select distinct s.*, r.symbol from s join r on r.snapshot_id = s.snapshot_id where contains(lower(s.name), lower(r.symbol))
  and list_contains(regexp_split_to_array(lower(regexp_replace(s.name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+'), regexp_extract(lower(regexp_replace(r.symbol, '([a-z])([A-Z])', '\\1 \\2', 'g')), '^([a-z]+)', 1))),
hit as (select distinct snapshot_id, normalized_path from sx),
act as (select distinct {_G('id')} snapshot_id, {_G('workspace_id')} workspace_id from index_snapshots where status in {_in(ACTIVE)})"""
_STEM = f"regexp_replace({_BASE}, '\\.[^.]*$', '')"

SQL = {
    "files_by_snapshot": _WITH + " select snapshot_id, normalized_path, coalesce(size, 0) as size, coalesce(language, 'unknown') as language, content_hash, mtime, hash_kind, parser_id, parser_version from f",
    "hash_resolve": _WITH + f" select snapshot_id, normalized_path, min({_HASH}) as content_hash from f group by 1, 2",
    "symbol_exact": _WITH + " select snapshot_id, name, kind, start_line, end_line, normalized_path from sx",
    "symbol_like": _WITH + " select sl.snapshot_id, symbol, name, kind, start_line, end_line, f.normalized_path from sl join f using (file_id)",
    "symbol_search": _WITH + " select snapshot_id, symbol, name, kind, start_line, end_line, normalized_path, true as exact_match from sx union all select sl.snapshot_id, symbol, name, kind, start_line, end_line, f.normalized_path, false from sl join f using (file_id) where (sl.snapshot_id, symbol) not in (select snapshot_id, symbol from sx)",
    "file_symbols": _WITH + " select f.snapshot_id, normalized_path, name, kind, start_line, end_line from (select distinct file_id, name, kind, start_line, end_line, snapshot_id as own from s) join f using (file_id)",
    "file_imports": _WITH + " select f.snapshot_id, normalized_path, module, imported_name, line from i join f using (file_id)",
    "importers": _WITH + ", n as (select distinct snapshot_id, file_id, imported_name symbol from i union select snapshot_id, file_id, unnest(regexp_split_to_array(module, '[^A-Za-z]+')) from i) select distinct n.snapshot_id, symbol, normalized_path from n join r using (snapshot_id, symbol) join f using (file_id)",
    "active_files": _WITH + " select workspace_id, f.snapshot_id, normalized_path, size, mtime, content_hash from f join act using (snapshot_id)",
    "sensitive_files": _WITH + f" select file_id, normalized_path from f where {_BASE} in {_in(SENSITIVE)} or {_EXT} in {_in(SENSITIVE_EXTENSIONS)}",
    "path_traversal": "select climbs, count(*) as paths from (select distinct path, list_contains(regexp_split_to_array(regexp_replace(regexp_replace(path, '(?i)%2e', '.', 'g'), '(?i)%2f', '/', 'g'), '[/\\\\]'), '..') as climbs from files where path is not null) group by 1",
    "baseline_files": _WITH + f" select snapshot_id, count(*) as files, sum(size)::bigint as bytes from f where normalized_path is not null and not ({_BASE} in {_in(BASELINE_OUT)} or {_EXT} in {_in(BASELINE_OUT_EXTENSIONS)} or regexp_matches({_BASE}, '\\.min\\.(js|css)$')) group by 1",
    "recall_repomap": _WITH + f" select distinct snapshot_id, normalized_path, 0.3::double as confidence from f where (snapshot_id, {_FOLDER}) in (select snapshot_id, {_FOLDER} from hit) and (snapshot_id, normalized_path) not in (select snapshot_id, normalized_path from hit)",
    "recall_config": _WITH + f", d as (select distinct snapshot_id, lower({_FOLDER}) d from hit where {_FOLDER} <> ''), c as (select distinct snapshot_id, normalized_path, lower({_FOLDER}) dir from f where {_BASE} in {_in(CONFIG)} and (snapshot_id, normalized_path) not in (select snapshot_id, normalized_path from hit)) select distinct c.snapshot_id, normalized_path, 0.5::double as confidence from c join d on d.snapshot_id = c.snapshot_id and (starts_with(dir, d) or starts_with(d, dir))",
    "recall_test": _WITH + f" select distinct snapshot_id, normalized_path, 0.6::double as confidence from f where regexp_matches(lower(normalized_path), '{TEST_FILE}') and (snapshot_id, normalized_path) not in (select snapshot_id, normalized_path from hit) and (snapshot_id, regexp_replace({_STEM}, '{TEST_SUFFIX}', '')) in (select snapshot_id, {_STEM} from hit)",
    "reconcile": _WITH + f""", sn as (select distinct {_G('id')} snapshot_id, {_G('workspace_id')} w, status, created_at from index_snapshots),
      pairs as (select snapshot_id, previous_id from (select *, lag(snapshot_id) over (partition by w order by created_at, snapshot_id) previous_id from sn where w is not null) where status in {_in(ACTIVE)} and previous_id is not null),
      one as (select snapshot_id, normalized_path, max(size) size, max(mtime) mtime, max({_HASH}) h from f where normalized_path is not null group by 1, 2),
      a as (select one.* from one join pairs using (snapshot_id)), b as (select pairs.snapshot_id, normalized_path, size, mtime, h from one join pairs on one.snapshot_id = previous_id)
      select coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, case when b.normalized_path is null then 'added' when a.normalized_path is null then 'deleted' when a.size is distinct from b.size or a.mtime <> b.mtime or a.h <> b.h then 'modified' else 'unchanged' end as change, count(*) as paths
      from a full join b on a.snapshot_id = b.snapshot_id and a.normalized_path = b.normalized_path group by 1, 2""",
    "snapshot_clone": _WITH + ", k as (select distinct file_id, md5('clone ' || snapshot_id) snapshot_id from f where snapshot_id in (select snapshot_id from act)) select md5('clone ' || s.file_id) as file_id, k.snapshot_id, name, kind, start_line, end_line from s join k using (file_id)",
    "orphan_cleanup": f"select model, count(*) as rows from (select distinct * from context_feedback) where {_G('context_package_id')} in (select {_G('id')} from context_packages where {_G('id')} is not null) group by 1",
    "payload_hash_check": f"select snapshot_id, count(*) as compared, count(*) filter (h <> 'sha256:' || sha256(content)) as different from (select {_G('snapshot_id')} snapshot_id, lower(trim(content_hash)) h, content from file_contents_fts where content is not null) where regexp_matches(h, '^sha256:[0-9a-f]{{64}}$') group by 1",
    "snapshot_status": f"select snapshot_id, status, repository_commit, branch, is_dirty, status in {_in(ACTIVE)} and row_number() over (partition by workspace_id order by (status not in {_in(ACTIVE)})::int, created_at desc, snapshot_id) = 1 as current from (select distinct * replace ({_G('id')} as id, {_G('workspace_id')} as workspace_id) from index_snapshots) t(snapshot_id, workspace_id, status, file_count, created_at, completed_at, repository_commit, branch, is_dirty, workspace_fingerprint)",
    "snapshot_cascade": f"with gone as (select {_G('id')} k from index_snapshots where status in ('Failed', 'Cancelled')) " + " union all ".join(f"select '{t}' as table_name, count(*) as rows from {t} where coalesce({_G('snapshot_id')}, '') not in (select k from gone where k is not null)" for t in ("files", "file_symbols", "file_imports")),
}
