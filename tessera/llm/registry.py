"""Registered queries of the operators on text for language models, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import Stage, guid, table
from tessera.llm import handwritten
from tessera.llm.credentials import credentials, redacted
from tessera.llm.leaks import leaks
from tessera.llm.mixing import mixed, vocabulary
from tessera.llm.token_slices import ALIASES, CODE_TOKEN, nothing, refreshed, token_slices
from tessera.llm.truncated import truncated


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_contents_fts").select("snapshot_id", "path", "content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_reasons(spark, sf).select("id")


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The files nobody wrote by hand, each with the rule that tells."""
    files = table(spark, sf, "files").select("id", guid("snapshot_id").alias("snapshot_id"), F.coalesce("normalized_path", "path").alias("path"), "content_hash", "size", "is_binary")
    texts = table(spark, sf, "file_contents_fts").select(guid("snapshot_id").alias("snapshot_id"), F.coalesce("normalized_path", "path").alias("path"), "content_hash", "content")
    return handwritten.not_handwritten(files, texts)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials(_texts(spark, sf)).select("snapshot_id", "path", "line_no").distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The indexed texts with their credentials masked."""
    files = _texts(spark, sf)
    return redacted(files, credentials(files))


def _slices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    snaps = table(spark, sf, "index_snapshots").select(guid("id").alias("snapshot_id"), guid("workspace_id").alias("workspace_id"), "created_at")
    files = table(spark, sf, "file_contents_fts").select(guid("snapshot_id").alias("snapshot_id"), "normalized_path", "language", "content")
    return files, snaps


def p4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens of the indexed files per workspace and language."""
    return token_slices(*_slices(spark, sf))


def p4_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of each workspace's newest indexed snapshot, kept up to date from a count of all older ones: what went takes its tokens away."""
    files, snaps = _slices(spark, sf)
    held = files.select("snapshot_id").distinct().join(snaps, "snapshot_id").groupBy("workspace_id").agg(F.max(F.struct("created_at", "snapshot_id")).alias("last")).select(F.col("last.snapshot_id").alias("snapshot_id"))
    st = Stage(spark, "tokens")
    before = refreshed(nothing(spark), files.join(held, "snapshot_id", "left_anti"), snaps, st)
    return refreshed(before, files.join(held, "snapshot_id", "left_semi"), snaps, st).cube


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_shares(spark, sf).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that give away evaluation items, with the share of the item."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark_tasks"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """The items that leaked, and in how many documents."""
    return p7_shares(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used to reach the target shares."""
    return mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), vocabulary())[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), vocabulary())[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "documents")).where("cut").select("doc_id")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each source's texts that are cut; sources compare trimmed and without case."""
    return truncated(table(spark, sf, "documents")).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.avg(F.col("cut").cast("double")).alias("cut_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p3_found, p3_redacted, p4_tokens, p4_refreshed, p7_found, p7_shares, p7_report, p8_mix, p8_report, p9_found, p9_report)}


def _guid(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '^\\s+|\\s+$|[{{}}-]', '', 'g'), '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _handwritten_sql() -> str:
    path = "regexp_replace(replace(lower(coalesce(normalized_path, path)), chr(92), '/'), '^(\\./)+', '')"
    known = "nullif(nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), ''), 'pending')"
    rules = " ".join(f"when regexp_matches(path, {_quoted(rule)}) then {_quoted(name)}" for name, rule in handwritten.RULES.items())
    notices = " or ".join(f"contains(lower(l), {_quoted(n)})" for n in handwritten.NOTICES)
    remark = _quoted(r"""^\s*(?://|/\*|\*|#|--|;|%|<!--|\(\*|"|'|REM\b|dnl\b|<\?)""")
    order = ", ".join(_quoted(r) for r in [*handwritten.RULES, "large", "notice"])
    return f"""with f as (select id, {_guid('snapshot_id')} sid, {path} path, {known} h, size from files where id is not null and not coalesce(is_binary, false)),
    big as (select distinct {known} h from files where size >= {handwritten.LARGE}),
    heads as (select sid, path, h, substr(unnest(list_slice(string_split(content, chr(10)), 1, {handwritten.HEAD_LINES})), 1, {handwritten.HEAD_CHARS}) l from (select {_guid('snapshot_id')} sid, {path} path, {known} h, content from file_contents_fts)),
    marked as (select distinct sid, path, h from heads where regexp_matches(l, {remark}) and ({notices})),
    told as (select id, case {rules} when size >= {handwritten.LARGE} then 'large' when size is null and h in (select h from big where h is not null) then 'large'
      when h in (select h from marked where h is not null) or exists (select 1 from marked m where m.sid = f.sid and m.path = f.path) then 'notice' end as reason from f)
    select id, list_extract([{order}], min(list_position([{order}], reason))::int) as reason from told where reason is not null group by id"""


def _tokens_sql(newest: bool) -> str:
    text = "coalesce(content, '')"
    language = "coalesce(lower(trim(language)), '')"
    names = " ".join(f"when {_quoted(a)} then {_quoted(b)}" for a, b in ALIASES.items())
    of = f"with sn as (select {_guid('id')} sid, max({_guid('workspace_id')}) w, max(created_at) made from index_snapshots group by 1), held as (select sid, w, row_number() over (partition by w order by made desc, sid desc) k from sn where sid in (select {_guid('snapshot_id')} from file_contents_fts))"
    return f"""{of}, f as (select {_guid('snapshot_id')} sid, regexp_replace(replace(normalized_path, chr(92), '/'), '^\\./', '') path, case {language} {names} else {language} end as language,
      len(regexp_extract_all({text}, {_quoted(CODE_TOKEN)})) + ceil(length(regexp_replace({text}, {_quoted(CODE_TOKEN)}, '', 'g')) / 4)::bigint as tokens from file_contents_fts),
    one as (select sid, path, max({{'tokens': tokens, 'language': language}}) v from f group by 1, 2)
    select w as workspace_id, v.language as language, count(*) as files, sum(v.tokens)::bigint as tokens from one left join sn using (sid) {"where sid in (select sid from held where k = 1)" if newest else ""} group by 1, 2"""


SQL: dict[str, str] = {"p4_tokens": _tokens_sql(False), "p4_refreshed": _tokens_sql(True), "p2_reasons": _handwritten_sql(), "p2_found": f"select id from ({_handwritten_sql()})"}
