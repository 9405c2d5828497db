"""Packages, feedback, telemetry and the measures taken from them. Telemetry is the events table: a view was answered from the cache, ``value`` is the latency and ``k`` of the properties the prompt's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import guid, guid_sql, table
from tessera.sources.index import feedback, packages

#: Rows that a list shows.
LISTED = 20
#: Millionths of a currency unit for a token read and written.
PRICE_IN, PRICE_OUT = 3, 15
# The gate's thresholds.
GATE_SUCCESS, GATE_MISSING, GATE_POSITIVE = 0.95, 0.10, 0.60


def _rate(condition: Column) -> Column:
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 4)


def packages_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest packages of each workspace."""
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("created_at").desc(), "package_id"))
    return packages(spark, sf).select("workspace_id", "package_id", "task_text", "created_at", place.alias("place")).where(F.col("place") <= LISTED)


def feedback_by_workspace(spark: SparkSession, sf: str) -> DataFrame:
    """The newest feedback on each workspace's packages."""
    rows = feedback(spark, sf).join(packages(spark, sf).select("package_id", "workspace_id"), "package_id")
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("created_at").desc(), "feedback_id"))
    return rows.select("workspace_id", "feedback_id", "package_id", "task_completed", "tests_passed", "created_at", place.alias("place")).where(F.col("place") <= LISTED)


def feedback_by_package(spark: SparkSession, sf: str) -> DataFrame:
    """What was said of each package."""
    return feedback(spark, sf).where("package_id is not null").groupBy("package_id").agg(F.count("*").alias("answers"), F.count_if("task_completed").alias("completed"), F.count_if("missing_context_reported").alias("missing"), F.max("created_at").alias("last_at"))


def workspaces_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "workspaces").distinct().groupBy("status").agg(F.count("*").alias("workspaces"))


def stats_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of each workspace, and the tokens of its newest."""
    p = packages(spark, sf)
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("created_at").desc(), "package_id"))
    listed = p.select("workspace_id", "actual_estimate", place.alias("place")).where(F.col("place") <= LISTED).groupBy("workspace_id").agg(F.sum("actual_estimate").alias("listed_tokens"))
    every = p.groupBy("workspace_id").agg(F.count("*").alias("packages"), F.max("created_at").alias("last_at"))
    return every.join(listed.withColumnRenamed("workspace_id", "w"), F.col("workspace_id").eqNullSafe(F.col("w")), "left").select("workspace_id", "packages", "listed_tokens", "last_at")


def language_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes of each language as stored, over all snapshots."""
    return table(spark, sf, "files").distinct().groupBy(F.coalesce(F.lower(F.trim("language")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    """The key under which a package is found again: its workspace, snapshot, task in lower case and profile."""
    key = F.sha2(F.concat_ws("|", "workspace_id", "index_snapshot_id", F.lower(F.trim("task_text")), "ranking_profile_id", F.col("ranking_profile_version").cast("string")), 256)
    return packages(spark, sf).select("package_id", F.substring(key, 1, 16).alias("cache_key"))


def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Of each workspace the packages asked for under a key for the first time and again."""
    keyed = packages(spark, sf).select("package_id", "workspace_id", "actual_estimate").join(cache_key(spark, sf), "package_id")
    per = keyed.groupBy("workspace_id", "cache_key").agg(F.count("*").alias("n"), F.max("actual_estimate").alias("tokens"))
    hits, entries = F.sum(F.col("n") - 1), F.count("*")
    return per.groupBy("workspace_id").agg(entries.alias("entries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), hits.alias("hits"), F.round(hits / (hits + entries), 4).alias("hit_rate"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") == "view").alias("cached"), k.alias("prompt_tokens"))


def _stats() -> list[Column]:
    hit = F.col("cached")
    return [
        F.count("*").alias("total_requests"), F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("cache_misses"), F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum(F.when(hit, F.col("prompt_tokens")).otherwise(0)).alias("cached_tokens_saved"), F.round(F.avg("value"), 4).alias("avg_latency_ms"), F.round(F.count_if(hit) / F.count("*"), 4).alias("cache_hit_rate"),
    ]


def gateway_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, cache hits and tokens over all telemetry."""
    return _calls(spark, sf).agg(*_stats())


def gateway_stats_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(*_stats())


def stats_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of two streams of telemetry, those of errors and the others, added up and the rate taken anew."""
    calls = _calls(spark, sf)
    two = [calls.where(c).agg(F.count("*").alias("n"), F.count_if("cached").alias("hits"), F.sum("prompt_tokens").alias("tokens")) for c in ("event_type = 'error'", "event_type != 'error'")]
    return two[0].unionByName(two[1]).agg(F.sum("n").alias("total_requests"), F.sum("hits").alias("cache_hits"), F.sum("tokens").alias("total_prompt_tokens"), F.round(F.sum("hits") / F.sum("n"), 4).alias("cache_hit_rate"))


def gateway_rows_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry of each kind that a retention of the last seven days keeps."""
    calls = _calls(spark, sf)
    last = calls.agg(F.max("ts").alias("last"))
    return calls.join(last).where(F.col("ts") >= F.col("last") - F.expr("interval 7 days")).groupBy("event_type").agg(F.count("*").alias("rows"))


def request_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What each answered workflow cost; unknown tokens cost nothing."""
    cost = (F.coalesce("total_workflow_input_tokens", F.lit(0)).cast("long") * PRICE_IN + F.coalesce("total_workflow_output_tokens", F.lit(0)).cast("long") * PRICE_OUT) / F.lit(1_000_000.0)
    return feedback(spark, sf).select("feedback_id", "package_id", F.round(cost, 6).alias("cost"))


def budget_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Millionths spent and workflows of each workspace, by day, and those of the month up to that day."""
    cost = F.coalesce("total_workflow_input_tokens", F.lit(0)).cast("long") * PRICE_IN + F.coalesce("total_workflow_output_tokens", F.lit(0)).cast("long") * PRICE_OUT
    rows = feedback(spark, sf).join(packages(spark, sf).select("package_id", "workspace_id"), "package_id")
    daily = rows.groupBy("workspace_id", F.to_date("created_at").alias("day")).agg(F.sum(cost).alias("spent"), F.count("*").alias("workflows"))
    month = Window.partitionBy("workspace_id", F.trunc("day", "month")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("workspace_id", "day", "spent", "workflows", F.sum("spent").over(month).alias("spent_in_month"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return feedback(spark, sf).join(packages(spark, sf).select("package_id", "workspace_id", "task_text", "selected_file_count", "excluded_count", "actual_estimate"), "package_id")


def task_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Means, spread and rates of the answers of each workspace; the spread of a single answer is 0."""
    share = F.col("selected_file_count") / F.greatest(F.col("selected_file_count") + F.col("excluded_count"), F.lit(1))
    return _runs(spark, sf).groupBy("workspace_id").agg(
        F.count("*").alias("runs"), F.round(F.avg(share), 4).alias("mean_selected"), F.round(F.stddev_pop(share), 4).alias("std_selected"), F.round(F.min(share), 4).alias("worst_selected"), _rate(F.col("task_completed")).alias("success_rate"),
        _rate(F.col("missing_context_reported")).alias("missing_rate"), F.round(F.avg("user_intervention_count"), 4).alias("mean_rounds"),
    )


def phase_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the gate's conditions each model fails: success, missing context, and answers below the model's mean cost."""
    per = feedback(spark, sf).groupBy("model").agg(_rate(F.col("task_completed")).alias("success"), _rate(F.col("missing_context_reported")).alias("missing"), _rate(F.col("user_intervention_count") == 0).alias("positive"))
    failed = F.array_compact(F.array(F.when(F.col("success") < GATE_SUCCESS, F.lit("success")), F.when(F.col("missing") > GATE_MISSING, F.lit("missing")), F.when(F.col("positive") < GATE_POSITIVE, F.lit("positive"))))
    return per.select("model", "success", "missing", "positive", F.array_join(failed, ",").alias("failed"))


def failure_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Why workflows failed, by what is known of them: few selected files, many left out, missing context, else the model."""
    share = F.col("selected_file_count") / F.greatest(F.col("selected_file_count") + F.col("excluded_count"), F.lit(1))
    why = F.when(F.col("task_completed"), "None").when(F.col("selected_file_count") == 0, "Retrieval").when(share < 0.3, "Ranking").when(F.col("missing_context_reported"), "Budget").otherwise("ModelRandom")
    return _runs(spark, sf).groupBy(why.alias("cause")).agg(F.count("*").alias("runs"))


def agent_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Workflows of each client: success, tokens and tests; a test that was not run passes nothing."""
    return feedback(spark, sf).groupBy("client_id").agg(F.count("*").alias("runs"), _rate(F.col("task_completed")).alias("success_rate"), F.sum("total_workflow_input_tokens").alias("tokens_in"), F.sum("total_workflow_output_tokens").alias("tokens_out"), _rate(F.col("tests_passed")).alias("pass_rate"))


def token_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that a package saved against reading its whole snapshot, a quarter of the bytes, at least none."""
    whole = table(spark, sf, "files").where("not coalesce(is_binary, false)").distinct().groupBy(guid("snapshot_id").alias("index_snapshot_id")).agg(F.floor(F.sum("size") / 4).alias("whole"))
    return packages(spark, sf).join(whole, "index_snapshot_id").select("package_id", F.greatest(F.col("whole") - F.col("actual_estimate"), F.lit(0)).cast("long").alias("saved"))


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """How far each tokenizer's packages stay within their target and limit."""
    p = table(spark, sf, "context_packages").distinct()
    return p.groupBy("tokenizer").agg(F.count("*").alias("packages"), F.count_if(F.col("actual_estimate") <= F.col("context_target")).alias("within_target"), F.count_if(F.col("actual_estimate") > F.col("context_hard_limit")).alias("over_limit"), F.count_if(F.col("context_target") > F.col("context_hard_limit")).alias("invalid"))


def selected_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files that packages selected, from their stored lists: how often, in which mode, and the best score."""
    rows = packages_json(spark, sf)
    return rows.groupBy("path", "mode").agg(F.count("*").alias("packages"), F.max("score").alias("best_score"))


def packages_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "context_packages").select(guid("id").alias("package_id"), F.explode(F.from_json("selected_files_json", "array<struct<path:string,mode:string,score:double>>")).alias("f")).distinct()
    return rows.select("package_id", "f.path", "f.mode", "f.score")


def rank(spark: SparkSession, sf: str) -> DataFrame:
    """The selected files of each package in order of score, of equal ones by path."""
    place = F.row_number().over(Window.partitionBy("package_id").orderBy(F.col("score").desc(), "path", "mode"))
    return packages_json(spark, sf).select("package_id", "path", "mode", "score", place.alias("place"))


def candidate_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each file of a package, with its modes in order and its best score."""
    return packages_json(spark, sf).groupBy("package_id", "path").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.max("score").alias("score"))


def debounced(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user in each flush of half a second."""
    flush = F.floor(F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 500_000).cast("long")
    return table(spark, sf, "events").groupBy("user_id", flush.alias("flush")).agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("events")).select("user_id", "flush", "last.event_id", "events")


def single_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of one kind and user that came within a minute of the one before, which they would have shared; by kind."""
    last = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    shared = F.col("ts") <= F.col("last") + F.expr("interval 1 minute")
    return table(spark, sf, "events").withColumn("last", last).groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(shared).alias("shared"))


QUERIES = {
    f.__name__: f
    for f in (
        packages_latest, feedback_by_workspace, feedback_by_package, workspaces_by_status, stats_summary, language_breakdown, cache_key, cache_stats, gateway_stats, gateway_stats_daily, stats_merged, gateway_rows_kept,
        request_cost, budget_usage, task_metrics, phase_gate, failure_attribution, agent_summary, token_reduction, token_budget, selected_files, rank, candidate_dedup, debounced, single_flight,
    )
}

_G = guid_sql
_P = f"""with p as (select package_id, {_G('workspace_id')} workspace_id, {_G('index_snapshot_id')} index_snapshot_id, task_text, ranking_profile_id, ranking_profile_version, actual_estimate, selected_file_count, excluded_count, tokenizer, created_at from (
  select {_G('id')} package_id, *, row_number() over (partition by {_G('id')} order by created_at desc, actual_estimate desc nulls last, selected_file_count desc nulls last, excluded_count desc nulls last, task_text desc nulls last) k from context_packages) where k = 1),
fb as (select distinct * rename (id as feedback_id), {_G('context_package_id')} package_id from context_feedback),
runs as (select fb.*, workspace_id, selected_file_count, excluded_count from fb join p using (package_id)),
calls as (select event_id, ts, user_id, event_type, value, event_type = 'view' cached, json_extract_string(props, '$.k')::bigint prompt_tokens from events),
pj as (select distinct package_id, f.path as path, f.mode as mode, f.score as score from (select {_G('id')} package_id, unnest(from_json(selected_files_json, '[{{"path":"VARCHAR","mode":"VARCHAR","score":"DOUBLE"}}]')) f from context_packages))"""
_STATS = "count(*) as total_requests, count(*) filter (cached) as cache_hits, count(*) filter (not cached) as cache_misses, sum(prompt_tokens)::bigint as total_prompt_tokens, sum(case when cached then prompt_tokens else 0 end)::bigint as cached_tokens_saved, round(avg(value), 4) as avg_latency_ms, round(count(*) filter (cached) / count(*), 4) as cache_hit_rate"
_COST = f"(coalesce(total_workflow_input_tokens, 0)::bigint * {PRICE_IN} + coalesce(total_workflow_output_tokens, 0)::bigint * {PRICE_OUT})"
_KEY = "substr(sha256(concat_ws('|', workspace_id, index_snapshot_id, lower(trim(task_text)), ranking_profile_id, ranking_profile_version::varchar)), 1, 16)"
_SHARE = "(selected_file_count / greatest(selected_file_count + excluded_count, 1))"


def _r(c: str) -> str:
    return f"round(avg(case when {c} then 1.0 else 0.0 end), 4)"


SQL = {
    "packages_latest": _P + f" select * from (select workspace_id, package_id, task_text, created_at, row_number() over (partition by workspace_id order by created_at desc, package_id)::int as place from p) where place <= {LISTED}",
    "feedback_by_workspace": _P + f" select * from (select workspace_id, feedback_id, package_id, task_completed, tests_passed, created_at, row_number() over (partition by workspace_id order by created_at desc, feedback_id)::int as place from runs) where place <= {LISTED}",
    "feedback_by_package": _P + " select package_id, count(*) as answers, count(*) filter (task_completed) as completed, count(*) filter (missing_context_reported) as missing, max(created_at) as last_at from fb where package_id is not null group by 1",
    "workspaces_by_status": "select status, count(*) as workspaces from (select distinct * from workspaces) group by 1",
    "stats_summary": _P + f", l as (select *, row_number() over (partition by workspace_id order by created_at desc, package_id) k from p) select workspace_id, count(*) as packages, sum(case when k <= {LISTED} then actual_estimate end)::bigint as listed_tokens, max(created_at) as last_at from l group by 1",
    "language_breakdown": "select coalesce(lower(trim(language)), 'unknown') as language, count(*) as files, sum(size)::bigint as bytes from (select distinct * from files) group by 1",
    "cache_key": _P + f" select package_id, {_KEY} as cache_key from p",
    "cache_stats": _P + f", k as (select workspace_id, {_KEY} as key, count(*) n, max(actual_estimate) tokens from p group by 1, 2) select workspace_id, count(*) as entries, coalesce(sum(tokens), 0)::bigint as tokens, sum(n - 1)::bigint as hits, round(sum(n - 1) / (sum(n - 1) + count(*)), 4) as hit_rate from k group by 1",
    "gateway_stats": _P + f" select {_STATS} from calls",
    "gateway_stats_daily": _P + f" select ts::date as day, {_STATS} from calls group by 1",
    "stats_merged": _P + " select count(*) as total_requests, count(*) filter (cached) as cache_hits, sum(prompt_tokens)::bigint as total_prompt_tokens, round(count(*) filter (cached) / count(*), 4) as cache_hit_rate from calls",
    "gateway_rows_kept": "select event_type, count(*) as rows from events where ts >= (select max(ts) from events) - interval 7 days group by 1",
    "request_cost": _P + f" select feedback_id, package_id, round({_COST} / 1000000.0::double, 6) as cost from fb",
    "budget_usage": _P + f", d as (select workspace_id, created_at::date as day, sum({_COST})::bigint as spent, count(*) as workflows from runs group by 1, 2) select workspace_id, day, spent, workflows, sum(spent) over (partition by workspace_id, date_trunc('month', day) order by day)::bigint as spent_in_month from d",
    "task_metrics": _P + f" select workspace_id, count(*) as runs, round(avg({_SHARE}), 4) as mean_selected, round(stddev_pop({_SHARE}), 4) as std_selected, round(min({_SHARE}), 4) as worst_selected, {_r('task_completed')} as success_rate, {_r('missing_context_reported')} as missing_rate, round(avg(user_intervention_count), 4) as mean_rounds from runs group by 1",
    "phase_gate": _P + f", g as (select model, {_r('task_completed')} as success, {_r('missing_context_reported')} as missing, {_r('user_intervention_count = 0')} as positive from fb group by 1) select model, success, missing, positive, concat_ws(',', case when success < {GATE_SUCCESS} then 'success' end, case when missing > {GATE_MISSING} then 'missing' end, case when positive < {GATE_POSITIVE} then 'positive' end) as failed from g",
    "failure_attribution": _P + f" select case when task_completed then 'None' when selected_file_count = 0 then 'Retrieval' when {_SHARE} < 0.3 then 'Ranking' when missing_context_reported then 'Budget' else 'ModelRandom' end as cause, count(*) as runs from runs group by 1",
    "agent_summary": _P + f" select client_id, count(*) as runs, {_r('task_completed')} as success_rate, sum(total_workflow_input_tokens)::bigint as tokens_in, sum(total_workflow_output_tokens)::bigint as tokens_out, {_r('tests_passed')} as pass_rate from fb group by 1",
    "token_reduction": _P + f", w as (select {_G('snapshot_id')} index_snapshot_id, floor(sum(size) / 4) whole from (select distinct * from files where not coalesce(is_binary, false)) group by 1) select package_id, greatest(whole - actual_estimate, 0)::bigint as saved from p join w using (index_snapshot_id)",
    "token_budget": "select tokenizer, count(*) as packages, count(*) filter (actual_estimate <= context_target) as within_target, count(*) filter (actual_estimate > context_hard_limit) as over_limit, count(*) filter (context_target > context_hard_limit) as invalid from (select distinct * from context_packages) group by 1",
    "selected_files": _P + " select path, mode, count(*) as packages, max(score) as best_score from pj group by 1, 2",
    "rank": _P + " select package_id, path, mode, score, row_number() over (partition by package_id order by score desc, path, mode)::int as place from pj",
    "candidate_dedup": _P + " select package_id, path, array_to_string(list_sort(list(distinct mode)), ',') as modes, max(score) as score from pj group by 1, 2",
    "debounced": "select user_id, floor(epoch_us(ts) / 500000)::bigint as flush, arg_max(event_id, {'t': ts, 'i': event_id}) as event_id, count(*) as events from events group by 1, 2",
    "single_flight": "select event_type, count(*) as requests, count(*) filter (ts <= last + interval 1 minute) as shared from (select *, lag(ts) over (partition by user_id, event_type order by ts, event_id) as last from events) group by 1",
}
