"""Indexed contents and task texts: token estimates, lines, outlines, summaries and chunks, keywords, credential patterns, full-text search with BM25, and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import guid, guid_sql, table
from tessera.sources.index import contents

# What the estimating tokenizers count; \\b\\w+\\b is written out, as \\w differs between engines.
WORD_TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s]"
CODE_TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|::|=>|->|<=|>=|==|!=|\+\+|--|&&|\|\||[{}()\[\];,.<>+\-*/%&|^!?=:\\\"'#@]"
# How declarations begin, patterns of credentials, words that are no keywords, and words that tell the kind of a task, in order.
DECLARATION = "^(public |private |protected |internal |export |class |interface |enum |struct |namespace |def |async def |function )"
SECRETS = {
    "api_key": r"(?i)(api[_-]?key|apikey)\s*[:=]\s*['\"]?[a-zA-Z0-9\-_.]{20,}",
    "password": r"(?i)password\s*[:=]\s*['\"]?[^\s'\"$]{6,}",
    "private_key": r"-----BEGIN\s+(RSA\s+|EC\s+|OPENSSH\s+)?PRIVATE\s+KEY-----",
    "connection": r"(?i)(server|data\s+source)\s*=\s*[^;]*;\s*password\s*=\s*[^\s;]+",
    "bearer": r"(?i)bearer\s+[a-zA-Z0-9\-._~+\/]+=*",
}
STOP_WORDS = (
    "the a an is are was were be been to in on at for of with by from and or not but if else when then this that these those it its function method class file code i we you they he she all can her one our out day had has "
    "his how may new now old see way who did get let say too use fix add update remove delete change should would could will shall"
).split()
OPERATIONS = (("fix", "BugFix"), ("bug", "BugFix"), ("add", "Feature"), ("implement", "Feature"), ("refactor", "Refactor"), ("update", "Update"), ("remove", "Delete"), ("why", "Question"), ("explain", "Question"))
#: Lines of a chunk and of its overlap with the next; lines around an anchor; hits of a search.
CHUNK_LINES, OVERLAP, CONTEXT, HITS = 200, 10, 15, 50
K1, B = 1.2, 0.75
SALTS = 16
#: Query vectors that one pass holds, and neighbours of each.
QUERIES_AT_ONCE, NEIGHBOURS = 20_000, 5


def _estimates(spark: SparkSession, sf: str, tokens: Column) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def tok_char(spark: SparkSession, sf: str) -> DataFrame:
    return _estimates(spark, sf, F.ceil(F.length("text") / 4))


def tok_floor(spark: SparkSession, sf: str) -> DataFrame:
    return _estimates(spark, sf, F.floor(F.length("text") / 4))


def tok_word(spark: SparkSession, sf: str) -> DataFrame:
    return _estimates(spark, sf, F.regexp_count("text", F.lit(WORD_TOKEN)))


def tok_code(spark: SparkSession, sf: str) -> DataFrame:
    return _estimates(spark, sf, F.regexp_count("text", F.lit(CODE_TOKEN)) + F.ceil(F.length(F.regexp_replace("text", CODE_TOKEN, "")) / 4))


def message_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each chat as messages: 3 of the whole, 4 of each line and a quarter of its characters."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    return table(spark, sf, "documents").where("lower(trim(source)) = 'chat' and length(text) > 0").select("doc_id", F.size(lines).cast("long").alias("messages"), (F.lit(3) + F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + 4 + F.ceil(F.length(x) / 4))).cast("long").alias("tokens"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return contents(spark, sf).select("snapshot_id", "path", F.split("content", "\r?\n").alias("lines"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("snapshot_id", "path", F.posexplode("lines").alias("k", "line")).select("snapshot_id", "path", (F.col("k") + 1).alias("line_no"), "line")


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """The declaration lines of each file, with their numbers."""
    trimmed = F.regexp_replace("line", r"^\s+", "")
    return _numbered(spark, sf).where(trimmed.rlike(DECLARATION)).select("snapshot_id", "path", "line_no", F.concat(F.col("line_no").cast("string"), F.lit(": "), trimmed).alias("entry"))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 lines of each file, up to ten that import, and the last ten, each line once."""
    n = F.size("lines")
    imports = F.slice(F.filter("lines", lambda x: F.contains(x, F.lit("import ")) | F.contains(x, F.lit("using "))), 1, 10)
    tail = F.slice("lines", F.greatest(n - 9, F.lit(1)), 10)
    text = F.array_join(F.array_distinct(F.concat(F.slice("lines", 1, 20), imports, tail)), "\n")
    return _lines(spark, sf).select("snapshot_id", "path", F.md5(text).alias("summary_md5"), F.floor(F.length(text) / 4).cast("long").alias("tokens"))


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each content in chunks of lines that overlap, up to the one that reaches its end."""
    n, step = F.size("lines"), CHUNK_LINES - OVERLAP
    last = F.greatest(F.ceil((n - CHUNK_LINES) / step), F.lit(0)).cast("int")
    rows = _lines(spark, sf).select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    text = F.array_join(F.slice("lines", F.col("chunk") * step + 1, CHUNK_LINES), "\n")
    return rows.select("snapshot_id", "path", "chunk", (F.col("chunk") * step + 1).alias("start_line"), F.least(F.col("chunk") * step + CHUNK_LINES, n).alias("end_line"), F.length(text).cast("long").alias("characters"))


def expand_file(spark: SparkSession, sf: str) -> DataFrame:
    """Contents cut to the characters that a budget of 100 tokens allows, with a mark where they were cut."""
    cut = F.when(F.length("content") > 400, F.concat(F.substring("content", 1, 400), F.lit("\n... [truncated]"))).otherwise(F.col("content"))
    return contents(spark, sf).select("snapshot_id", "path", F.md5("content").alias("content_md5"), F.md5(cut).alias("shown_md5"))


def line_of_offset(spark: SparkSession, sf: str) -> DataFrame:
    """The line on which each content first returns something."""
    at = F.locate("return ", F.col("content"))
    head = F.substring(F.col("content"), F.lit(1), at)
    return contents(spark, sf).where(at > 0).select("snapshot_id", "path", F.md5("content").alias("content_md5"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_no"))


def anchor_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of each file with the lines around them, ranges that touch merged."""
    s = table(spark, sf, "file_symbols").select(guid("file_id").alias("file_id"), "start_line", "end_line").where("file_id is not null and end_line >= start_line").select("file_id", F.greatest(F.col("start_line") - CONTEXT, F.lit(1)).alias("a"), (F.col("end_line") + CONTEXT).alias("z")).distinct()
    order = Window.partitionBy("file_id").orderBy("a", "z")
    seen = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = s.withColumn("new", F.when(F.col("a") > seen + 1, 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("file_id", "island").agg(F.min("a").alias("start_line"), F.max("z").alias("end_line"), F.count("*").alias("symbols")).drop("island")


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that meet each of the five plain patterns; ``p3_found`` is the finder of credentials."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in SECRETS.items()]))
    return _numbered(spark, sf).select("snapshot_id", "path", "line_no", F.explode(hits).alias("pattern")).distinct()


def log_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Contents with what follows a password or bearer sign masked, by their digests."""
    shown = F.regexp_replace(F.regexp_replace("content", r"(?i)(password\s*[:=]\s*)[^\s]+", "$1***"), r"(?i)(bearer\s+)[a-zA-Z0-9._~+/=\-]+", "$1***")
    return contents(spark, sf).select("snapshot_id", "path", F.md5("content").alias("content_md5"), F.md5(shown).alias("redacted_md5"))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "context_packages").select("task_text").where("task_text is not null").distinct()


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The keywords of each task: words of three letters or more that are no stop words, and pairs of adjacent Chinese characters."""
    words = F.filter(F.transform(F.regexp_extract_all("task_text", F.lit(r"\p{L}[\p{L}\p{N}]{2,}"), F.lit(0)), F.lower), lambda w: ~w.isin(*STOP_WORDS))
    han = F.regexp_replace("task_text", "[^\\x{4e00}-\\x{9fff}]", "")
    pairs = F.when(F.length(han) >= 2, F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda k: F.substring(han, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return _tasks(spark, sf).select("task_text", F.explode(F.array_distinct(F.concat(words, pairs))).alias("keyword"))


def parse_task_op(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each task, by the first telling word it holds."""
    kind = F.coalesce(*[F.when(F.contains(F.lower("task_text"), F.lit(w)), F.lit(k)) for w, k in OPERATIONS], F.lit("Unknown"))
    return _tasks(spark, sf).groupBy(kind.alias("operation")).agg(F.count("*").alias("tasks"))


def parse_task_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of files that stand in each task."""
    return _tasks(spark, sf).select("task_text", F.explode(F.array_distinct(F.regexp_extract_all("task_text", F.lit(r"(?:[A-Za-z0-9_\-]+[/\\])+[A-Za-z0-9_\-]+\.[A-Za-z]{1,10}"), F.lit(0)))).alias("path"))


def _postings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(doc, term, tf, dl) of the words of the contents, runs of letters and digits in lower case, and the number and mean length of the documents."""
    docs = contents(spark, sf).select(F.md5(F.concat_ws("\n", "snapshot_id", "path", "content")).alias("doc"), "snapshot_id", "path", F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
    return docs.select("doc", "snapshot_id", "path", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc", "snapshot_id", "path", "dl", "term").agg(F.count("*").alias("tf")), size


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The best contents for each keyword of the tasks by BM25; the counts are those of all contents. A keyword with very many hits is cut to its best within shares of them first."""
    postings, size = _postings(spark, sf)
    asked = keywords(spark, sf).select(F.col("keyword").alias("term")).distinct()
    hits = postings.join(asked, "term", "left_semi")
    spread_df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(spread_df, "term").join(size)
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = F.round(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))), 6)
    scored = scored.select("term", "snapshot_id", "path", "doc", score.alias("score"))
    near = F.row_number().over(Window.partitionBy("term", F.pmod(F.hash("doc"), F.lit(SALTS))).orderBy(F.col("score").desc(), "path", "snapshot_id", "doc"))
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), "path", "snapshot_id", "doc"))
    return scored.withColumn("near", near).where(F.col("near") <= HITS).withColumn("place", best).where(F.col("place") <= HITS).select("term", "snapshot_id", "path", "doc", "score", "place")


def fts_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of each keyword's hits between 0 for the worst and 1 for the best, 0.9 where all are the same."""
    hits = bm25_scores(spark, sf)
    span = hits.groupBy("term").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    part = F.when(F.col("hi") - F.col("lo") < 1e-10, 0.9).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return hits.join(span, "term").select("term", "snapshot_id", "path", "doc", F.round(part, 4).alias("score"))


def context_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The files for each task: the mean of its keywords' normalised scores in ten-thousandths, best first; the flagship query up to the budget."""
    words = keywords(spark, sf)
    n = words.groupBy("task_text").agg(F.count("*").alias("n"))
    hit = fts_normalized(spark, sf).groupBy("term", "snapshot_id", "path").agg(F.max("score").alias("score"))
    scored = words.join(hit, words["keyword"] == hit["term"]).groupBy("task_text", "snapshot_id", "path").agg(F.sum(F.round(F.col("score") * 10_000).cast("long")).alias("points"), F.count("*").alias("keywords"))
    rated = scored.join(n, "task_text").select("task_text", "snapshot_id", "path", "keywords", F.expr("points div n").alias("score"))
    place = F.row_number().over(Window.partitionBy("task_text").orderBy(F.col("score").desc(), "path", "snapshot_id"))
    return rated.withColumn("place", place).where(F.col("place") <= HITS)


def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked files that fit a budget of 1,000 tokens one after the other; one that does not fit is passed over, smaller ones after it still count."""
    size = contents(spark, sf).groupBy("snapshot_id", "path").agg(F.max(F.ceil(F.length("content") / 4)).cast("long").alias("tokens"))
    ranked = context_rank(spark, sf).join(size, ["snapshot_id", "path"])
    rows = ranked.groupBy("task_text").agg(F.array_sort(F.collect_list(F.struct("place", "snapshot_id", "path", "tokens"))).alias("rows"))

    def state(used: Column, taken: Column) -> Column:
        return F.named_struct(F.lit("used"), used, F.lit("taken"), taken)

    start = state(F.lit(0).cast("long"), F.array().cast("array<int>"))
    fold = F.aggregate("rows", start, lambda s, r: state(s["used"] + F.when(s["used"] + r["tokens"] <= 1000, r["tokens"]).otherwise(0), F.when(s["used"] + r["tokens"] <= 1000, F.concat(s["taken"], F.array(r["place"]))).otherwise(s["taken"])))
    picked = rows.select("task_text", fold["taken"].alias("taken"), F.explode("rows").alias("r"))
    return picked.where(F.array_contains("taken", F.col("r.place"))).select("task_text", "r.place", "r.snapshot_id", "r.path", "r.tokens")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors, by cosine, of every vector whose id 20 divides, against all rows; a zero vector has cosine 0. Query vectors are taken in blocks, each held against all rows where they lie."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").where("embedding is not null")
    asked = rows.where("vec_id % 20 = 0")
    blocks = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    found = None
    for k in range(blocks):
        mine = asked.where(F.pmod(F.hash("vec_id"), F.lit(blocks)) == k).toPandas()

        def near(frames: Iterator[pd.DataFrame], mine: pd.DataFrame = mine) -> Iterator[pd.DataFrame]:
            ids, q = mine["vec_id"].to_numpy(), np.array(mine["embedding"].tolist(), "float64").reshape(len(mine), -1)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for f in frames:
                x = np.array(f["embedding"].tolist(), "float64")
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                others = f["vec_id"].to_numpy()
                for at in range(0, len(q), 256):
                    c = q[at : at + 256] @ x.T
                    c[ids[at : at + 256, None] == others[None, :]] = -2
                    top = np.argsort(-c, axis=1, kind="stable")[:, :NEIGHBOURS]
                    yield pd.DataFrame({"vec_id": np.repeat(ids[at : at + 256], top.shape[1]), "neighbour": others[top].ravel(), "cosine": np.take_along_axis(c, top, 1).ravel()})

        got = rows.mapInPandas(near, "vec_id long, neighbour long, cosine double").where("cosine > -2")
        found = got if found is None else found.unionByName(got)
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= NEIGHBOURS).select("vec_id", "neighbour", "place")


QUERIES = {
    f.__name__: f
    for f in (
        tok_char, tok_floor, tok_word, tok_code, message_tokens, outline, summary, chunk_lines, expand_file, line_of_offset, anchor_merge, secret_scan, log_redact, keywords, parse_task_op, parse_task_paths, bm25_scores,
        fts_normalized, context_rank, greedy_budget, vector_topk,
    )
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WITH = f"""with recursive ct as (select distinct {guid_sql('snapshot_id')} snapshot_id, normalized_path path, content from file_contents_fts where content is not null and normalized_path is not null),
ln as (select snapshot_id, path, content, regexp_split_to_array(content, '\\r?\\n') ls from ct),
nb as (select snapshot_id, path, unnest(ls) line, generate_subscripts(ls, 1) line_no from ln),
tasks as (select distinct task_text from context_packages where task_text is not null),
hn as (select task_text, regexp_replace(task_text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') han from tasks),
kw as (select distinct task_text, keyword from (select task_text, lower(unnest(regexp_extract_all(task_text, '\\p{{L}}[\\p{{L}}\\p{{N}}]{{2,}}'))) keyword from tasks union all select task_text, substr(han, k, 2) from (select task_text, han, unnest(range(1, length(han))) k from hn where length(han) >= 2))
  where keyword not in ({", ".join(_q(w) for w in STOP_WORDS)}) or regexp_matches(keyword, '^[\\x{{4e00}}-\\x{{9fff}}]{{2}}$')),
dw as (select md5(concat_ws(chr(10), snapshot_id, path, content)) doc, snapshot_id, path, [w for w in regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+') if w <> ''] words from ct),
sz as (select count(*) n, avg(len(words)) avgdl from dw),
po as (select doc, snapshot_id, path, dl, term, count(*) tf from (select doc, snapshot_id, path, len(words) dl, unnest(words) term from dw) where term in (select keyword from kw) group by all),
sc as (select po.term, snapshot_id, path, doc, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6::double) * tf * {K1 + 1}::double / (tf + {K1}::double * (1 - {B}::double + {B}::double * dl / avgdl)), 6) score from po join (select term, count(*) df from po group by 1) d on d.term = po.term cross join sz),
bm as (select * from (select term, snapshot_id, path, doc, score, row_number() over (partition by term order by score desc, path, snapshot_id, doc)::int place from sc) where place <= {HITS}),
nm as (select term, snapshot_id, path, doc, round(case when max(score) over w - min(score) over w < 1e-10 then 0.9 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 4) score from bm window w as (partition by term)),
rt as (select task_text, snapshot_id, path, keywords, (points // n)::bigint score from (select task_text, snapshot_id, path, sum(round(score * 10000)::bigint) points, count(*) keywords from kw join (select term, snapshot_id, path, max(score) score from nm group by 1, 2, 3) h on h.term = kw.keyword group by 1, 2, 3) join (select task_text, count(*) n from kw group by 1) using (task_text)),
rk as (select * from (select task_text, snapshot_id, path, keywords, score, row_number() over (partition by task_text order by score desc, path, snapshot_id)::int place from rt) where place <= {HITS}),
rs as (select task_text, place, snapshot_id, path, tokens from rk join (select snapshot_id, path, max(ceil(length(content) / 4))::bigint tokens from ct group by 1, 2) t using (snapshot_id, path)),
fold as (select task_text, 0 as place, 0::bigint as used, false as taken from (select distinct task_text from rs)
  union all select f.task_text, r.place, case when f.used + r.tokens <= 1000 then f.used + r.tokens else f.used end, f.used + r.tokens <= 1000 from fold f join rs r on r.task_text = f.task_text and r.place = f.place + 1)"""
_HITS = ", ".join(f"case when regexp_matches(line, {_q(p)}) then {_q(n)} end" for n, p in SECRETS.items())

SQL = {
    "tok_char": "select doc_id, coalesce(ceil(length(text) / 4), 0)::bigint as tokens from documents",
    "tok_floor": "select doc_id, coalesce(floor(length(text) / 4), 0)::bigint as tokens from documents",
    "tok_word": f"select doc_id, coalesce(len(regexp_extract_all(text, {_q(WORD_TOKEN)})), 0)::bigint as tokens from documents",
    "tok_code": f"select doc_id, coalesce(len(regexp_extract_all(text, {_q(CODE_TOKEN)})) + ceil(length(regexp_replace(text, {_q(CODE_TOKEN)}, '', 'g')) / 4), 0)::bigint as tokens from documents",
    "message_tokens": "select doc_id, len(ls)::bigint as messages, (3 + coalesce(list_sum([4 + ceil(length(x) / 4) for x in ls]), 0))::bigint as tokens from (select doc_id, [x for x in string_split(text, chr(10)) if length(x) > 0] ls from documents where lower(trim(source)) = 'chat' and length(text) > 0)",
    "outline": _WITH + f" select snapshot_id, path, line_no::int as line_no, line_no || ': ' || regexp_replace(line, '^\\s+', '') as entry from nb where regexp_matches(regexp_replace(line, '^\\s+', ''), '{DECLARATION}')",
    "summary": _WITH + ", pt as (select snapshot_id, path, content, list_concat(list_concat(ls[1:20], [x for x in ls if contains(x, 'import ') or contains(x, 'using ')][1:10]), ls[greatest(len(ls) - 9, 1):]) p from ln), tx as (select snapshot_id, path, content, array_to_string([p[k] for k in range(1, len(p) + 1) if list_position(p, p[k]) = k], chr(10)) t from pt) select snapshot_id, path, md5(t) as summary_md5, floor(length(t) / 4)::bigint as tokens from tx",
    "chunk_lines": _WITH + f", ck as (select snapshot_id, path, content, ls, unnest(range(0, greatest(ceil((len(ls) - {CHUNK_LINES}) / {CHUNK_LINES - OVERLAP}), 0)::int + 1)) chunk from ln) select snapshot_id, path, chunk::int as chunk, (chunk * {CHUNK_LINES - OVERLAP} + 1)::int as start_line, least(chunk * {CHUNK_LINES - OVERLAP} + {CHUNK_LINES}, len(ls))::int as end_line, length(array_to_string(ls[chunk * {CHUNK_LINES - OVERLAP} + 1 : chunk * {CHUNK_LINES - OVERLAP} + {CHUNK_LINES}], chr(10)))::bigint as characters from ck",
    "expand_file": _WITH + " select snapshot_id, path, md5(content) as content_md5, md5(case when length(content) > 400 then substr(content, 1, 400) || chr(10) || '... [truncated]' else content end) as shown_md5 from ct",
    "line_of_offset": _WITH + " select snapshot_id, path, md5(content) as content_md5, (length(h) - length(replace(h, chr(10), '')) + 1)::bigint as line_no from (select *, substr(content, 1, strpos(content, 'return ')) h from ct where contains(content, 'return '))",
    "anchor_merge": f"with s as (select distinct {guid_sql('file_id')} file_id, greatest(start_line - {CONTEXT}, 1) a, end_line + {CONTEXT} z from file_symbols where {guid_sql('file_id')} is not null and end_line >= start_line), m as (select *, max(z) over (partition by file_id order by a, z rows between unbounded preceding and 1 preceding) seen from s), i as (select *, sum(case when a > seen + 1 then 1 else 0 end) over (partition by file_id order by a, z rows between unbounded preceding and current row) island from m) select file_id, min(a) as start_line, max(z) as end_line, count(*) as symbols from i group by file_id, island",
    "secret_scan": _WITH + f" select distinct snapshot_id, path, line_no::int as line_no, pattern from (select snapshot_id, path, line_no, unnest([{_HITS}]) pattern from nb) where pattern is not null",
    "log_redact": _WITH + r" select snapshot_id, path, md5(content) as content_md5, md5(regexp_replace(regexp_replace(content, '(?i)(password\s*[:=]\s*)[^\s]+', '\1***', 'g'), '(?i)(bearer\s+)[a-zA-Z0-9._~+/=\-]+', '\1***', 'g')) as redacted_md5 from ct",
    "keywords": _WITH + " select task_text, keyword from kw",
    "parse_task_op": _WITH + " select coalesce(" + ", ".join(f"case when contains(lower(task_text), '{w}') then '{k}' end" for w, k in OPERATIONS) + ", 'Unknown') as operation, count(*) as tasks from tasks group by 1",
    "parse_task_paths": _WITH + r" select distinct task_text, path from (select task_text, unnest(regexp_extract_all(task_text, '(?:[A-Za-z0-9_\-]+[/\\])+[A-Za-z0-9_\-]+\.[A-Za-z]{1,10}')) path from tasks)",
    "bm25_scores": _WITH + " select * from bm",
    "fts_normalized": _WITH + " select * from nm",
    "context_rank": _WITH + " select * from rk",
    "greedy_budget": _WITH + " select r.task_text, r.place, r.snapshot_id, r.path, r.tokens from fold f join rs r on r.task_text = f.task_text and r.place = f.place where f.taken",
    "vector_topk": f"select * from (select q.vec_id, r.vec_id as neighbour, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], r.embedding::double[]) desc, r.vec_id)::int as place from embeddings q join embeddings r on r.vec_id <> q.vec_id where q.vec_id % 20 = 0) where place <= {NEIGHBOURS}",
}
