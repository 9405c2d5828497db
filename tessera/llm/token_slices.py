"""Estimated tokens of indexed files by workspace and language, under the project's code tokenizer, kept up to date.

A count table holds the tokens of each content under each tokenizer, by their hashes; only contents that it lacks are encoded. The cube of slices is updated by signed deltas: a file that is gone or changed takes its
tokens from the slice it was in, a new or changed one adds them to its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import Stage

# The words and marks of the project's code tokenizer, with \\b\\w+\\b written out, as \\w differs between engines; and other names of languages.
CODE_TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|::|=>|->|<=|>=|==|!=|\+\+|--|&&|\|\||[{}()\[\];,.<>+\-*/%&|^!?=:\\\"'#@]"
ALIASES = {"c#": "csharp", "cs": "csharp", "ts": "typescript", "js": "javascript", "py": "python", "golang": "go", "md": "markdown", "yml": "yaml", "sh": "shell", "bash": "shell", "rs": "rust", "rb": "ruby", "kt": "kotlin", "c++": "cpp", "": "unknown"}
#: What tells this tokenizer's counts from those of others or of an earlier version.
TOKENIZER = hashlib.sha256(f"code {CODE_TOKEN} other/4".encode()).hexdigest()[:16]
#: Shares over which the files of one content are spread.
SALTS = 8

COUNTS = "h string, tokenizer string, tokens long"
MEMBERS = "snapshot_id string, path string, h string, language string, workspace_id string, tokens long"
CUBE = "workspace_id string, language string, files long, tokens long"


def code_tokens(text: Column) -> Column:
    """Tokens of the code tokenizer: its matches, and a quarter of the other characters, rounded up; null text has none."""
    count = F.regexp_count(text, F.lit(CODE_TOKEN)) + F.ceil(F.length(F.regexp_replace(text, CODE_TOKEN, "")) / 4)
    return F.coalesce(count, F.lit(0)).cast("long")


def clean_language(language: Column) -> Column:
    """The lower-case name without aliases; null and blank are 'unknown'."""
    low = F.coalesce(F.lower(F.trim(language)), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[low], low)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


@dataclass
class Budget:
    """counts: (h, tokenizer, tokens) of each content encoded so far; members: the files counted, one row per snapshot and path; cube: (workspace_id, language, files, tokens)."""

    counts: DataFrame
    members: DataFrame
    cube: DataFrame


def nothing(spark: SparkSession) -> Budget:
    return Budget(*[spark.createDataFrame([], s) for s in (COUNTS, MEMBERS, CUBE)])


def counted(texts: DataFrame, known: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(h, tokenizer, tokens) of the contents of ``texts`` that ``known`` lacks, each encoded once. texts: (h, content)."""
    unseen = texts.join(known.where(F.col("tokenizer") == tokenizer).select("h"), "h", "left_anti").dropDuplicates(["h"])
    return unseen.select("h", F.lit(tokenizer).alias("tokenizer"), code_tokens(F.col("content")).alias("tokens"))


def refreshed(old: Budget, files: DataFrame, snapshots: DataFrame, st: Stage) -> Budget:
    """The budget after ``files`` have taken the place of those it held.

    files: (snapshot_id, normalized_path, language, content); snapshots: (snapshot_id, workspace_id), one or more equal rows each. Each path counts once per snapshot: of several rows the one with most tokens (of equal ones
    the greatest language). Null content has no tokens; a null path is a path of its own; a snapshot that is not in ``snapshots`` counts under a null workspace. A slice without files is dropped.
    """
    path = F.regexp_replace(F.regexp_replace("normalized_path", r"\\", "/"), r"^\./", "")
    rows = files.select("snapshot_id", path.alias("path"), content_hash(F.col("content")).alias("h"), clean_language(F.col("language")).alias("language"), "content")
    counts = st.keep(old.counts.unionByName(st.keep(counted(rows.select("h", "content"), old.counts))))
    known = counts.where(F.col("tokenizer") == TOKENIZER).select("h", "tokens", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sized = rows.drop("content").withColumn("salt", F.pmod(F.hash("snapshot_id", "path"), F.lit(SALTS))).join(known, ["h", "salt"])
    one = sized.groupBy("snapshot_id", "path").agg(F.max(F.struct("tokens", "language", "h")).alias("v"))
    of = snapshots.groupBy("snapshot_id").agg(F.max("workspace_id").alias("workspace_id"))
    members = st.keep(one.join(of, "snapshot_id", "left").select("snapshot_id", "path", "v.h", "v.language", "workspace_id", "v.tokens"))
    # what is the same before and after cancels out
    signed = members.withColumn("sign", F.lit(1)).unionByName(old.members.withColumn("sign", F.lit(-1)))
    moved = signed.groupBy(*members.columns).agg(F.sum("sign").alias("sign")).where("sign != 0")
    delta = moved.groupBy("workspace_id", "language").agg(F.sum("sign").alias("files"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    cube = old.cube.unionByName(delta).groupBy("workspace_id", "language").agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens")).where("files != 0")
    return Budget(counts, members, cube)


def token_slices(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(workspace_id, language, files, tokens) of all files, from an empty budget."""
    spark = files.sparkSession
    return refreshed(nothing(spark), files, snapshots, Stage(spark, "tokens")).cube
