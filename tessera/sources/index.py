"""The tables of an index as the queries read them: cleaned ids, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import guid, table


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select(guid("id").alias("file_id"), guid("snapshot_id").alias("snapshot_id"), "normalized_path", "size", "language", "content_hash", "mtime", "hash_kind", "parser_id", "parser_version", "status", "is_binary").distinct()


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_symbols").select(guid("file_id").alias("file_id"), guid("snapshot_id").alias("snapshot_id"), "name", "kind", "start_line", "end_line").distinct()


def imports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_imports").select(guid("file_id").alias("file_id"), guid("snapshot_id").alias("snapshot_id"), "module", "imported_name", "line").distinct()


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """(snapshot_id, path, content), each distinct row once."""
    return table(spark, sf, "file_contents_fts").select(guid("snapshot_id").alias("snapshot_id"), F.col("normalized_path").alias("path"), "content").where("content is not null and normalized_path is not null").distinct()


def packages(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each package: of several the one saved last, of equal ones the one with the greatest estimate."""
    rows = table(spark, sf, "context_packages").withColumn("package_id", guid("id"))
    order = F.struct("created_at", "actual_estimate", "selected_file_count", "excluded_count", "task_text")
    keep = ["workspace_id", "index_snapshot_id", "task_text", "ranking_profile_id", "ranking_profile_version", "actual_estimate", "selected_file_count", "excluded_count", "tokenizer", "created_at"]
    one = rows.groupBy("package_id").agg(F.max_by(F.struct(*keep), order).alias("r")).select("package_id", "r.*")
    return one.withColumn("workspace_id", guid("workspace_id")).withColumn("index_snapshot_id", guid("index_snapshot_id"))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "context_feedback").distinct().withColumn("package_id", guid("context_package_id")).withColumnRenamed("id", "feedback_id")
