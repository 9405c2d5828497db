"""What changed between full snapshots: EXCEPT ALL both ways removes identical rows, a full join of the residues by key labels the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USABLE = ("Active", "ActiveDegraded", "Superseded")
UNKNOWN_HASHES = ("", "pending")


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, previous_id): consecutive usable snapshots of one workspace and branch, by created_at and, of equal ones, id."""
    one = snapshots.where(F.col("status").isin(*USABLE) & F.col("branch").isNotNull() & F.col("workspace_id").isNotNull()).groupBy("id").agg(F.max(F.struct("created_at", "workspace_id", "branch")).alias("s")).select("id", "s.*")
    series = Window.partitionBy("workspace_id", "branch").orderBy("created_at", "id")
    return one.select(F.col("id").alias("snapshot_id"), F.lag("id").over(series).alias("previous_id")).where("previous_id is not null")


def listing(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, hash): the paths present in each snapshot; an unknown hash is null."""
    path = F.regexp_replace(F.regexp_replace("normalized_path", r"\\", "/"), r"^\./", "")
    rows = files.where("snapshot_id is not null and normalized_path is not null").select("snapshot_id", path.alias("path"), F.struct("created_at", (F.col("status") == "Deleted").alias("gone"), F.regexp_replace(F.lower(F.trim("content_hash")), "^sha256:", "").alias("hash")).alias("v"))
    last = rows.groupBy("snapshot_id", "path").agg(F.max("v").alias("v")).where("not coalesce(v.gone, false)")
    return last.select("snapshot_id", "path", F.when(~F.col("v.hash").isin(*UNKNOWN_HASHES), F.col("v.hash")).alias("hash"))


def changes(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences between the snapshots of each pair.

    files: (snapshot_id, normalized_path, content_hash, status, created_at); pairs: (snapshot_id, previous_id). Returns (snapshot_id, normalized_path, change), change 'added', 'removed'
    or 'changed', snapshot_id that of the later one. Of several rows for a path the one with the greatest created_at counts (of equal ones a deletion, then the greatest hash); a null path or snapshot is no file;
    equal hashes differ in spelling only; unknown ones never make a change. A snapshot without files is empty; no pairs give no rows.
    """
    needed = pairs.select("snapshot_id").unionByName(pairs.select(F.col("previous_id").alias("snapshot_id"))).distinct()
    now = listing(files.join(needed, "snapshot_id", "left_semi"))
    later = now.join(pairs.select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", "path", "hash")
    earlier = now.withColumnRenamed("snapshot_id", "previous_id").join(pairs, "previous_id").select("snapshot_id", "path", "hash")
    new, old = later.exceptAll(earlier), earlier.exceptAll(later)
    both = new.withColumnRenamed("hash", "h1").withColumn("in1", F.lit(True)).join(old.withColumnRenamed("hash", "h0").withColumn("in0", F.lit(True)), ["snapshot_id", "path"], "full")
    label = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select("snapshot_id", F.col("path").alias("normalized_path"), label.alias("change")).where("change is not null")
