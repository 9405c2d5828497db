"""What all operators share: reading the given tables, cleaning references, and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BLANK = r"^[\s\u00A0\u3000\uFEFF]+|[\s\u00A0\u3000\uFEFF]+$"


#: Rows of one key that a join puts into one task.
EVEN_ROWS = 50_000


#: The temporary folders of single-machine sessions.
OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guid(c: Column | str) -> Column:
    """The comparable form of a GUID reference; empty and blank text is null."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(c), BLANK + r"|[{}\-]", "")
    return F.when(bare != "", bare)


def guid_sql(c: str) -> str:
    """``guid`` in the SQL of the checks."""
    return f"nullif(regexp_replace(lower({c}), '^\\s+|\\s+$|[{{}}-]', '', 'g'), '')"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the session's checkpoint folder. Only a single-machine session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-tessera-")
        OWN[spark.sparkContext.applicationId] = found
    return found


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table over at least as many tasks as there are cores; only one of fewer files than that is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def even_join(many: DataFrame, one: DataFrame, on: str, by: str, how: str = "inner", limit: int = EVEN_ROWS) -> DataFrame:
    """Join ``many`` rows with the ``one`` row of their key. A key of more than ``limit`` rows is spread over several tasks by the hash of ``by``, its one row copied to each."""
    hot = many.groupBy(on).agg(F.ceil(F.count("*") / limit).cast("int").alias("parts_")).where("parts_ > 1")
    left = many.join(hot, on, "left").withColumn("part_", F.pmod(F.xxhash64(by), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    right = one.join(hot, on, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return left.join(right, [on, "part_"], how).drop("part_")


class Stage:
    """Tables written in the shared folder to cut the lineage of iterative jobs; they survive lost executors. Results read them, so those that are not dropped stay until the folder is cleared."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, **counts: Column) -> DataFrame:
        """Write df and read it back; ``counts`` are aggregates observed while it is written, then in ``.seen`` of the result."""
        self.n += 1
        path, seen = f"{self.base}/{self.n}", Observation()
        (df.observe(seen, *[c.alias(k) for k, c in counts.items()]) if counts else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at, out.seen = path, seen.get if counts else {}
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Give back the space of a table that no later step reads."""
        if path := getattr(df, "staged_at", None):
            fs, p = self._place(path)
            fs.delete(p, True)

    def _place(self, path: str):
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(context._jsc.hadoopConfiguration()), p
