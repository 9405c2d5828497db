"""References to records that do not exist.

Parents are reduced to one row per key, cut into ranges of at most a fixed number of keys, and each range is stored as one sorted array. References get the range
of their key by binary search in the list of range starts, are batched within the range (a range that draws very many references gets many batches), and each batch is
probed against the range's array by vectorised binary search. Batches stay as they are whatever the skew; arrays grow only beyond RANGE_KEYS times MOST_RANGES parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import Stage

#: Keys in one range's array, and references in one batch; ranges at most, whose first keys every task gets.
RANGE_KEYS = 20_000
BATCH_ROWS = 100_000
MOST_RANGES = 100_000


def parent_ranges(parents: DataFrame, st: Stage, range_keys: int = RANGE_KEYS) -> tuple[DataFrame, list[str]]:
    """(range_id, keys, first_at, alive) with one row per range and sorted arrays, and the ranges' first keys in order."""
    one = st.keep(parents.where("key is not null").groupBy("key").agg(F.min(F.when(F.col("alive"), F.unix_micros(F.col("at").cast("timestamp_ltz")))).alias("first_at"), F.max("alive").alias("alive")), n=F.count("*"))
    n = min(MOST_RANGES, max(1, -(-(one.seen["n"] or 0) // range_keys)))
    cut = st.keep(one.repartitionByRange(n, "key").withColumn("range_id", F.spark_partition_id()))
    starts = [r[0] for r in cut.groupBy("range_id").agg(F.min("key").alias("k")).orderBy("k").select("k").collect()]
    order = st.spark.createDataFrame(list(enumerate(starts, 1)), "range_id int, lo string")
    packed = cut.groupBy(F.col("range_id").alias("cut")).agg(F.sort_array(F.collect_list(F.struct("key", "first_at", "alive"))).alias("rows"), F.min("key").alias("lo"))
    return packed.join(order, "lo").select("range_id", F.col("rows.key").alias("keys"), F.col("rows.first_at").alias("first_at"), F.col("rows.alive").alias("alive")), starts


def broken(refs: DataFrame, parents: DataFrame, range_keys: int = RANGE_KEYS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """References without a target.

    refs: (table_name, row_id, key, made_at, period) with a cleaned key; null keys are no references. parents: (key, alive, at), any number of rows per key.
    Returns (table_name, row_id, period, reason) once per distinct row: 'missing' if no parent row has the key, 'deleted' if none of them is alive, 'late' if the earliest ``at`` of
    those alive is after ``made_at``. A null ``made_at``, or a parent without ``at``, is never late. Without parents every reference is missing; without references the result is empty.
    """
    spark = refs.sparkSession
    st = Stage(spark, "orphans")
    arrays, starts = parent_ranges(parents, st, range_keys)
    rows = refs.where("key is not null").select("table_name", "row_id", "key", F.unix_micros(F.col("made_at").cast("timestamp_ltz")).alias("made_at"), "period")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge = np.array(starts, dtype=object)
        for b in batches:
            keys = b["key"].to_numpy(dtype=object)
            b["range_id"] = np.maximum(np.searchsorted(edge, keys, side="right"), 1).astype("int32") if len(edge) else np.ones(len(b), "int32")
            yield b

    placed = st.keep(rows.mapInPandas(place, "table_name string, row_id string, key string, made_at long, period string, range_id int"))
    wide = st.keep(placed.groupBy("range_id").agg(F.ceil(F.count("*") / batch_rows).cast("int").alias("batches")), batches=F.sum("batches"))
    # one group a task on average, on both sides alike
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wide.seen["batches"] or 1, 100_000))
    batched = placed.join(wide, "range_id").select("*", F.pmod(F.xxhash64("row_id", "key", "made_at"), F.col("batches")).cast("int").alias("batch")).drop("batches")
    probes = wide.join(arrays, "range_id", "left").select(F.col("range_id").alias("of_range"), "keys", "first_at", "alive", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("of_batch"))

    def probe(refs_: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        if refs_.empty:
            return refs_.assign(reason=pd.Series(dtype=object))[["table_name", "row_id", "period", "reason"]]
        keys = par["keys"].iloc[0] if len(par) and par["keys"].iloc[0] is not None else []
        keys, want = np.asarray(keys, dtype=object), refs_["key"].to_numpy(dtype=object)
        if not len(keys):
            return refs_.assign(reason="missing")[["table_name", "row_id", "period", "reason"]]
        try:  # keys of plain characters compare as bytes
            keys, want = keys.astype("S"), want.astype("S")
        except UnicodeEncodeError:
            pass
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        found = keys[at] == want
        alive = np.asarray(par["alive"].iloc[0], dtype=bool)[at]
        first = pd.Series(par["first_at"].iloc[0], dtype="Int64").to_numpy(dtype="float64", na_value=np.nan)[at]
        late = first > refs_["made_at"].to_numpy(dtype="float64", na_value=np.nan)
        reason = np.where(~found, "missing", np.where(~alive, "deleted", np.where(late, "late", "")))
        out = refs_.assign(reason=reason)[["table_name", "row_id", "period", "reason"]]
        return out[reason != ""]

    pairs = batched.repartition(tasks, "range_id", "batch").groupBy("range_id", "batch").cogroup(probes.repartition(tasks, "of_range", "of_batch").groupBy("of_range", "of_batch"))
    return pairs.applyInPandas(probe, "table_name string, row_id string, period string, reason string").distinct()
