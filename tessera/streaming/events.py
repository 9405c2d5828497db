"""Telemetry as a stream: hourly counters and the debouncing of bursts, with a watermark for late events. Each query reads the events as a stream, up to what is there now, and gives what its sink holds then: windows that the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import Stage, table

#: How late an event may come.
LATE = "10 minutes"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # as a pattern the path may be a file or a folder
    return rows.withColumn("at", F.col("ts").cast("timestamp_ltz")).withWatermark("at", LATE)


def _sunk(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """What a file sink holds once the stream has read all there is."""
    st = Stage(spark, name)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{st.base}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{st.base}/rows")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{st.base}/rows")


def stream_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and their mean latency of each hour and kind."""
    hourly = _stream(spark, sf).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("requests"), F.round(F.avg("value"), 4).alias("avg_latency_ms"))
    return _sunk(spark, hourly.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "requests", "avg_latency_ms"), "telemetry")


def stream_debounced(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user in each flush of a minute."""
    last = _stream(spark, sf).groupBy(F.window("at", "1 minute").alias("w"), "user_id").agg(F.max(F.struct("at", "event_id")).alias("last"), F.count("*").alias("events"))
    return _sunk(spark, last.select(F.col("w.start").cast("timestamp_ntz").alias("flush"), "user_id", "last.event_id", "events"), "debounced")


QUERIES = {f.__name__: f for f in (stream_telemetry, stream_debounced)}

_ENDED = "<= (select max(ts) - interval 10 minutes from events)"
SQL = {
    "stream_telemetry": f"select date_trunc('hour', ts) as hour, event_type, count(*) as requests, round(avg(value), 4) as avg_latency_ms from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour {_ENDED}",
    "stream_debounced": f"select date_trunc('minute', ts) as flush, user_id, arg_max(event_id, {{'t': ts, 'i': event_id}}) as event_id, count(*) as events from events group by 1, 2 having date_trunc('minute', ts) + interval 1 minute {_ENDED}",
}
