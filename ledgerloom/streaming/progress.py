"""Progress of batches as a stream: running counts and time spent per run, an extension of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files of a folder as a stream, in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def run_progress(events: DataFrame) -> DataFrame:
    """Per run: batches done, failed ones and whole milliseconds spent; works on streams and tables."""
    return events.groupBy(F.col("user_id").alias("run")).agg(
        F.count("*").alias("done"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.sum(F.floor(F.col("value") * 1000 + 0.5)).alias("spent"),
    )


def hourly_failures(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Failures by hour of event time; rows later than the watermark no longer change a closed hour."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    grouped = stamped.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return grouped.select(F.unix_timestamp("window.start").alias("hour"), "n", "failed")


def replay(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there now, into a memory table."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


QUERIES = {
    "stream_run_progress": lambda s, d: run_progress(_events(s, d)),
    "stream_hourly_failures": lambda s, d: hourly_failures(_events(s, d)),
}
ORACLES = {
    "stream_run_progress": "SELECT user_id AS run, count(*) AS done, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(CAST(floor(value * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS spent FROM events GROUP BY user_id",
    "stream_hourly_failures": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
}
