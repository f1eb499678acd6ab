"""ACT5: inactivity sessions on Structured Streaming.

``readStream`` over the events -> watermark -> ``session_window`` aggregation in append mode ->
Parquet sink in the shared checkpoint folder. Append mode emits a session once the watermark has
passed its end. One ``availableNow`` batch takes all files that are there, in whatever layout, so no
event is late; a row far in the future closes the last sessions and is left out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffwise.constants import SESSION_GAP_SECONDS
from staffwise.session import scratch_path

END = "9999-01-01 00:00:00"  # later than any event
OUT_SCHEMA = ("user bigint, session_start timestamp, session_end timestamp, n_events bigint, "
              "total_seconds double, n_tools bigint, tools_used string")


def session_stream(events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS,
                   watermark: str = "10 minutes") -> DataFrame:
    """The streaming plan (not started): closed sessions per user."""
    ev = events.select(F.col("user_id").alias("user"), F.col("event_type").alias("tool"),
                       F.col("ts").cast("timestamp").alias("ts"))
    gap = f"{gap_seconds * 1_000_000 + 1} microseconds"  # idle for exactly the gap is still the same session
    agg = ev.withWatermark("ts", watermark).groupBy("user", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
        F.array_sort(F.collect_set("tool")).alias("t"))
    return agg.select(
        "user", "session_start", "session_end", "n_events",
        ((F.unix_micros("session_end") - F.unix_micros("session_start")) / 1e6).alias("total_seconds"),
        F.size("t").cast("long").alias("n_tools"), F.array_join("t", ",").alias("tools_used"))


def run_sessions_stream(spark: SparkSession, sf_dir: str, gap_seconds: int = SESSION_GAP_SECONDS,
                        watermark: str = "10 minutes") -> DataFrame:
    """Run the stream over ``events.parquet`` (a file or a folder of files) and read the sink back."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    columns = ["user_id", "event_type", "ts"]
    schema = spark.read.parquet(path).select(*columns).schema  # footers only
    out = scratch_path(spark, "sessions-stream")
    spark.range(1).select(*(F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in schema)) \
        .write.parquet(f"{out}/end")
    # a stream source takes a folder or a pattern; this pattern names the file or the folder alike
    src = spark.readStream.schema(schema).parquet(path[:-1] + "[t]").unionByName(spark.readStream.schema(schema).parquet(f"{out}/end"))
    q = (session_stream(src, gap_seconds, watermark).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(OUT_SCHEMA).parquet(f"{out}/data").where(F.col("session_start") < F.lit(END).cast("timestamp"))
