"""Activity sessions and tool dwell (ACT1-ACT4) as gaps-and-islands over sorted chunks.

Skew: one user, or one hour of a user, may hold a large share of all events. Events are therefore dealt by
range of (user, time, tool), so a chunk is as large as any other whatever the users, and a
user who fills several chunks has a piece of a timeline in each. Islands are found per (user, chunk).
An island that is neither the first nor the last of its chunk is final. The first and the
last one may go on in the neighbouring chunk: only these, at most two per user and chunk,
are put together per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffwise.constants import SESSION_GAP_SECONDS
from staffwise.session import materialize


def chunked(events: DataFrame, chunks: int | None = None) -> DataFrame:
    """``user, tool, ts, chunk``: chunks follow each other in the order of (user, ts, tool). Events without a
    time have no place on a timeline and are left out."""
    keys = ["user", "ts", "tool"]
    rows = events.where("ts IS NOT NULL").select(*keys).withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(chunks, *keys, "_tie") if chunks else rows.repartitionByRange(*keys, "_tie")
    return materialize(dealt.withColumn("chunk", F.spark_partition_id()).drop("_tie"))


def _islands(events: DataFrame, new: Column, order: list[str]) -> DataFrame:
    """Number the islands of every (user, chunk) from 1; ``new`` marks an event that begins one."""
    w = Window.partitionBy("user", "chunk").orderBy(*order)
    numbered = events.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return numbered.withColumn("isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _at_border() -> Column:
    """Whether an island is the first or the last one of its chunk."""
    return (F.col("isl") == 1) | (F.col("isl") == F.max("isl").over(Window.partitionBy("user", "chunk")))


def _seconds(until: Column, since: str) -> Column:
    return (F.unix_micros(until) - F.unix_micros(since)) / 1e6


def session_rows(events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, chunks: int | None = None) -> DataFrame:
    """ACT1: ``user, session_start, session_end, n_events, total_seconds, tools``; a session ends when the user is
    idle for more than ``gap_seconds``. ``tools`` is the sorted set of its tools, without nulls. Events without a
    user are those of one user."""
    gap = gap_seconds * 1_000_000
    wc = Window.partitionBy("user", "chunk").orderBy("ts")
    idle = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(wc))
    parts = _islands(chunked(events, chunks), idle > gap, ["ts"]).groupBy("user", "chunk", "isl").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n_events"),
        F.collect_set("tool").alias("tools")).withColumn("_border", _at_border())
    inner = parts.where(~F.col("_border"))
    wu = Window.partitionBy("user").orderBy("chunk", "isl")  # at most two rows a chunk
    idle = F.unix_micros("session_start") - F.unix_micros(F.lag("session_end").over(wu))
    pieces = (parts.where("_border").withColumn("_new", F.coalesce(idle > gap, F.lit(True)).cast("int"))
              .withColumn("sid", F.sum("_new").over(wu.rowsBetween(Window.unboundedPreceding, 0)))
              .select("*", F.explode_outer("tools").alias("tool"))
              .withColumn("_once", (F.coalesce(F.col("tool") == F.get("tools", F.lit(0)), F.lit(True))).cast("int")))
    joined = pieces.groupBy("user", "sid").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum(F.col("n_events") * F.col("_once")).alias("n_events"), F.collect_set("tool").alias("tools"))
    cols = ["user", "session_start", "session_end", "n_events", "tools"]
    return inner.select(cols).unionByName(joined.select(cols)).select(
        *cols[:4], _seconds(F.col("session_end"), "session_start").alias("total_seconds"), F.array_sort("tools").alias("tools"))


def sessions(events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, chunks: int | None = None) -> DataFrame:
    """ACT1 for reports: the sessions with the number of tools and their names joined by commas."""
    rows = session_rows(events, gap_seconds, chunks)
    return rows.select("user", "session_start", "session_end", "n_events", "total_seconds",
                       F.size("tools").cast("long").alias("n_tools"), F.array_join("tools", ",").alias("tools_used"))


def session_summary(rows: DataFrame) -> DataFrame:
    """ACT2: per user: sessions, total time, last activity, distinct tools over all of ``session_rows``."""
    once = F.col("pos").isNull() | (F.col("pos") == 0)
    return rows.select("*", F.posexplode_outer("tools").alias("pos", "tool")).groupBy("user").agg(
        F.count_if(once).alias("n_sessions"), F.sum(F.when(once, F.col("total_seconds"))).alias("total_seconds"),
        F.max("session_end").alias("ended_at"), F.sum(F.when(once, F.col("n_events"))).alias("n_events"),
        F.count_distinct("tool").alias("n_tools"))


def tool_dwell(events: DataFrame, chunks: int | None = None) -> DataFrame:
    """ACT3: one row per visit (a run of consecutive events on the same tool): user, tool, started,
    seconds until the next visit starts (or until the visit's last event for the user's last visit). Events
    without a tool are on the tool NULL."""
    wc = Window.partitionBy("user", "chunk").orderBy("ts", "tool")
    first = F.row_number().over(wc) == 1
    changed = first | ~F.col("tool").eqNullSafe(F.lag("tool").over(wc))
    runs = _islands(chunked(events, chunks), changed, ["ts", "tool"]).groupBy("user", "chunk", "isl").agg(
        F.first("tool").alias("tool"), F.min("ts").alias("started"), F.max("ts").alias("last"))
    runs = runs.withColumns({"_border": _at_border(),
                             "next": F.lead("started").over(Window.partitionBy("user", "chunk").orderBy("isl"))})
    inner = runs.where(~F.col("_border")).select("user", "tool", "started", F.col("next").alias("until"))
    wu = Window.partitionBy("user").orderBy("chunk", "isl")  # at most two rows a chunk
    # a run goes on in the next chunk if that one begins with the same tool; two runs of a chunk are two visits
    new = F.lag("chunk").over(wu).isNull() | (F.lag("chunk").over(wu) == F.col("chunk")) | ~F.col("tool").eqNullSafe(F.lag("tool").over(wu))
    visits = (runs.where("_border").withColumn("_new", new.cast("int"))
              .withColumn("visit", F.sum("_new").over(wu.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("user", "visit").agg(F.first("tool").alias("tool"), F.min("started").alias("started"),
                                            F.max("last").alias("last"), F.max("next").alias("next")))
    after = F.lead("started").over(Window.partitionBy("user").orderBy("visit"))
    outer = visits.select("user", "tool", "started", F.coalesce("next", after, "last").alias("until"))
    return inner.unionByName(outer).select("user", "tool", "started", _seconds(F.col("until"), "started").alias("seconds"))


def duration_text(seconds_col: str) -> Column:
    """ACT4: H:MM:SS text for the sink (the reference's MM:SS wraps at one hour; Q22)."""
    s = F.floor(F.col(seconds_col))
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)
