"""Spark session helpers.

The cluster names a shared folder in ``spark.checkpoint.dir``; we read it from the session. Only a
local master may leave it unset (as in tests): it gets a fresh temp folder, anything else an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
#: On one machine only; a cluster brings its own.
LOCAL_CONF = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"}


def get_spark(master: str | None = None, app: str = "staffwise", conf: dict | None = None) -> SparkSession:
    """Get or create a session; ``master`` only matters for a fresh local session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = LOCAL_CONF if (master or "").startswith("local") else {}
    for k, v in {**CONF, **local, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # UTC everywhere: the oracle's timestamps are zone-less
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, else a fresh local one (tests only)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="staffwise-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique folder under the shared checkpoint dir (for stream sinks and state)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "staffwise", f"{name}-{uuid.uuid4().hex}")


def materialize(df):
    """Cut a lineage that several branches reuse: a Parquet table in the shared folder, so a lost
    executor cannot lose it and every reader prunes columns and pushes its filters down."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: list[str] = []  # written by ``materialize`` and not released yet


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote since the last call; how many there were. Call it when no result
    that was built before is needed any more: results read these tables when they are computed."""
    done = 0
    while _STORED:
        p = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        done += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return done
