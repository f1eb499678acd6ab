"""Readers for the driver's parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with an explicit projection so only the needed columns are read."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    # the generator writes zone-less timestamps (TIMESTAMP_NTZ); cast them to session-zone timestamps
    casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields
             if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df
