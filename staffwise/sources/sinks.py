"""Stored results: the datamart, report files and append-only logs (SNK1-SNK3, SNK5, SNK6, SRC2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_datamart(df: DataFrame, path: str) -> None:
    """SNK1: Parquet by language, so that a reader of one language prunes the others."""
    df.write.mode("errorifexists").partitionBy("language").parquet(path)


def read_datamart(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC2: a stored datamart as analysis input. The language is always text."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    return df.withColumn("language", df.language.cast("string"))


def write_report(df: DataFrame, path: str) -> None:
    """SNK2 / SNK3: CSV part files with a header. CSV can't tell empty text from NULL: both read back as NULL."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK5 / SNK6: add records to a log; earlier ones stay."""
    df.write.mode("append").parquet(path)
