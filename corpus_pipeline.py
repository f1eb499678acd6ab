"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokenization.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffwise.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from staffwise.llm.common import read, stored
from staffwise.llm.queries import VOCABULARY, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels), keep=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    cut = F.col("_removed") > 0
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, and of rows that share it, the first by
    fingerprint and text hash. Rows without an id are linked by nothing but an equal fingerprint: one of each fingerprint stays, unless
    a row with an id has it too."""
    row = docs.withColumn("_row", F.monotonically_increasing_id())
    row, path = stored(row, "pipeline-rows")  # the ids of rows must not change between the two uses
    fps, fps_path = stored(simhash.fingerprints(row.select("_row", "text"), id_col="_row", shingle=3), "pipeline-fingerprints")
    named = row.select("_row", "doc_id", F.xxhash64("text").alias("h")).join(fps.withColumnRenamed("id", "_row"), "_row")
    groups = simhash.groups_of(named.select(F.col("doc_id").alias("id"), "fp"), max_bits=2)
    of_fp = groups.where("id IS NOT NULL").groupBy("fp").agg(F.min("component").alias("component"))
    # the first row of each fingerprint is found before the join, so many copies are combined where they are
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("fp").alias("f"), "h", "_row"))
    of_each = named.groupBy("fp").agg(first.alias("first")).join(of_fp, "fp", "left")
    key = F.when(F.col("component").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("component").alias("name"))).otherwise(
        F.struct(F.lit(1).alias("kind"), F.col("fp").alias("name")))
    best = of_each.groupBy(key.alias("key")).agg(F.min("first").alias("first")).select(F.col("first._row").alias("_keep"))
    return row.join(best, row["_row"] == best["_keep"], "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return bpe.round_trip(docs, bpe.read_vocabulary(VOCABULARY), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_copies),
          ("decontamination", drop_contaminated), ("bpe", tokenize)]

#: Language-model scoring and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
