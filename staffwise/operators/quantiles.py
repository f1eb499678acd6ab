"""Buckets by quantiles (RSH7), their labels and codes (ML12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffwise.functions.mathx import stable

BUCKETS = 5
EDGE_DIGITS = 4
#: Accuracy of the sketch: an edge's rank is off by at most 1 / ACCURACY of the group's rows.
ACCURACY = 10_000


def quantile_edges(df: DataFrame, keys: list[str], col: str, buckets: int = BUCKETS, sketch: bool = False) -> DataFrame:
    """``keys, edges``: the group's quantiles at equal steps, rounded, without repeats, ascending.

    With fewer distinct values than ``buckets``, there are as many steps as values. Exact quantiles are interpolated and
    gather a group's distinct values in one task; ``sketch`` takes them from a mergeable
    summary of bounded size instead, whose ranks are off by at most 1 / ACCURACY of the rows. NULLs are no values; a group
    of NULLs has no edges.
    """
    def steps(n: int) -> list[float]:
        return [i / n for i in range(n + 1)]

    def at(n: int) -> Column:
        return F.percentile_approx(col, steps(n), ACCURACY) if sketch else F.percentile(col, F.array(*map(F.lit, steps(n))))

    found = df.groupBy(*keys).agg(F.count_distinct(col).alias("_n"), *(at(n).alias(f"_q{n}") for n in range(1, buckets + 1)))
    n = F.least("_n", F.lit(buckets))
    picked = F.coalesce(*(F.when(n == k, F.col(f"_q{k}")) for k in range(1, buckets + 1)))
    return found.select(*keys, F.array_sort(F.array_distinct(F.transform(picked, lambda e: stable(e, EDGE_DIGITS)))).alias("edges"))


def bucket_of(value: Column, edges: Column) -> Column:
    """Index of the left-closed bucket: below the first edge 0, from the last but one on the last bucket. NULL
    without two edges or a value."""
    passed = F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e <= value))
    return F.when(value.isNotNull() & (F.size(edges) >= 2), passed)


def bucket_labels(edges: Column) -> Column:
    """``lo%-hi%`` with two decimals, the last one ``lo%+``."""
    def text(e: Column) -> Column:
        return F.concat(F.format_string("%.2f", stable(e, 2)), F.lit("%"))
    last = F.size(edges) - 2
    return F.transform(F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), lambda e, i: F.when(
        i == last, F.concat(text(e), F.lit("+"))).otherwise(F.concat(text(e), F.lit("-"), text(F.get(edges, i + 1)))))


def quantile_buckets(df: DataFrame, keys: list[str], col: str, buckets: int = BUCKETS, sketch: bool = False) -> DataFrame:
    """RSH7 + ML12: ``df`` with ``n_buckets, bucket, label, code`` of ``col`` by its group's quantiles.

    ``code`` is the place of the label among the group's labels that occur, in alphabetical order. Labels of
    neighbouring buckets can be equal at two decimals; they then share a code.
    """
    edges = quantile_edges(df, keys, col, buckets, sketch)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    rows = (df.join(edges.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "edges"), on) if keys else df.crossJoin(edges)) \
        .withColumns({"n_buckets": F.greatest(F.size("edges") - 1, F.lit(0)), "bucket": bucket_of(F.col(col), F.col("edges")),
                      "_labels": bucket_labels(F.col("edges"))}) \
        .withColumn("label", F.get("_labels", F.col("bucket"))).select(*df.columns, "n_buckets", "bucket", "label")
    # at most `buckets` labels a group
    codes = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("_all"))
    codes = codes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_all")
    joined = rows.join(codes, on) if keys else rows.crossJoin(codes)
    return joined.withColumn("code", F.when(F.col("label").isNotNull(), F.array_position("_all", F.col("label")).cast("int") - 1)) \
        .select(*df.columns, "n_buckets", "bucket", "label", "code")
