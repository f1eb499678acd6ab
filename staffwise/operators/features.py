"""Feature preparation and splits (PRJ13, RSH5-RSH7, FLT6, CLN12, ML1, ML10, WIN3, WIN5).

Per-group windows and quantiles here run on datamart history, whose grain is one row per
(group, period): a group holds at most one row per day (or hour), so these partitions are bounded
by the length of the history, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffwise.constants import (ABN_EDGES_FRACTION, ABN_LABELS, Q2_EDGES, Q2_LABELS, SPLIT_SEED_BUCKETS,
                                 TRAIN_FRACTION, TRIM_QUANTILES)


def bucketize(c: Column, edges: list[float], labels: list[str]) -> Column:
    """RSH5: left-closed bins [e_i, e_i+1), the last one open; below the first edge or NULL -> NULL."""
    out = F.lit(None).cast("string")
    for i in range(len(edges)):          # the last edge ends up outermost: checked first
        out = F.when(c >= F.lit(float(edges[i])), F.lit(labels[i])).otherwise(out)
    return F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string")).otherwise(out)


def abn_edges(scale: float = 100.0) -> list[float]:
    """Q8: the ABN % edges in the unit of the data (percent points by default)."""
    return [e * scale for e in ABN_EDGES_FRACTION]


def one_hot(df: DataFrame, col: str, labels: list[str], prefix: str) -> DataFrame:
    """RSH6: 0/1 columns for every label but the first (drop_first); a NULL bucket is all zeros."""
    def name(lab: str) -> str:
        return prefix + "_" + lab.replace("%", "").replace("+", "_plus").replace("-", "_")
    return df.withColumns({name(lab): F.coalesce((F.col(col) == lab).cast("int"), F.lit(0)) for lab in labels[1:]})


def onehot_names(labels: list[str], prefix: str) -> list[str]:
    return [prefix + "_" + lab.replace("%", "").replace("+", "_plus").replace("-", "_") for lab in labels[1:]]


def ratios(df: DataFrame) -> DataFrame:
    """PRJ13: calls and demand per FTE (0 when staffing is 0 or, for calls, missing), abandon demand."""
    st = F.col("staffing")
    return df.withColumns({
        "abandon_demand": F.col("abn_pct") * F.col("demand"),
        "calls_per_fte": F.when(st.isNotNull() & (st != 0), F.col("calls") / st).otherwise(F.lit(0.0)),
        "demand_per_fte": F.when(F.col("demand").isNull() | (st == 0), F.lit(0.0))
        .otherwise(F.col("demand") / st),
    })


def trim_quantiles(df: DataFrame, keys: list[str], col: str = "staffing",
                   q=TRIM_QUANTILES) -> DataFrame:
    """FLT6: positive values, then keep [q_lo, q_hi] (linear interpolation, inclusive) per group."""
    pos = df.where(F.col(col) > 0)
    bounds = pos.groupBy(*keys).agg(F.percentile(col, q[0]).alias("_lo"), F.percentile(col, q[1]).alias("_hi"))
    return pos.join(bounds, keys).where(F.col(col).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def time_split(df: DataFrame, keys: list[str], date_col: str = "date",
               fraction: float = TRAIN_FRACTION) -> DataFrame:
    """WIN3: the date at row floor(fraction * n) of the date-sorted group splits train (<=) from test (>).

    Only per-date counts are windowed (no global row sort): the split date is the first date whose
    running count exceeds floor(fraction * n).
    """
    per_date = df.groupBy(*keys, date_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    run = per_date.withColumns({"_run": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    split = run.where(F.col("_run") > F.floor(F.col("_n") * F.lit(fraction))).groupBy(*keys).agg(
        F.min(date_col).alias("split_date"))
    return df.join(split, keys).withColumn(
        "part", F.when(F.col(date_col) <= F.col("split_date"), F.lit("train")).otherwise(F.lit("test")))


def hash_bucket(key: Column, buckets: int = SPLIT_SEED_BUCKETS) -> Column:
    """ML1: a repeatable bucket from the row key: first 8 hex digits of md5 mod ``buckets``."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """ML1: 80/20 split; bucket 0 of 5 is the test part."""
    b = hash_bucket(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]))
    return df.withColumn("bucket", b).withColumn(
        "part", F.when(F.col("bucket") == 0, F.lit("test")).otherwise(F.lit("train")))


def folds(df: DataFrame, keys: list[str], k: int = 5, date_col: str = "date") -> DataFrame:
    """WIN5: contiguous, unshuffled folds in date order (the first folds take the remainder)."""
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(*keys).orderBy(date_col)))


def fill_means(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """ML10: missing and infinite values as the mean of the group's finite ones; NULL where it has none."""
    finite = {c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)) for c in cols}  # NaN is above infinity
    means = df.groupBy(*keys).agg(*(F.avg(finite[c]).alias(f"_mean_{c}") for c in cols))
    return (df.join(means.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(f"_mean_{c}" for c in cols)),
                    [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
            .withColumns({c: F.coalesce(finite[c], F.col(f"_mean_{c}")) for c in cols}).select(df.columns))


def prepare_features(df: DataFrame, abn_scale: float = 100.0) -> DataFrame:
    """ML10: ratios, buckets, one-hot (first dropped), +-inf -> NULL on the ratios."""
    from staffwise.functions.clean import inf_to_null
    x = ratios(df).withColumns({
        "abn_bucket": bucketize(F.col("abn_pct"), abn_edges(abn_scale), ABN_LABELS),
        "q2_bucket": bucketize(F.col("q2"), [float(e) for e in Q2_EDGES], Q2_LABELS),
    })
    x = one_hot(one_hot(x, "abn_bucket", ABN_LABELS, "abn"), "q2_bucket", Q2_LABELS, "q2")
    return x.withColumns({c: inf_to_null(c) for c in ["calls_per_fte", "demand_per_fte", "abandon_demand"]})
