"""Staffing by a random forest, and what moves it (ML9, ML10, SCN16).

One forest per language of a chosen (medium, usd, level), fitted by Spark ML on the datamart's rows: a
first one on all features, a second one on those that matter. Fits run one after another on the
driver, one per language; each is distributed over the rows. The grid of changes is scored by the
fitted pipeline as one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffwise.constants import (ABN_LABELS, FOREST_SEED, FOREST_TREES, IMPORTANCE_THRESHOLD, Q2_LABELS,
                                 STAFFING_UPLIFT)
from staffwise.operators import features as fe

LABEL = "staffing"
MEASURES = ["abns", "calls", "q2", "aht", "abn_pct", "met", "missed", "demand", "occ_assumption", "requirement",
            "occupancy_rate", "staffing_diff", "abandon_demand", "calls_per_fte", "demand_per_fte"]
DUMMIES = [*fe.onehot_names(ABN_LABELS, "abn"), *fe.onehot_names(Q2_LABELS, "q2")]
FEATURES = [*MEASURES, *DUMMIES]
DEPTH, BINS = 10, 32    # Spark grows trees level by level over binned features
PARTS = 2               # partitions of a group's rows, one per day
PERCENTS = list(range(-100, 101))


def forest_rows(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The forest's table: lifted staffing within its 5-95 % quantiles, prepared features, missing values as the
    group's mean (0 where a group has none), split 70/30 by date. One row per group and day."""
    rows = fe.trim_quantiles(hist.withColumn(LABEL, F.col(LABEL) * STAFFING_UPLIFT), keys, LABEL)
    rows = fe.fill_means(fe.prepare_features(rows), keys, MEASURES).na.fill(0.0, subset=MEASURES)
    return fe.time_split(rows.select(*keys, "date", LABEL, *FEATURES), keys)


def pipeline(features: list[str], label: str, trees: int, depth: int) -> Pipeline:
    """Assembled and scaled features into a forest that looks at every feature of a bootstrap sample at each split."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestRegressor(featuresCol="scaled", labelCol=label, predictionCol="prediction", numTrees=trees, maxDepth=depth,
                              maxBins=BINS, featureSubsetStrategy="all", seed=FOREST_SEED)])


@dataclass
class Forest:
    model: PipelineModel
    features: list[str]               # those it was fitted on again
    importances: dict[str, float]     # of the first fit, over all features; they add up to 1


def fit_forest(train: DataFrame, features: list[str], label: str = LABEL, trees: int = FOREST_TREES, depth: int = DEPTH,
               least: float = IMPORTANCE_THRESHOLD) -> Forest | None:
    """ML9: fit on all features, keep those of importance ``least`` or more, fit on these again.

    A label without spread has no splits, so no feature matters: None, as for a table without rows. Rows are dealt by their sorted
    features, so that the bootstrap samples don't depend on how the table happens to lie.
    """
    rows = train.select(label, *features).na.drop()
    if not rows.limit(1).count():
        return None
    rows = rows.repartitionByRange(PARTS, label, *features).sortWithinPartitions(label, *features).cache()
    try:
        first = pipeline(features, label, trees, depth).fit(rows)
        weights = dict(zip(features, map(float, first.stages[-1].featureImportances.toArray())))
        kept = [f for f in features if weights[f] >= least]
        return Forest(pipeline(kept, label, trees, depth).fit(rows), kept, weights) if kept else None
    finally:
        rows.unpersist()


def scores(forest: Forest, parts: DataFrame, label: str = LABEL) -> dict[str, tuple[int, float | None]]:
    """``part -> (rows, R2)``; a part without spread has no R2."""
    e = F.col(label) - F.col("prediction")
    got = forest.model.transform(parts).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(F.lit(1)))).alias("r2"))
    return {r["part"]: (r["n"], r["r2"]) for r in got.collect()}  # two rows


def staffing_effect(model: PipelineModel, features: list[str], week: DataFrame, keys: list[str],
                    percents: list[int] = PERCENTS) -> DataFrame:
    """SCN16: staffing predicted with one feature's weekly mean changed by a percentage, against no change.

    One row per group of ``week``, feature and percentage; a group without rows in the week has none.
    A prediction of 0 has no change in percent.
    """
    means = week.groupBy(*keys).agg(*(F.avg(f).alias(f) for f in features)).na.drop(subset=features)
    moved = means.select(*keys, *features, F.explode(F.array(*map(F.lit, features))).alias("feature")).select(
        "*", F.explode(F.array(*(F.lit(float(p)) for p in percents))).alias("change"))
    value = F.coalesce(*(F.when(F.col("feature") == f, F.col(f)) for f in features))
    moved = moved.withColumns({"base_value": value, **{
        f: F.when(F.col("feature") == f, F.col(f) * (1 + F.col("change") / 100.0)).otherwise(F.col(f)) for f in features}})
    base = model.transform(means).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("prediction").alias("base_staffing"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    difference = F.col("prediction") - F.col("base_staffing")
    return model.transform(moved).join(base, same).select(
        *keys, "feature", "change", "base_value", (F.col("base_value") * (1 + F.col("change") / 100.0)).alias("new_value"),
        "base_staffing", F.col("prediction").alias("new_staffing"), difference.alias("difference"),
        (F.try_divide(difference, F.col("base_staffing")) * 100).alias("difference_pct"))
