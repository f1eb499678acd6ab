"""Planner roll-ups over (usd, level) written as cubes (AGG8-AGG12, AGG25).

The reference spells every combined column out by hand; here each family is one grouping-sets
aggregate inside (workbook, sheet, week), with 'Combined' standing for a rolled-up dimension.
Sums skip missing cells (SQL semantics) and ``n_missing`` counts them (Q21). A weighted family and
its weights come to one row per cell of the cube by an aggregate, so the facts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffwise.constants import COMBINED, DETAIL_LEVELS, DETAIL_USD, STAFFING_FAMILIES
from staffwise.operators.planner import is_site_workbook

WEEK_KEYS = ["workbook", "sheet", "week"]
VOLUME = "Volume (ACTUAL)"
WEIGHTED = ["AHT (ACTUAL)", "OCC Assumptions"]
SITE_WEIGHTED = ["AHT (ACTUAL)", "OCC Assumptions", "Occupancy Rate", "Q4 Time"]
SITES = ["OLY", "BOA"]


def _detail(facts: DataFrame, *families: str) -> DataFrame:
    return facts.where(F.col("family").isin(*families) & F.col("usd").isin(DETAIL_USD)
                       & F.col("level").isin(DETAIL_LEVELS))


def _cube(df: DataFrame, *aggs: Column) -> DataFrame:
    """cube(usd, level) inside each week: four grouping sets, one aggregation pass."""
    sets = [[*WEEK_KEYS, "usd", "level"], [*WEEK_KEYS, "usd"], [*WEEK_KEYS, "level"], WEEK_KEYS]
    g = df.groupingSets(sets, *WEEK_KEYS, "usd", "level").agg(*aggs)
    return g.withColumns({"usd": F.coalesce("usd", F.lit(COMBINED)), "level": F.coalesce("level", F.lit(COMBINED))})


def rollup_volume(facts: DataFrame) -> DataFrame:
    """AGG8: volume per (usd, level) including every Combined cell."""
    return _cube(_detail(facts, VOLUME), F.sum("value").alias("volume"),
                 F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"))


def _beside_volume(facts: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    """One row per ``keys`` and family that has a cell there and a volume cell: ``family, value, volume``."""
    def of(f: str) -> Column:
        return F.col("family") == f
    wide = facts.groupBy(*keys).agg(
        F.max(F.when(of(VOLUME), F.col("value"))).alias("volume"), F.count_if(of(VOLUME)).alias("_volumes"),
        F.array(*(F.struct(F.lit(f).alias("family"), F.max(F.when(of(f), F.col("value"))).alias("value"),
                           F.count_if(of(f)).alias("cells")) for f in families)).alias("_f"))
    return wide.where("_volumes > 0").select(*keys, "volume", F.inline("_f")).where("cells > 0").drop("cells")


def _weighted_mean() -> Column:
    w = F.when(F.col("value").isNotNull(), F.col("volume"))
    return F.try_divide(F.sum(F.col("value") * F.col("volume")), F.sum(w)).alias("weighted")


def rollup_weighted(facts: DataFrame, families: list[str] = WEIGHTED) -> DataFrame:
    """AGG9 / AGG10: volume-weighted family values at every (usd, level) roll-up; NULL when the volume is 0."""
    x = _beside_volume(_detail(facts, VOLUME, *families), [*WEEK_KEYS, "usd", "level"], families)
    sets = [[*WEEK_KEYS, "family", *d] for d in (["usd", "level"], ["usd"], ["level"], [])]
    g = x.groupingSets(sets, *WEEK_KEYS, "family", "usd", "level").agg(_weighted_mean(), F.sum("volume").alias("volume"))
    return g.withColumns({"usd": F.coalesce("usd", F.lit(COMBINED)), "level": F.coalesce("level", F.lit(COMBINED))})


def rollup_staffing(facts: DataFrame) -> DataFrame:
    """AGG11: the six staffing metrics, USD + Global per level."""
    return _detail(facts, *STAFFING_FAMILIES).groupBy(*WEEK_KEYS, "level", "family").agg(F.sum("value").alias("value")) \
        .withColumn("usd", F.lit(COMBINED))


def site_of_header(metric: Column) -> Column:
    """The site that a metric of a workbook by site names."""
    return F.coalesce(*(F.when(metric.contains(s), F.lit(s)) for s in SITES))


def rollup_site(facts: DataFrame, families: list[str] = SITE_WEIGHTED) -> DataFrame:
    """AGG12: four families of the workbooks by site, weighted by the volume of their sites, beside each site's own."""
    sited = facts.where(is_site_workbook(F.col("workbook")) & F.col("family").isin(VOLUME, *families)) \
        .withColumn("site", site_of_header(F.col("metric"))).where("site IS NOT NULL")
    x = _beside_volume(sited, [*WEEK_KEYS, "site"], families)
    g = x.groupingSets([[*WEEK_KEYS, "family", "site"], [*WEEK_KEYS, "family"]], *WEEK_KEYS, "family", "site").agg(
        _weighted_mean(), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_sites"))
    return g.withColumn("site", F.coalesce("site", F.lit(COMBINED)))


def derived(facts: DataFrame) -> DataFrame:
    """The combined metrics as facts with names of their own, beside the details: what a choice selects from.

    Sheets by usd and level get volume, weighted and staffing roll-ups; workbooks by site their weighted families.
    Video sheets have no further ones.
    """
    def named(df: DataFrame, value: str) -> DataFrame:
        usd, level, family = F.col("usd"), F.col("level"), F.col("family")
        metric = F.when(family == "OCC Assumptions", F.concat(usd, F.lit(" OCC Assumptions ("), level, F.lit("):"))).otherwise(
            F.concat_ws(" ", usd, level, family))
        return df.where((usd == COMBINED) | (level == COMBINED)).select(
            *WEEK_KEYS, metric.alias("metric"), "family", "usd", "level", F.col(value).alias("value"))

    sites = rollup_site(facts).where(F.col("site") == COMBINED).select(*WEEK_KEYS, F.when(
        F.col("family") == "OCC Assumptions", F.lit("Combined Combined OCC Assumptions:")).otherwise(
        F.concat(F.lit("Combined Combined "), F.col("family"))).alias("metric"), "family", F.lit(COMBINED).alias("usd"),
        F.lit(COMBINED).alias("level"), F.col("weighted").alias("value"))
    out = named(rollup_volume(facts).withColumn("family", F.lit(VOLUME)), "volume") \
        .unionByName(named(rollup_weighted(facts), "weighted")).unionByName(named(rollup_staffing(facts), "value"))
    return facts.unionByName(out).unionByName(sites)
