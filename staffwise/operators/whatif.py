"""What-if models with held-out accuracy (ML4, ML5, SCN13-SCN15, SNK5's records).

Both fit one model per group from moments of the train part; the datamart's grain (one row per group
and day) bounds what a group's split window and medians hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffwise.functions.dates import week_days
from staffwise.operators import features as fe
from staffwise.operators import models as mo

WEEK_FEATURES = ["demand", "q2", "occupancy_rate", "occ_assumption"]
KPI_FEATURES = ["q2", "abn_pct", "occ_assumption", "staffing", "occupancy_rate"]


def requirement_accuracy(hist: DataFrame, keys: list[str]) -> DataFrame:
    """ML4 + ML11: requirement on the week features, fitted on the earlier 70 % of each group's days;
    one row per group and part with its errors. Scaling the features would not change a prediction.
    """
    rows = hist.select(*keys, "date", *WEEK_FEATURES, "requirement").na.drop()
    parts = fe.time_split(rows, keys)
    coef = mo.fit_ols(parts.where("part = 'train'"), keys, WEEK_FEATURES, "requirement")
    scored = parts.join(coef, keys).withColumn("pred", mo.predict(WEEK_FEATURES))
    return mo.metrics(scored, [*keys, "part"], "requirement")


def fte_week(hist: DataFrame, week_start: str, keys: list[str], changes: list[float]) -> DataFrame:
    """ML4 + SCN13: the requirement of each day of a week with that day's demand changed by percentages.

    The model is that of ``requirement_accuracy``; the other features are the week's means. A day without
    rows has demand 0 and no actual requirement. Groups without rows in the week are left out.
    """
    rows = hist.select(*keys, "date", *WEEK_FEATURES, "requirement")
    train = fe.time_split(rows.na.drop(), keys).where("part = 'train'")
    coef = mo.fit_ols(train, keys, WEEK_FEATURES, "requirement")
    start = F.to_date(F.lit(week_start))
    week = rows.where(F.col("date").between(start, F.date_add(start, 6)))
    daily = week.groupBy(*keys, "date").agg(F.avg("demand").alias("demand"), F.avg("requirement").alias("actual"))
    means = week.groupBy(*keys).agg(*(F.avg(f).alias(f) for f in WEEK_FEATURES if f != "demand"))
    grid = hist.sparkSession.createDataFrame([(float(c),) for c in changes], "change double")
    days = (means.withColumn("date", F.explode(week_days(start))).join(daily, [*keys, "date"], "left")
            .withColumn("day_demand", F.coalesce("demand", F.lit(0.0))).join(coef, keys)
            .crossJoin(F.broadcast(grid))  # the grid is the caller's list
            .withColumn("demand", F.col("day_demand") * (1 + F.col("change") / 100.0)))
    return days.select(*keys, "change", "date", "day_demand", F.col("demand").alias("new_demand"), "actual",
                       mo.predict(WEEK_FEATURES).alias("prediction"))


def fte_week_totals(days: DataFrame, keys: list[str]) -> DataFrame:
    """SCN13's summary of ``fte_week``: daily means, weekly totals and the change of the requirement in percent.

    Days without an actual requirement don't count in its mean."""
    actual, predicted = F.avg("actual"), F.avg("prediction")
    return days.groupBy(*keys, "change").agg(
        F.avg("day_demand").alias("daily_demand"), actual.alias("daily_actual"), predicted.alias("daily_predicted"),
        (actual * 7).alias("weekly_actual"), (predicted * 7).alias("weekly_predicted"),
        (F.try_divide(predicted - actual, actual) * 100).alias("change_pct"))


def kpi_per_fte(hist: DataFrame, week: DataFrame, keys: list[str], changes: list[float]) -> DataFrame:
    """ML5 + SCN15: all KPIs of the week moved by the same percentage, per group.

    ``hist`` trains the model (80 % of the rows by hash); the rows of ``week`` give the mean KPIs and
    the median calls and staffing. Rates are fractions in, percent out. Without staffing, calls per
    FTE are 0.
    """
    train = fe.hash_split(hist, [*keys, "date"]).where("part = 'train'")
    coef = mo.fit_ols(train, keys, KPI_FEATURES, "requirement")
    middle = week.groupBy(*keys).agg(F.median("calls").alias("calls"), F.median("staffing").alias("staffing"),
                                     *(F.avg(k).alias(k) for k in KPI_FEATURES if k != "staffing"))
    grid = hist.sparkSession.createDataFrame([(float(c),) for c in changes], "change double")
    up = 1 + F.col("change") / 100.0
    moved = (middle.join(coef, keys).crossJoin(F.broadcast(grid))  # the grid is the caller's list
             .withColumns({k: F.col(k) * up for k in KPI_FEATURES if k != "staffing"}))
    per_fte = F.coalesce(F.try_divide(F.col("calls") * up, F.col("staffing")), F.lit(0.0))
    prediction = mo.predict(KPI_FEATURES)
    return moved.select(
        *keys, "change", F.bround(per_fte, 2).alias("calls_per_fte"), prediction.alias("prediction"),
        F.bround(prediction, 2).alias("fte"), F.bround("q2", 2).alias("q2"), F.bround("abn_pct", 2).alias("abn_pct"),
        F.bround(F.col("occupancy_rate") * 100, 2).alias("occupancy_pct"),
        F.bround(F.col("occ_assumption") * 100, 2).alias("occ_assumption_pct"))
