"""Look-alike scenario analysis (JN5, JN8, AGG13-AGG20, SCN1-SCN8).

The reference answers one (group, week, demand change, staffing change) at a time by filtering
history with a two-dimensional band, up to 49 passes per report. Here every scenario of every
group is one row of a target table and one band join answers all of them in one pass.

Band join at scale: history is bucketed by log-demand with bucket width ln(1.1/0.9), so a target's
band [0.9t, 1.1t] touches at most two buckets. Each target is expanded to those buckets and the
join is an equi-join on (group keys, bucket) with the exact band test as a residual. A hot group is
thereby spread over its demand buckets instead of landing in one task, and the target side
(groups x scenarios x <=2) can be broadcast by AQE when its measured size allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffwise.constants import (BAND_HIGH, BAND_LOW, CAP_ABANDON_RATE, CAP_OCCUPANCY, CAP_SERVICE_LEVEL,
                                 CHANGE_STEPS, DAYS_PER_WEEK, PRODUCTIVE_MINUTES_PER_WEEK,
                                 RELIABILITY_LABELS, RELIABILITY_LOW_BELOW, RELIABILITY_MODERATE_MAX,
                                 STAFFING_UPLIFT, YEAR_WEIGHTS)
from staffwise.functions.clean import safe_delta
from staffwise.functions.mathx import cap

KEYS = ["language", "req_media", "usd", "level"]
KPIS = ["q2", "occupancy_rate", "abn_pct", "service_level"]
ABSOLUTE_STEPS = (1, -1, 5, -5, -1_000_000)  # FTE; the last one is floored at 0
ZERO_BUCKET = -(1 << 30)   # demand exactly 0 (only a zero target can match it)


def analysis_input(datamart: DataFrame, uplift: float = STAFFING_UPLIFT) -> DataFrame:
    """SRC2 + PRJ12 + PRJ1 + DAT5: datamart rows as analysis history (staffing uplifted once)."""
    return datamart.select(*KEYS, "date", F.year("date").alias("year"), "demand",
                           (F.col("staffing") * F.lit(uplift)).alias("staffing"),
                           F.col("staffing").alias("staffing_raw"), F.lit(uplift).alias("uplift"), "calls", "q2",
                           "occupancy_rate", "abn_pct", F.col("met").alias("service_level"), "occ_assumption")


def uplifted_mean() -> Column:
    """mean(staffing * uplift), computed as mean(staffing) * uplift: the sum stays exact, so the
    result does not depend on the order in which partitions are added."""
    return F.avg("staffing_raw") * F.first("uplift")


def call_weighted(k: str) -> Column:
    """AGG14: sum(k*calls)/sum(calls) when calls sum > 0, else the plain mean."""
    sc = F.sum("calls")
    return F.when(sc > 0, F.sum(F.col(k) * F.col("calls")) / sc).otherwise(F.avg(k))


def baseline(hist: DataFrame, week_start) -> DataFrame:
    """SCN1: per group, the week starting at ``week_start`` (a date string or Column)."""
    ws = F.to_date(F.lit(week_start)) if isinstance(week_start, str) else week_start
    wk = hist.where(F.col("date").between(ws, F.date_add(ws, 6)))                    # FLT2
    weekly = F.coalesce(F.sum("demand"), F.lit(0.0))
    return wk.groupBy(*KEYS).agg(
        weekly.alias("weekly_demand"),                                                    # AGG13
        (weekly / F.lit(float(DAYS_PER_WEEK))).alias("daily_demand"),
        *[call_weighted(k).alias(k) for k in KPIS],
        uplifted_mean().alias("staffing"),                                                # AGG15
        F.try_divide(weekly, F.lit(float(PRODUCTIVE_MINUTES_PER_WEEK)) * F.avg("occ_assumption"))
        .alias("fte_requirement"),                                                        # AGG20
        F.countDistinct("date").alias("days_present"),
    )


def change_table(spark: SparkSession, mode: str, steps=CHANGE_STEPS) -> DataFrame:
    """JN8: the scenario grid in percent: 'demand', 'staffing', 'double' (both directions of both)."""
    signed = sorted({s * d for s in steps for d in (1, -1)})
    if mode == "demand":
        rows = [(float(d), 0.0) for d in signed]
    elif mode == "staffing":
        rows = [(0.0, float(s)) for s in signed]
    elif mode == "double":
        rows = [(float(d), float(s)) for d in signed for s in signed]
    else:
        raise ValueError(mode)
    return spark.createDataFrame(rows, "demand_change double, staffing_change double")


MAX_CHANGES = 10_000


def targets(base: DataFrame, changes: DataFrame, absolute: bool = False) -> DataFrame:
    """SCN2: per group and scenario the target demand / staffing; scenario (0, 0) is the origin.

    Changes are percentages; with ``absolute`` the staffing change is a number of FTE, and the target
    is 0 at least. ``changes`` may have up to MAX_CHANGES different rows: it is broadcast, so its size is checked.
    """
    staffing = F.col("staffing")
    moved = F.when(staffing.isNotNull(), F.greatest(F.lit(0.0), staffing + F.col("staffing_change"))) if absolute \
        else staffing * (F.lit(1.0) + F.col("staffing_change") / 100.0)
    origin = base.sparkSession.createDataFrame([(0.0, 0.0)], "demand_change double, staffing_change double")
    grid = changes.withColumn("requested", F.lit(True)).unionByName(origin.withColumn("requested", F.lit(False))) \
        .groupBy("demand_change", "staffing_change").agg(F.max("requested").alias("requested"))
    if grid.limit(MAX_CHANGES + 1).count() > MAX_CHANGES:
        raise ValueError(f"more than {MAX_CHANGES} scenarios")
    t = base.crossJoin(F.broadcast(grid))
    return t.withColumns({
        "new_demand": F.col("daily_demand") * (F.lit(1.0) + F.col("demand_change") / 100.0),
        "new_staffing": moved,
    }).withColumn("valid", F.col("new_demand") > 0)


def _bucket(x: Column) -> Column:
    w = math.log(BAND_HIGH / BAND_LOW)
    return F.when(x > 0, F.floor(F.ln(x) / F.lit(w))).when(x == 0, F.lit(ZERO_BUCKET))


def band_join(hist: DataFrame, tgt: DataFrame) -> DataFrame:
    """JN5: history rows whose demand and staffing fall in [0.9, 1.1] x the scenario's targets."""
    lo, hi = F.lit(BAND_LOW) * F.col("new_demand"), F.lit(BAND_HIGH) * F.col("new_demand")
    t = tgt.select(*KEYS, "demand_change", "staffing_change",
                   F.col("new_demand").alias("t_demand"), F.col("new_staffing").alias("t_staffing"),
                   F.explode(F.when(lo <= hi, F.sequence(_bucket(lo), _bucket(hi)))
                             .otherwise(F.array().cast("array<bigint>"))).alias("bucket")).alias("t")
    h = hist.select(*KEYS, "demand", "staffing", "year", "calls", *KPIS,
                    _bucket(F.col("demand")).alias("bucket")).where(F.col("bucket").isNotNull()).alias("h")
    cond = [F.col(f"h.{k}") == F.col(f"t.{k}") for k in [*KEYS, "bucket"]] + [
        F.col("h.demand").between(F.lit(BAND_LOW) * F.col("t.t_demand"), F.lit(BAND_HIGH) * F.col("t.t_demand")),
        F.col("h.staffing").between(F.lit(BAND_LOW) * F.col("t.t_staffing"),
                                    F.lit(BAND_HIGH) * F.col("t.t_staffing")),
    ]
    return h.join(t, cond).select(*[F.col(f"t.{k}").alias(k) for k in KEYS], "t.demand_change", "t.staffing_change",
                                  *[F.col(f"h.{c}").alias(c) for c in ["year", "calls", *KPIS]])


def year_weighted(k: str, reference_year: int) -> Column:
    """AGG16: sum(k * w) / sum(w) with w = 0.6 / 0.2 / 0.2 for the reference year and the two
    before (rows of other years carry no weight). Evaluated as per-year sums combined in a fixed
    order, which is the same quantity but independent of partition order."""
    num, den = F.lit(0.0), F.lit(0.0)
    for back, wt in sorted(YEAR_WEIGHTS.items()):
        in_year = F.col("year") == F.lit(reference_year - back)
        num = num + F.lit(wt) * F.coalesce(F.sum(F.when(in_year, F.col(k))), F.lit(0.0))
        den = den + F.lit(wt) * F.count(F.when(in_year, F.lit(1))).cast("double")
    return F.try_divide(num, den)


def reliability(n: Column) -> Column:
    """AGG19."""
    low, mid, high = RELIABILITY_LABELS
    return F.when(n < RELIABILITY_LOW_BELOW, F.lit(low)).when(n <= RELIABILITY_MODERATE_MAX, F.lit(mid)) \
        .otherwise(F.lit(high))


def _band_stats(hist: DataFrame, tgt: DataFrame, how: str, reference_year: int | None) -> DataFrame:
    m = band_join(hist, tgt)
    sk = [*KEYS, "demand_change", "staffing_change"]
    if how == "weighted":
        aggs = [year_weighted(k, reference_year).alias(f"m_{k}") for k in KPIS]
    elif how == "unweighted":
        aggs = [F.avg(k).alias(f"m_{k}") for k in KPIS]
    else:  # direct: call-weighted mean of the target band
        aggs = [call_weighted(k).alias(f"m_{k}") for k in KPIS]
    stats = m.groupBy(*sk).agg(F.count(F.lit(1)).alias("n_matches"), *aggs)
    return tgt.join(stats, sk, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def evaluate(hist: DataFrame, week_start: str | None, changes: DataFrame, how: str = "weighted",
             reference_year: int | None = None, absolute: bool = False) -> DataFrame:
    """SCN3 / SCN4 / SCN5 for every scenario in ``changes`` and every group with data in the week.

    weighted   (SCN3): year-weighted band means; KPI moves by the relative change between the
                       target band and the origin band; occupancy and service level capped at 1,
                       abandon rate at 100.
    unweighted (SCN4): plain band means, safe relative change, no caps (no service level).
    direct     (SCN5): the call-weighted mean of the target band is the new KPI.
    """
    if week_start is None:
        # DAT6 default, as the reference: the latest Sunday present in the history (one small action)
        from staffwise.functions.dates import latest_sunday
        latest = hist.agg(latest_sunday(F.col("date"))).first()[0]
        if latest is None:
            raise ValueError("the history holds no Sunday: name a week")
        week_start = str(latest)
    if how == "weighted" and reference_year is None:
        reference_year = hist.agg(F.max("year")).first()[0]  # Q14 default: latest year in the data
    base = baseline(hist, week_start)
    tgt = targets(base, changes, absolute)
    st = _band_stats(hist, tgt, how, reference_year)
    report_keys = [*KEYS, "demand_change", "staffing_change"]
    if how == "direct":
        new = {k: F.col(f"m_{k}") for k in KPIS}
        out = st
    else:
        origin = st.where((F.col("demand_change") == 0) & (F.col("staffing_change") == 0)).select(
            *KEYS, *[F.col(f"m_{k}").alias(f"o_{k}") for k in KPIS])
        out = st.join(origin, KEYS, "left")
        if how == "weighted":
            delta = {k: F.try_divide(F.col(f"m_{k}") - F.col(f"o_{k}"), F.col(f"o_{k}")) for k in KPIS}
            new = {"q2": F.col("q2") * (1 + delta["q2"]),
                   "occupancy_rate": cap(F.col("occupancy_rate") * (1 + delta["occupancy_rate"]), CAP_OCCUPANCY),
                   "abn_pct": cap(F.col("abn_pct") * (1 + delta["abn_pct"]), CAP_ABANDON_RATE),
                   "service_level": cap(F.col("service_level") * (1 + delta["service_level"]), CAP_SERVICE_LEVEL)}
        else:
            new = {k: F.col(k) * (1 + safe_delta(F.col(f"m_{k}"), F.col(f"o_{k}"))) for k in KPIS[:3]}
            new["service_level"] = F.col("service_level")
    return out.where(F.col("requested")).select(
        *report_keys, "fte_requirement", "weekly_demand", "daily_demand", "new_demand", "staffing", "new_staffing",
        *[c for k in KPIS for c in (F.col(k).alias(k), new[k].alias(f"new_{k}"))],
        "n_matches", reliability(F.col("n_matches")).alias("reliability"), "valid",
    )


def weekly_kpi(hist: DataFrame) -> DataFrame:
    """SCN1 for every week (Sunday-based) of every group: demand, call-weighted KPIs, FTE requirement."""
    from staffwise.functions.dates import sunday_on_or_before
    weekly = F.coalesce(F.sum("demand"), F.lit(0.0))
    return hist.groupBy(*KEYS, sunday_on_or_before(F.col("date")).alias("week")).agg(
        weekly.alias("weekly_demand"),
        (weekly / F.lit(float(DAYS_PER_WEEK))).alias("daily_demand"),
        *[call_weighted(k).alias(k) for k in KPIS],
        uplifted_mean().alias("staffing"),
        F.max("staffing").alias("max_staffing"),
        F.try_divide(weekly, F.lit(float(PRODUCTIVE_MINUTES_PER_WEEK)) * F.avg("occ_assumption"))
        .alias("fte_requirement"),
        F.countDistinct("date").alias("days_present"),
    )
