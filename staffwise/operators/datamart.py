"""KPI datamart: calls + FTE + occupancy assumption + occupancy rate (JN1-JN4, CLN10, PRJ8, WIN1, FLT5).

All languages are built in one plan (the reference builds one language per run); every key, mean
and window is therefore scoped by language. The grain is one row per (date|hour, language, usd,
req_media, level), so the lag window partitions hold at most one row per period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffwise.constants import DAYS_PER_WEEK, PRODUCTIVE_MINUTES_PER_WEEK
from staffwise.functions.clean import impute_mean
from staffwise.session import materialize

GROUP_KEYS = ["language", "usd", "req_media", "level"]
DATAMART_COLUMNS = ["language", "usd", "req_media", "level", "abns", "calls", "q2", "aht", "abn_pct", "met",
                    "missed", "demand", "occ_assumption", "requirement", "staffing", "occupancy_rate",
                    "staffing_diff"]


def build_datamart(calls: DataFrame, fte_comb: DataFrame, assumption: DataFrame, occ: DataFrame,
                   media: str = "OPI", time_col: str = "date", assumption_join: str = "inner",
                   minutes_per_period: float = PRODUCTIVE_MINUTES_PER_WEEK / DAYS_PER_WEEK,
                   uplift: float = 1.0) -> DataFrame:
    """The datamart of one planner kind (``media`` 'OPI' or 'VIDEO').

    calls:      (time, language, usd, req_media, level, abns, calls, q2, aht, abn_pct, met, missed)
    fte_comb:   (time, language, usd, level, total_opi, total_vri) incl. combined rows
    assumption: (time, language, usd, level, occ_assumption), unique per key
    occ:        (time, language, usd, level, req_media, occ)
    """
    t = time_col
    j = calls.join(fte_comb, [t, "usd", "language", "level"], "left")                       # JN1
    j = j.join(assumption, [t, "level", "usd", "language"], assumption_join)                # JN2 / JN3
    j = j.join(occ, [t, "language", "usd", "level", "req_media"], "inner")                  # JN4
    # CLN10 per language. The joined rows are stored, so the means (partial sums, one row per language)
    # are joined back without a second run of the plan, and no task holds a whole language.
    j = impute_mean(materialize(j), ["occ_assumption", "occ"], by=["language"])
    staffing = F.col("total_opi") if media == "OPI" else F.col("total_vri")
    demand = F.col("calls") * F.col("aht")
    w = Window.partitionBy(*GROUP_KEYS).orderBy(t)
    out = j.select(
        t, *[c for c in DATAMART_COLUMNS[:11]],
        demand.alias("demand"),
        "occ_assumption",
        F.try_divide(demand, F.lit(minutes_per_period) * F.col("occ_assumption")).alias("requirement"),  # PRJ8
        staffing.alias("staffing"),
        F.col("occ").alias("occupancy_rate"),
    ).withColumn("staffing_diff", F.col("staffing") - F.lag("staffing").over(w))           # WIN1
    out = out.withColumn("staffing", F.col("staffing") * uplift)  # hour-wise only; the difference is of plain staffing
    return out.where(F.col("req_media") == media)                                            # FLT5


def assumption_daily(occ_combined: DataFrame) -> DataFrame:
    """Daily assumption per (date, language, usd, level) from the combined weekly table (RSH1)."""
    from staffwise.operators.planner import to_daily
    return to_daily(occ_combined.select(F.col("workbook").alias("language"), "week", "usd", "level",
                                        "occ_assumption"))


def assumption_hourly(occ_combined: DataFrame) -> DataFrame:
    from staffwise.operators.planner import to_hourly
    return to_hourly(occ_combined.select(F.col("workbook").alias("language"), "week", "usd", "level",
                                         "occ_assumption"))
