"""Shared plan fragments: the cleaned inputs, the planner facts and the day-wise datamart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffwise.constants import STAFFING_UPLIFT
from staffwise.functions.clean import convert_fte, convert_hybrid, convert_occ
from staffwise.functions.dates import lenient_day, lenient_minute
from staffwise.operators import fte as fte_ops
from staffwise.operators import planner as pl
from staffwise.operators.datamart import assumption_daily, assumption_hourly, build_datamart
from staffwise.session import materialize
from staffwise.sources import adapters as ad

# fixed test parameters
WEEK_START = "2001-06-03"
REFERENCE_YEAR = 2001


def calls(spark: SparkSession, sf: str, stats: DataFrame | None = None) -> DataFrame:
    return ad.calls_day(spark, sf, stats)


def fte_clean(spark: SparkSession, sf: str, stats: DataFrame | None = None, parse=lenient_day) -> DataFrame:
    """T2 through its converter (typed export written as text, then cleaned)."""
    raw = ad.fte_day(spark, sf, stats).withColumn("date_text", F.col("date").cast("string")) \
        .withColumn("weekly_ftes", F.col("weekly_ftes").cast("string"))
    return convert_fte(raw, parse=parse)


def occ_clean(spark: SparkSession, sf: str, stats: DataFrame | None = None, parse=lenient_day) -> DataFrame:
    raw = ad.occ_day(spark, sf, stats).withColumn("date_text", F.col("date").cast("string")) \
        .withColumn("occ", F.col("occ").cast("string"))
    return convert_occ(raw, parse=parse)


def hybrid_clean(spark: SparkSession, sf: str) -> DataFrame:
    return convert_hybrid(ad.hybrid_shares(spark, sf))


def fte_pivoted(spark: SparkSession, sf: str, stats: DataFrame | None = None) -> DataFrame:
    return fte_ops.fte_pivot(fte_clean(spark, sf, stats))


def language_shares(spark: SparkSession, sf: str, pivoted: DataFrame) -> DataFrame:
    m = fte_ops.match_languages(pivoted.select("language"), hybrid_clean(spark, sf))
    return m.select(F.col("code").alias("language"), "l4_hybrid_pct", "l5_hybrid_pct")


def fte_totals(spark: SparkSession, sf: str, shared: bool = False, stats: DataFrame | None = None) -> DataFrame:
    p = materialize(fte_pivoted(spark, sf, stats))  # the languages and the split read it, lineitem is read once
    return fte_ops.hybrid_split(p, language_shares(spark, sf, p), shared=shared)


def fte_comb(spark: SparkSession, sf: str, stats: DataFrame | None = None) -> DataFrame:
    return fte_ops.fte_combined(materialize(fte_totals(spark, sf, stats=stats)))


def planner_facts(spark: SparkSession, sf: str, families: list[str] | None = None) -> DataFrame:
    """Weekly facts, stored: one pass over orders however many branches read them."""
    return materialize(pl.shape_planner(materialize(ad.planner_cells(spark, sf)), families=families))


def workbook_facts(spark: SparkSession, sf: str, sheets: list[str] | None = None, families: list[str] | None = None) -> DataFrame:
    """Weekly facts of all workbooks and kinds of sheet, stored; ``sheets`` asks for some, which must be there."""
    return materialize(pl.shape_planner(materialize(ad.planner_workbooks(spark, sf)), sheets, families))


ASSUMPTIONS = ["OCC Assumptions"]


def occ_combined(spark: SparkSession, sf: str, media: str = "OPI") -> DataFrame:
    """The assumptions of the medium's own sheet, details and Combined levels."""
    if media == "VIDEO":
        return pl.occ_video(workbook_facts(spark, sf, [ad.VIDEO_SHEET], ASSUMPTIONS))
    return pl.occ_combined_mean(pl.occ_assumptions(planner_facts(spark, sf, ASSUMPTIONS)))


def side_by_side(*steps):
    """Results of steps that don't need each other: their jobs run at the same time."""
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def datamart_day(spark: SparkSession, sf: str, media: str = "OPI") -> DataFrame:
    """Each medium takes the assumptions of its own sheet. The three exports come from one pass over lineitem: its
    per-day statistics (a table of days x groups, far smaller than lineitem) are stored once and read three times;
    the planner is shaped meanwhile."""
    def exports():
        stats = materialize(ad.line_stats(spark, sf))
        return stats, fte_comb(spark, sf, stats)

    (stats, fte), occ = side_by_side(exports, lambda: occ_combined(spark, sf, media))
    dm = build_datamart(calls(spark, sf, stats), fte, assumption_daily(occ), occ_clean(spark, sf, stats), media=media)
    return materialize(dm)  # what reads it (features, models, scenarios) prunes its columns


def datamart_hour(spark: SparkSession, sf: str, media: str = "OPI") -> DataFrame:
    """The hour-wise datamart: the same parts by hour, assumptions over 168 hours joined left, missing
    ones imputed per language, and the staffing lifted at the end."""
    def exports():
        stats = materialize(ad.line_stats(spark, sf, hourly=True))
        pivoted = materialize(fte_ops.fte_pivot(fte_clean(spark, sf, stats, lenient_minute)))
        return stats, materialize(fte_ops.hybrid_split(pivoted, language_shares(spark, sf, pivoted)))

    (stats, totals), occ = side_by_side(exports, lambda: occ_combined(spark, sf, media))
    assumption = assumption_hourly(occ).withColumnRenamed("ts", "date")
    dm = build_datamart(calls(spark, sf, stats), fte_ops.fte_combined(totals), assumption,
                        occ_clean(spark, sf, stats, lenient_minute), media=media, assumption_join="left",
                        uplift=STAFFING_UPLIFT)
    return materialize(dm.withColumnRenamed("date", "ts"))
