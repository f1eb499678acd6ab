"""Planner workbook: cells -> weekly long facts -> combined assumptions -> days / hours.

(SRC3, SRC4, SRC7, PRJ3-PRJ5, AGG6, AGG7, RSH1-RSH4.)

The workbook stays long: a header is three cells of a row, a week is the date cell of a column, and
a fact is every other cell keyed by both. Nothing is transposed on the driver, so the number of
sheets, metrics and weeks is not limited by one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffwise.constants import COMBINED, PLANNER_FAMILIES, WEEK_HEADER
from staffwise.functions.clean import numeric, percent
from staffwise.functions.dates import lenient_day, week_days, week_hours
from staffwise.functions.text import after_marker, category_of_label, level_in_parens, media_of_sheets

SHEET_KEYS = ["workbook", "sheet"]


def header_text(h3: Column, h4: Column, h5: Column) -> Column:
    """Three header cells joined by blanks; missing cells read 'nan' and every 'nan' is removed, then trimmed."""
    parts = [F.coalesce(h, F.lit("nan")) for h in (h3, h4, h5)]
    return F.trim(F.replace(F.concat_ws(" ", *parts), F.lit("nan"), F.lit("")))


def family_of(header: Column) -> Column:
    """PRJ3: the first metric family whose name the header contains (NULL: not a planner metric)."""
    out = F.lit(None).cast("string")
    for fam in reversed(PLANNER_FAMILIES):
        out = F.when(header.contains(fam), F.lit(fam)).otherwise(out)
    return out


def usd_of_header(header: Column) -> Column:
    first = F.substring_index(header, " ", 1)
    return F.when(first.isin("USD", "Global", COMBINED), first).otherwise(category_of_label(header))


def level_of_header(header: Column) -> Column:
    second = F.regexp_extract(header, r"^\S+ (L3|L4|L5|Combined) ", 1)
    return F.coalesce(level_in_parens(header), F.when(second != "", second))


def cell_number(v: Column) -> Column:
    """Numbers as typed in the workbook: '77%' is a fraction, '1,234' a count."""
    return F.when(F.trim(v).endswith("%"), percent(v)).otherwise(numeric(v))


def shape_planner(cells: DataFrame, sheets: list[str] | None = None, families: list[str] | None = None) -> DataFrame:
    """SRC3 + SRC4 + PRJ3: cells (workbook, sheet, row, col, value) -> facts
    (workbook, sheet, week, metric, family, usd, level, value).

    ``sheets`` selects sheets; a requested sheet that has no cells raises (SRC7). ``families`` selects metric
    families: the cells of others are dropped by their header, before they meet their week.
    """
    c = cells.where((F.col("row") >= 3) & (F.col("col") >= 3))
    if sheets:
        require_sheets(cells, sheets)
        c = c.where(F.col("sheet").isin(sheets))
    hdr = c.where(F.col("col").isin(3, 4, 5)).groupBy(*SHEET_KEYS, "row").agg(
        header_text(F.max(F.when(F.col("col") == 3, F.col("value"))),
                    F.max(F.when(F.col("col") == 4, F.col("value"))),
                    F.max(F.when(F.col("col") == 5, F.col("value")))).alias("metric"))
    body = c.where(F.col("col") >= 6)
    weeks = body.join(hdr.where(F.col("metric") == WEEK_HEADER), [*SHEET_KEYS, "row"]).select(
        *SHEET_KEYS, "col", lenient_day("value").alias("week"))
    metrics = hdr.where(F.col("metric") != WEEK_HEADER).withColumn("family", family_of(F.col("metric"))) \
        .where(F.col("family").isin(families) if families else F.col("family").isNotNull())
    facts = body.join(metrics, [*SHEET_KEYS, "row"]).join(weeks, [*SHEET_KEYS, "col"])
    return facts.select(*SHEET_KEYS, "week", "metric", "family",
                        usd_of_header(F.col("metric")).alias("usd"),
                        level_of_header(F.col("metric")).alias("level"),
                        cell_number(F.col("value")).alias("value"))


def missing_sheets(cells: DataFrame, sheets: list[str]) -> DataFrame:
    """SRC7: requested sheets with no cells at all (anti-join of the request against present sheets)."""
    req = cells.sparkSession.createDataFrame([(s,) for s in sheets], "sheet string")
    return req.join(cells.select("sheet").distinct(), "sheet", "left_anti")


def require_sheets(cells: DataFrame, sheets: list[str]) -> None:
    miss = [r.sheet for r in missing_sheets(cells, sheets).collect()]  # bounded by the request list
    if miss:
        raise ValueError(f"sheets not found: {miss}")


def is_site_workbook(workbook: Column) -> Column:
    return F.lower(workbook).startswith("csa")


def is_video_sheet(sheet: Column) -> Column:
    return F.upper(sheet).contains("VRI")


def sheet_kinds(facts: DataFrame) -> DataFrame:
    """STR4 + STR8: the sheets present, the text after their marker, and the medium it names (none without a marker)."""
    kind = after_marker("sheet")
    return facts.select("workbook", "sheet").distinct().select(
        "workbook", "sheet", kind.alias("kind"), F.when(kind.isNotNull(), media_of_sheets(kind)).alias("media"))


def select_choice(facts: DataFrame, option: str) -> DataFrame:
    """PRJ4: the metrics of one choice, such as 'Global L4', 'Combined Combined', 'Combined L5' or a site.

    Workbooks by site take a choice as text that the metric holds ('Combined' means the word twice); the
    video sheets only look at its second word; other sheets want both words, or one word twice.
    """
    def times(word: str) -> Column:
        return F.size(F.split("metric", word)) - 1

    first, _, second = option.partition(" ")
    both = F.col("metric").contains(first) & F.col("metric").contains(second) if first != second else times(first) >= 2
    if second:
        by_site, video = F.lit(False) if first != second else F.col("metric").contains(option), F.col("metric").contains(second)
    else:
        by_site, video, both = F.col("metric").contains(f"{option} {option}" if option == COMBINED else option), F.lit(False), F.lit(False)
    site = is_site_workbook(F.col("workbook"))
    return facts.where(F.when(site, by_site).when(is_video_sheet(F.col("sheet")), video).otherwise(both))


def select_level(facts: DataFrame, usd: str, level: str) -> DataFrame:
    """PRJ4: the facts of one (usd, level) choice."""
    return facts.where((F.col("usd") == usd) & (F.col("level") == level))


def level_options(facts: DataFrame, family: str = "Staffing Requirement (ACTUAL)") -> DataFrame:
    """PRJ5: the (usd, level) options offered by the staffing-requirement rows."""
    return facts.where(F.col("family") == family).select("workbook", "sheet", "usd", "level").distinct()


# --- occupancy assumptions --------------------------------------------------------------------------

def occ_assumptions(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("family") == "OCC Assumptions").select(
        *SHEET_KEYS, "week", "usd", "level", F.col("value").alias("occ_assumption"))


def occ_combined_mean(occ: DataFrame) -> DataFrame:
    """AGG6: detail assumptions plus unweighted means: (Combined, L4|L5) over USD/Global,
    (USD|Global, Combined) over L3-L5, and (Combined, Combined) as the mean of those two side means.
    No (Combined, L3) assumption is made."""
    keys = [*SHEET_KEYS, "week"]
    det = occ.where(F.col("usd").isin("USD", "Global") & F.col("level").isin("L3", "L4", "L5"))
    by_level = det.where(F.col("level").isin("L4", "L5")).groupBy(*keys, "level").agg(
        F.avg("occ_assumption").alias("occ_assumption")).withColumn("usd", F.lit(COMBINED))
    by_usd = det.groupBy(*keys, "usd").agg(F.avg("occ_assumption").alias("occ_assumption")) \
        .withColumn("level", F.lit(COMBINED))
    both = by_usd.groupBy(*keys).agg(F.avg("occ_assumption").alias("occ_assumption")) \
        .withColumns({"usd": F.lit(COMBINED), "level": F.lit(COMBINED)})
    cols = [*keys, "usd", "level", "occ_assumption"]
    return det.select(cols).unionByName(by_level.select(cols)).unionByName(by_usd.select(cols)) \
        .unionByName(both.select(cols))


def occ_video(facts: DataFrame) -> DataFrame:
    """AGG6 for video sheets, whose assumptions name no usd: (Combined, L4) and (Combined, L5) as they stand,
    (Combined, Combined) as their mean; missing cells don't count."""
    keys = [*SHEET_KEYS, "week"]
    det = occ_assumptions(facts.where(is_video_sheet(F.col("sheet")) & F.col("level").isin("L4", "L5"))).withColumn("usd", F.lit(COMBINED))
    both = det.groupBy(*keys).agg(F.avg("occ_assumption").alias("occ_assumption")).withColumns(
        {"usd": F.lit(COMBINED), "level": F.lit(COMBINED)})
    return det.unionByName(both.select(det.columns))


def occ_volume_weighted(facts: DataFrame) -> DataFrame:
    """AGG7: volume-weighted assumption over L3-L5 per usd and for all usd together
    (missing cells count as 0; NULL when the volume sums to 0)."""
    keys = [*SHEET_KEYS, "week", "usd", "level"]
    occ = occ_assumptions(facts)
    vol = facts.where(F.col("family") == "Volume (ACTUAL)").select(*keys, F.col("value").alias("volume"))
    j = occ.join(vol, keys, "full").where(F.col("level").isin("L3", "L4", "L5"))
    o, v = F.coalesce("occ_assumption", F.lit(0.0)), F.coalesce("volume", F.lit(0.0))
    r = j.rollup(*SHEET_KEYS, "week", "usd").agg(F.try_divide(F.sum(o * v), F.sum(v)).alias("occ_assumption"),
                                                  F.grouping_id().alias("gid"))
    return r.where(F.col("gid") <= 1).select(*SHEET_KEYS, "week", F.coalesce("usd", F.lit(COMBINED)).alias("usd"),
                                             "occ_assumption")


def to_daily(weekly: DataFrame, week_col: str = "week") -> DataFrame:
    """RSH1: each weekly row becomes its 7 days (week .. week+6)."""
    return weekly.where(F.col(week_col).isNotNull()).select(
        "*", F.explode(week_days(F.col(week_col))).alias("date")).drop(week_col)


def to_hourly(weekly: DataFrame, week_col: str = "week") -> DataFrame:
    """RSH3: each weekly row becomes its 168 hours."""
    return weekly.where(F.col(week_col).isNotNull()).select(
        "*", F.explode(week_hours(F.col(week_col))).alias("ts")).drop(week_col)


def wide_occ(occ: DataFrame, labels: list[str]) -> DataFrame:
    """PRJ6 wide form: one column per label '<usd> OCC Assumptions (<level>):' (explicit value list)."""
    lab = F.concat(F.col("usd"), F.lit(" OCC Assumptions ("), F.col("level"), F.lit("):"))
    return occ.withColumn("label", lab).groupBy(*SHEET_KEYS, "week").pivot("label", labels).agg(
        F.first("occ_assumption"))


def unpivot_occ(wide: DataFrame, labels: list[str]) -> DataFrame:
    """RSH2 + RSH4: wide label columns -> (label, occ_assumption) -> (level, usd) from the label text."""
    long = wide.unpivot([*SHEET_KEYS, "week"], labels, "label", "occ_assumption")
    return long.select(*SHEET_KEYS, "week", level_in_parens("label").alias("level"),
                       category_of_label("label").alias("usd"), "label", "occ_assumption")
