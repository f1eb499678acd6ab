"""Adapters: derive the workforce tables (T1-T7) from the driver's star-schema tables.

Every adapter is a Spark plan over the whole input tables, so its work grows with them. The
measures are rounded to a fixed number of decimals, as a CSV export would be, which also keeps
values identical between Spark and the DuckDB oracle.

Join order is chosen for scale: the 25-row nation/region dimension is broadcast (its size is fixed
by the schema, not by the scale factor); customer and orders are joined by shuffle; lineitem
meets the order keys in one more shuffle join; aggregation is partial (map-side) before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffwise.constants import COMBINED, HOURS_PER_DAY
from staffwise.functions.dates import sunday_on_or_before
from staffwise.session import materialize
from staffwise.sources.tables import read_table

# fixed values of the adapter (test-data conventions)
DAY0 = "1992-01-01"            # day numbering origin for format / junk selection
WEEK0 = "1991-12-29"           # a Sunday; planner column = 6 + weeks since WEEK0
JUNK_EVERY = 50                # one junk value in 50 in the dirty exports
AGENT_SUFFIX = {"L3": "L3 - Core", "L4": "L4 - MSI", "L5": "L5 - All Call"}
PRODUCT_OF_FLAG = {"A": "OPI", "N": "Hybrid", "R": "Video Dedicated"}


def usd_of_nation(c: Column) -> Column:
    return F.when(c % 2 == 0, F.lit("USD")).otherwise(F.lit("Global"))


def level_of_priority(c: Column) -> Column:
    p = F.substring(c, 1, 1)
    return F.when(p.isin("1", "2"), F.lit("L3")).when(p == "3", F.lit("L4")).otherwise(F.lit("L5"))


def geo(spark: SparkSession, sf: str) -> DataFrame:
    """nation x region: 25 rows by schema definition."""
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("language"), usd_of_nation(F.col("n_nationkey")).alias("usd"))


def order_keys(spark: SparkSession, sf: str) -> DataFrame:
    """orders with their group keys: (o_orderkey, o_custkey, o_orderdate, o_totalprice, language, usd, level)."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"])
    c = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    cust = c.join(F.broadcast(geo(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "language", "usd")
    return o.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "language", "usd",
        level_of_priority(F.col("o_orderpriority")).alias("level"))


def line_facts(spark: SparkSession, sf: str, hourly: bool = False) -> DataFrame:
    """Lineitem with its group keys; ``hourly`` puts every order's lines into one hour of their day."""
    day = F.to_date("l_shipdate")
    hour = F.timestamp_add("HOUR", (F.col("l_orderkey") % HOURS_PER_DAY).cast("int"), day.cast("timestamp"))
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount",
                                             "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    ok = order_keys(spark, sf).select("o_orderkey", "language", "usd", "level")
    return li.join(ok, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (hour if hourly else day).alias("date"), "language", "usd", "level",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def line_stats(spark: SparkSession, sf: str, hourly: bool = False) -> DataFrame:
    """The one pass over lineitem: exact sums at the finest grain the three exports need
    (date, language, usd, level, linestatus, returnflag). Calls, FTE and occupancy are all
    re-aggregated from this much smaller table, so the big join and scan happen once."""
    return line_facts(spark, sf, hourly).groupBy("date", "language", "usd", "level", "l_linestatus", "l_returnflag").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(_hundredths("l_extendedprice")).alias("ext_cents"),
        F.sum(_hundredths("l_discount") * F.col("l_quantity").cast("long")).alias("disc_q"),
        F.sum(_hundredths("l_tax") * F.col("l_quantity").cast("long")).alias("tax_q"),
        F.sum(F.when(F.col("l_tax") <= 0.06, F.lit(1)).otherwise(F.lit(0))).alias("tax_ok"),
        F.count(F.lit(1)).alias("n"),
    )


def _with_combined(stats: DataFrame, media: Column):
    """The exports' groups: every (usd, level) and its Combined levels, as grouping sets of one aggregation."""
    period = ["date", "language", "req_media"]
    sets = [[*period, "usd", "level"], [*period, "usd"], [*period, "level"], period]
    return stats.withColumn("req_media", media).groupingSets(sets, *period, "usd", "level")


def _combined_names() -> dict[str, Column]:
    """Names of the rolled-up levels; the adapter's usd and level are never null themselves."""
    return {c: F.coalesce(c, F.lit(COMBINED)) for c in ("usd", "level")}


# --- T1 calls (day) -----------------------------------------------------------------------------

def calls_day(spark: SparkSession, sf: str, stats: DataFrame | None = None) -> DataFrame:
    """T1: one row per (date, language, usd, level, req_media), Combined usd and level included.

    Money and rates are summed as whole cents / hundredths (exact in any order), so every measure is
    one division of exact sums and identical in Spark and in the oracle.
    """
    media = F.when(F.col("l_linestatus") == "F", F.lit("OPI")).otherwise(F.lit("VIDEO"))
    st = stats if stats is not None else line_stats(spark, sf)
    g = _with_combined(st, media).agg(
        F.sum("qty").alias("calls"),
        F.sum("ext_cents").cast("double").alias("_ext"),
        F.sum("disc_q").cast("double").alias("_disc"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("qty")).otherwise(F.lit(0.0))).alias("_ret"),
        F.sum("tax_ok").cast("double").alias("_ok"),
        F.sum("n").cast("double").alias("_n"),
    ).withColumns(_combined_names())
    met = dyadic(F.col("_ok") / F.col("_n"), 12)
    return g.select(
        "date", "language", "usd", "req_media", "level",
        (F.col("_ret") / 8.0).alias("abns"),
        "calls",
        dyadic(F.lit(4.0) * F.col("_disc") / F.col("calls")).alias("q2"),
        dyadic(F.col("_ext") / F.col("calls") / 10000.0).alias("aht"),
        dyadic(F.lit(12.5) * F.col("_ret") / F.col("calls")).alias("abn_pct"),
        met.alias("met"),
        (F.lit(1.0) - met).alias("missed"),
    )


def _hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100.0).cast("long")


def dyadic(x: Column, bits: int = 8) -> Column:
    """Export precision: a multiple of 2^-bits. Sums of such values are exact in any order."""
    k = float(1 << bits)
    return F.round(x * F.lit(k)) / F.lit(k)


def fte_day(spark: SparkSession, sf: str, stats: DataFrame | None = None) -> DataFrame:
    """T2 typed: (date, language, location, agent_type, product, weekly_ftes)."""
    agent = F.lit(None).cast("string")
    for k, v in AGENT_SUFFIX.items():
        agent = F.when(F.col("level") == k, F.lit(v)).otherwise(agent)
    product = F.lit(None).cast("string")
    for k, v in PRODUCT_OF_FLAG.items():
        product = F.when(F.col("l_returnflag") == k, F.lit(v)).otherwise(product)
    location = F.when(F.col("usd") == "USD", F.lit("USD")).otherwise(F.lit("Non-USD"))
    st = stats if stats is not None else line_stats(spark, sf)
    return st.groupBy(
        "date", "language", location.alias("location"), agent.alias("agent_type"), product.alias("product")
    ).agg((F.sum("qty") / 8.0).alias("weekly_ftes"))


def occ_day(spark: SparkSession, sf: str, stats: DataFrame | None = None) -> DataFrame:
    """T3 typed: (date, language, usd, level, req_media ['OPI'|'Video'], occ), Combined rows included."""
    media = F.when(F.col("l_linestatus") == "F", F.lit("OPI")).otherwise(F.lit("Video"))
    st = stats if stats is not None else line_stats(spark, sf)
    g = _with_combined(st, media).agg(
        F.sum("tax_q").cast("double").alias("_t"), F.sum("qty").alias("_q")).withColumns(_combined_names())
    return g.select("date", "language", "usd", "level", "req_media",
                    dyadic(F.lit(0.6) + F.lit(0.03) * F.col("_t") / F.col("_q"), 12).alias("occ"))


def hybrid_shares(spark: SparkSession, sf: str) -> DataFrame:
    """T4 as exported: percent text per language, the sign language (under its short name) as the last row."""
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    sign = r.agg((F.max("r_regionkey") + 1).alias("r_regionkey")).withColumn("r_name", F.lit("ASL"))
    r = r.unionByName(sign.where("r_regionkey IS NOT NULL"))

    def share(first: int) -> Column:
        return F.concat(((F.lit(first) + F.lit(2) * F.col("r_regionkey")) * 100.0 / 64.0).cast("string"), F.lit("%"))
    return r.select(F.col("r_name").alias("language"), F.col("r_regionkey").alias("src_order"),
                    share(8).alias("l4_hybrid_pct"), share(16).alias("l5_hybrid_pct"))


# --- dirty exports (text columns) -----------------------------------------------------------------

def _day_text(d: Column) -> Column:
    k = F.datediff(d, F.lit(DAY0)) % 4
    return (F.when(k == 0, F.date_format(d, "dd-MM-yyyy")).when(k == 1, F.date_format(d, "d/M/yyyy"))
            .when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "d.M.yyyy")))


def _junk(key: Column, txt: Column) -> Column:
    return F.when(key % JUNK_EVERY == 0, F.lit("n/a")).otherwise(txt)


def _gkey() -> Column:
    return F.datediff(F.col("date"), F.lit(DAY0)) + F.length("language") + F.length("usd") + F.length("level")


def calls_text(spark: SparkSession, sf: str) -> DataFrame:
    """T1 as a CSV export: every column text; mixed date formats, '%' and thousands commas, junk."""
    t = calls_day(spark, sf)
    k = _gkey()
    return t.select(
        _day_text(F.col("date")).alias("date_text"), "language", "usd", "req_media", "level",
        F.col("abns").cast("string").alias("abns"),
        _junk(k, F.format_number("calls", 0)).alias("calls"),
        F.col("q2").cast("string").alias("q2"),
        _junk(k + 7, F.col("aht").cast("string")).alias("aht"),
        F.concat(F.col("abn_pct").cast("string"), F.lit("%")).alias("abn_pct"),
        F.concat((F.col("met") * 100.0).cast("string"), F.lit("%")).alias("met"),
        F.concat((F.col("missed") * 100.0).cast("string"), F.lit("%")).alias("missed"),
    )


def fte_text(spark: SparkSession, sf: str) -> DataFrame:
    t = fte_day(spark, sf)
    k = F.datediff(F.col("date"), F.lit(DAY0)) + F.length("agent_type") + F.length("product")
    return t.select(_day_text(F.col("date")).alias("date_text"), "language", "location", "agent_type", "product",
                    _junk(k, F.format_number("weekly_ftes", 3)).alias("weekly_ftes"))


def occ_text(spark: SparkSession, sf: str) -> DataFrame:
    t = occ_day(spark, sf)
    return t.select(_day_text(F.col("date")).alias("date_text"), "language", "usd", "level", "req_media",
                    F.col("occ").cast("string").alias("occ"))


# --- T5 planner workbook as cells ------------------------------------------------------------------

PLANNER_SHEET, VIDEO_SHEET = "1. Weekly Planner OPI", "2. Weekly Planner VRI"
VIDEO_LEVELS = ["L4", "L5"]
SITES = ["OLY", "BOA"]
SITE_WORKBOOK = "csa "                 # file name prefix of the workbooks by site
SITE_FAMILIES = ["Volume (ACTUAL)", "AHT (ACTUAL)", "OCC Assumptions", "Occupancy Rate", "Q4 Time"]
# metric families in row order; rows start at 4 (row 3 is 'Week Of:')
PLANNER_ROWS = ["Volume (ACTUAL)", "OCC Assumptions", "AHT (ACTUAL)", "Occupancy Rate", "Q4 Time",
                "Staffing Requirement (ACTUAL)", "Staffing (ACTUAL/FORECASTED)", "STAFFING DIFFERENTIAL", "Q2 Time",
                "Staffing Requirement (ADJUSTED FORECAST)", "Staffing Requirement Adjustment",
                "Staffing Requirement (ORIGINAL FORECAST)", "Staffing Requirement (Variance)"]


def _weekly(orders: DataFrame, *by: str) -> DataFrame:
    """Weekly order statistics per language and ``by``."""
    return orders.groupBy("language", sunday_on_or_before(F.to_date("o_orderdate")).alias("week"), *by).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(_hundredths("o_totalprice")).alias("cents"))


def planner_facts_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly order statistics per (language, week, usd, level)."""
    return _weekly(order_keys(spark, sf), "usd", "level")


def _cell_text() -> Column:
    """What a metric's cell holds, by family, from the week's order statistics."""
    c = F.col("cnt")
    aht128 = F.floor(F.col("cents") / c / 78.125)            # average price / 10000 in 1/128
    text = {
        "Volume (ACTUAL)": c.cast("string"),
        "OCC Assumptions": F.concat(((F.lit(176) + c % 32) * 25.0 / 64.0).cast("string"), F.lit("%")),
        "AHT (ACTUAL)": (aht128 / 128.0).cast("string"),
        "Occupancy Rate": F.concat(((F.lit(150) + c % 64) * 25.0 / 64.0).cast("string"), F.lit("%")),
        "Q4 Time": F.concat((c % 40).cast("string"), F.lit(".5")),
        "Staffing Requirement (ACTUAL)": F.format_number(c * 3, 0),
        "Staffing (ACTUAL/FORECASTED)": (c * 3 + c % 11).cast("string"),
        "STAFFING DIFFERENTIAL": (c % 11 - 5).cast("string"),
        "Q2 Time": F.concat((c % 25).cast("string"), F.lit(".25")),
        "Staffing Requirement (ADJUSTED FORECAST)": F.format_number(c * 3 + 2, 0),
        "Staffing Requirement Adjustment": (c % 7 - 3).cast("string"),
        "Staffing Requirement (ORIGINAL FORECAST)": F.format_number(c * 2 + 1, 0),
        "Staffing Requirement (Variance)": (c % 5 - 2).cast("string"),
    }
    out = F.lit(None).cast("string")
    for family, value in text.items():
        out = F.when(F.col("family") == family, value).otherwise(out)
    return out


def _layout(spark: SparkSession, dims: list[str], rows: list[tuple]) -> DataFrame:
    """A sheet's fixed rows in order from row 4: (row, *dims, family, h3, h4, h5)."""
    return spark.createDataFrame([(4 + i, *r) for i, r in enumerate(rows)],
                                 "row int, " + "".join(f"{d} string, " for d in dims) + "family string, h3 string, h4 string, h5 string")


def _metric_rows(spark: SparkSession) -> DataFrame:
    """The sheet by usd and level: 78 rows."""
    return _layout(spark, ["usd", "level"], [
        (u, lv, f, u, *((f"OCC Assumptions ({lv}):", None) if f == "OCC Assumptions" else (lv, f)))
        for f in PLANNER_ROWS for u in ("USD", "Global") for lv in ("L3", "L4", "L5")])


def _video_rows(spark: SparkSession) -> DataFrame:
    """The video sheet has no USD / Global rows, and its assumptions no such word: 26 rows."""
    return _layout(spark, ["level"], [
        (lv, f, *((f"OCC Assumptions ({lv}):", None, None) if f == "OCC Assumptions" else (COMBINED, lv, f)))
        for f in PLANNER_ROWS for lv in VIDEO_LEVELS])


def _site_rows(spark: SparkSession) -> DataFrame:
    """The sheet of a workbook by site: 10 rows."""
    def header(site: str, f: str) -> tuple:
        if f == "OCC Assumptions":
            return (f"OCC Assumptions ({site}):", None, None)
        return (site if f in ("Occupancy Rate", "Q4 Time") else COMBINED, site, f)
    return _layout(spark, ["site"], [(x, f, *header(x, f)) for f in SITE_FAMILIES for x in SITES])


def _sheet_cells(facts: DataFrame, layout: DataFrame, dims: list[str], sheet: str, prefix: str = "") -> DataFrame:
    """(workbook, sheet, row, col, value) cells of one sheet in a workbook per language.

    Rows 0-2 / columns 0-2 hold titles and labels; columns 3-5 the three header cells of each row;
    row 3 the week dates; one column per week from column 6.
    """
    facts = facts.withColumn("workbook", F.concat(F.lit(prefix), F.col("language")))
    layout, name = F.broadcast(layout), F.lit(sheet).alias("sheet")  # a fixed layout of some dozen rows
    col = (F.lit(6) + F.datediff(F.col("week"), F.lit(WEEK0)) / 7).cast("int").alias("col")
    vals = facts.join(layout, dims).select("workbook", name, "row", col, _cell_text().alias("value"))
    langs = facts.select("workbook").distinct()
    weeks = facts.select("workbook", "week").distinct().select(
        "workbook", name, F.lit(3).alias("row"), col, F.date_format("week", "dd-MM-yyyy").alias("value"))
    hdr = langs.crossJoin(layout).select(
        "workbook", name, "row",
        F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(h).alias("value"))
                            for i, h in [(1, "family"), (3, "h3"), (4, "h4"), (5, "h5")]])).alias("c")
    ).select("workbook", "sheet", "row", "c.col", "c.value").where(F.col("value").isNotNull())
    fixed = langs.select("workbook", name, F.lit(0).alias("row"), F.lit(0).alias("col"),
                         F.concat(F.col("workbook"), F.lit(" planner")).alias("value")).unionByName(
        langs.select("workbook", name, F.lit(3).alias("row"), F.lit(3).alias("col"), F.lit("Week Of:").alias("value")))
    return vals.unionByName(weeks).unionByName(hdr).unionByName(fixed)


def planner_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T5: the OPI sheet of one planner workbook per language."""
    facts = materialize(planner_facts_raw(spark, sf))  # one row per (language, week, usd, level), read four times
    return _sheet_cells(facts, _metric_rows(spark), ["usd", "level"], PLANNER_SHEET)


def planner_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """T5 with every kind of sheet: per language a workbook with the OPI and the video sheet, and one by site."""
    orders = order_keys(spark, sf).withColumn("site", F.when(F.col("o_custkey") % 2 == 0, SITES[0]).otherwise(SITES[1]))
    facts = materialize(_weekly(orders, "usd", "level", "site"))  # the one pass over orders
    sums = [F.sum("cnt").alias("cnt"), F.sum("cents").alias("cents")]
    by_level = facts.groupBy("language", "week", "usd", "level").agg(*sums)
    video = facts.where(F.col("level").isin(VIDEO_LEVELS)).groupBy("language", "week", "level").agg(*sums)
    by_site = facts.groupBy("language", "week", "site").agg(*sums)
    return (_sheet_cells(by_level, _metric_rows(spark), ["usd", "level"], PLANNER_SHEET)
            .unionByName(_sheet_cells(video, _video_rows(spark), ["level"], VIDEO_SHEET))
            .unionByName(_sheet_cells(by_site, _site_rows(spark), ["site"], PLANNER_SHEET, SITE_WORKBOOK)))


# --- T7 activity -----------------------------------------------------------------------------------

def activity(spark: SparkSession, sf: str) -> DataFrame:
    """T7: (user, tool, ts) from the events table."""
    e = read_table(spark, sf, "events", ["user_id", "event_type", "ts"])
    return e.select(F.col("user_id").alias("user"), F.col("event_type").alias("tool"), "ts")
