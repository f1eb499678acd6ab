"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the adapters) over their whole extent. Double
columns are rounded to 6 decimals at the end (``finish``) so that results compare exactly with
the DuckDB oracle despite order-dependent floating sums.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from staffwise.functions.mathx import DIGITS, stable
from staffwise.constants import DETAIL_LEVELS
from staffwise.functions.text import category_of_label, level_in_parens
from staffwise.operators import lookalike as la
from staffwise.operators import planner as pl
from staffwise.operators import rollup as ru
from staffwise.plans import pipelines as pp
from staffwise.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = [stable(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


#: Decimals of model results: the noise of a solved system is larger than that of sums.
MODEL_DIGITS = 4


def query(name: str, digits: int = DIGITS):
    def deco(fn):
        QUERIES[name] = lambda spark, sf: finish(fn(spark, sf), digits)
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# --- datamart and its parts -------------------------------------------------------------------------

@query("fte_pivot")
def q_fte_pivot(spark, sf):
    """AGG2 + PRJ6: FTEs per media (Hybrid/OPI/VIDEO) per (date, usd, language, level)."""
    return pp.fte_pivoted(spark, sf)


@query("hybrid_split")
def q_hybrid_split(spark, sf):
    """PRJ9 + PRJ11 + STR5: OPI / VRI totals after splitting Hybrid by the language's level share."""
    return pp.fte_totals(spark, sf)


@query("hybrid_split_shared")
def q_hybrid_split_shared(spark, sf):
    """PRJ10: the older split that adds the VRI share to both media."""
    return pp.fte_totals(spark, sf, shared=True)


@query("fte_combined")
def q_fte_combined(spark, sf):
    """AGG1 + AGG4 + AGG5: detail plus combined (usd, level) FTE rows."""
    return pp.fte_comb(spark, sf)


@query("datamart_day")
def q_datamart_day(spark, sf):
    """JN1-JN4, CLN10, PRJ8, WIN1, FLT5: the day-wise OPI datamart for all languages."""
    return pp.datamart_day(spark, sf)


@query("datamart_day_video")
def q_datamart_day_video(spark, sf):
    """The day-wise datamart of the video medium: video staffing and calls, the assumptions of the video sheet (AGG6)."""
    return pp.datamart_day(spark, sf, media="VIDEO")


# --- scenario analysis --------------------------------------------------------------------------------

@query("datamart_hour")
def q_datamart_hour(spark, sf):
    """JN3, RSH3, DAT2, CLN10: the hour-wise OPI datamart; assumptions join left, staffing x 1.4 at the end."""
    return pp.datamart_hour(spark, sf)


def _hist(spark, sf):
    """The analysis history: a projection of the stored datamart, which baseline, band join and report all read."""
    return la.analysis_input(pp.datamart_day(spark, sf))


@query("weekly_kpi")
def q_weekly_kpi(spark, sf):
    """FLT2 + AGG13-AGG15 + AGG20 for every week of every group."""
    return la.weekly_kpi(_hist(spark, sf))


def _single(spark):
    return spark.createDataFrame([(10.0, 5.0)], "demand_change double, staffing_change double")


@query("lookalike_weighted")
def q_lookalike_weighted(spark, sf):
    """SCN1-SCN3: year-weighted look-alike estimate (demand +10 %, staffing +5 %) for every group."""
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, _single(spark), "weighted", pp.REFERENCE_YEAR)


@query("lookalike_unweighted")
def q_lookalike_unweighted(spark, sf):
    """SCN4: unweighted look-alike estimate with safe deltas."""
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, _single(spark), "unweighted")


@query("lookalike_absolute")
def q_lookalike_absolute(spark, sf):
    """SCN2: staffing changed by a number of FTE, 0 at least, with demand +10 %, for every group."""
    changes = spark.createDataFrame([(10.0, float(s)) for s in la.ABSOLUTE_STEPS], "demand_change double, staffing_change double")
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, changes, "weighted", pp.REFERENCE_YEAR, absolute=True)


@query("lookalike_direct")
def q_lookalike_direct(spark, sf):
    """SCN5: call-weighted KPIs of the target band."""
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, _single(spark), "direct")


def scenario_double_latest(spark, sf):
    """SCN8 on the latest Sunday week of the history (the reference's default week); used by entry()."""
    return finish(la.evaluate(_hist(spark, sf), None, la.change_table(spark, "double"), "weighted"))


@query("scenario_demand")
def q_scenario_demand(spark, sf):
    """SCN6: demand +-1..25 %, staffing unchanged, every group."""
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, la.change_table(spark, "demand"), "weighted",
                       pp.REFERENCE_YEAR)


@query("scenario_staffing")
def q_scenario_staffing(spark, sf):
    """SCN7: staffing +-1..25 %, demand unchanged, every group."""
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, la.change_table(spark, "staffing"), "weighted",
                       pp.REFERENCE_YEAR)


@query("scenario_double")
def q_scenario_double(spark, sf):
    """SCN8 (flagship): 14 x 14 demand x staffing scenarios for every group in one band join."""
    return la.evaluate(_hist(spark, sf), pp.WEEK_START, la.change_table(spark, "double"), "weighted",
                       pp.REFERENCE_YEAR)


# --- planner ------------------------------------------------------------------------------------------

@query("planner_cells")
def q_planner_cells(spark, sf):
    """SRC3 + SRC4 + PRJ3 + JN6: planner cells -> weekly long facts (header from 3 cells, week per column)."""
    return pp.planner_facts(spark, sf)


@query("planner_select")
def q_planner_select(spark, sf):
    """PRJ4: the facts of the choice (Global, L4)."""
    return pl.select_level(pp.planner_facts(spark, sf), "Global", "L4")


@query("planner_levels")
def q_planner_levels(spark, sf):
    """PRJ5: the (usd, level) options offered by the staffing-requirement rows."""
    return pl.level_options(pp.planner_facts(spark, sf))


@query("occ_mean")
def q_occ_mean(spark, sf):
    """AGG6: detail and unweighted combined occupancy assumptions."""
    return pp.occ_combined(spark, sf)


@query("occ_volume")
def q_occ_volume(spark, sf):
    """AGG7: volume-weighted occupancy assumption per usd and overall."""
    return pl.occ_volume_weighted(pp.planner_facts(spark, sf))


@query("weekly_to_daily")
def q_weekly_to_daily(spark, sf):
    """RSH1: combined weekly assumptions expanded to days."""
    from staffwise.operators.datamart import assumption_daily
    return assumption_daily(pp.occ_combined(spark, sf))


@query("weekly_to_hourly")
def q_weekly_to_hourly(spark, sf):
    """RSH3: combined weekly assumptions expanded to 168 hours."""
    from staffwise.operators.datamart import assumption_hourly
    return assumption_hourly(pp.occ_combined(spark, sf))


OCC_LABELS = [f"{u} OCC Assumptions ({lv}):" for u in ("USD", "Global") for lv in DETAIL_LEVELS]


@query("occ_unpivot")
def q_occ_unpivot(spark, sf):
    """PRJ6 + RSH2 + RSH4: wide label columns (explicit pivot list) back to (level, usd) rows."""
    occ = pl.occ_assumptions(pp.planner_facts(spark, sf))
    return pl.unpivot_occ(pl.wide_occ(occ, OCC_LABELS), OCC_LABELS)


@query("label_split")
def q_label_split(spark, sf):
    """STR1 + STR2: level and category from every distinct planner header."""
    f = pp.planner_facts(spark, sf).select("metric").distinct()
    return f.select("metric", level_in_parens("metric").alias("level_in_parens"),
                    category_of_label("metric").alias("category"))


@query("rollup_volume")
def q_rollup_volume(spark, sf):
    """AGG8 + AGG25: volume cube over (usd, level)."""
    return ru.rollup_volume(pp.planner_facts(spark, sf))


@query("rollup_weighted")
def q_rollup_weighted(spark, sf):
    """AGG9 + AGG10: volume-weighted AHT and occupancy assumption cubes."""
    return ru.rollup_weighted(pp.planner_facts(spark, sf))


@query("rollup_staffing")
def q_rollup_staffing(spark, sf):
    """AGG11: staffing metrics summed over USD and Global per level."""
    return ru.rollup_staffing(pp.planner_facts(spark, sf))


@query("rollup_site")
def q_rollup_site(spark, sf):
    """AGG12: four families of the workbooks by site, per site and volume-weighted over the sites."""
    return ru.rollup_site(pp.workbook_facts(spark, sf))


@query("planner_workbooks")
def q_planner_workbooks(spark, sf):
    """JN6 + PRJ3 + SRC3 + SRC7: weekly facts of sheets of three layouts, all thirteen families."""
    return pp.workbook_facts(spark, sf, [ad.PLANNER_SHEET, ad.VIDEO_SHEET])


@query("planner_media")
def q_planner_media(spark, sf):
    """STR4 + STR8: every sheet's text after the marker and the medium it names."""
    return pl.sheet_kinds(pp.workbook_facts(spark, sf))


@query("occ_video")
def q_occ_video(spark, sf):
    """AGG6: the assumptions of the video sheets, which name no usd."""
    return pp.occ_combined(spark, sf, "VIDEO")


CHOICES = ["Global L4", "Combined L5", "Combined Combined", "OLY", "Combined"]


@query("planner_choice")
def q_planner_choice(spark, sf):
    """PRJ4: the metrics, details and combined ones, that each choice selects in every kind of workbook."""
    facts, out = materialize(ru.derived(pp.workbook_facts(spark, sf))), None
    for choice in CHOICES:
        part = pl.select_choice(facts, choice).withColumn("choice", F.lit(choice))
        out = part if out is None else out.unionByName(part)
    return out


# --- cleaning, dates, text ------------------------------------------------------------------------------


from staffwise.constants import ABN_LABELS, Q2_EDGES, Q2_LABELS  # noqa: E402
from staffwise.functions import clean as cl  # noqa: E402
from staffwise.functions import dates as dt  # noqa: E402
from staffwise.functions.text import contains_match, language_alias, level_of_text  # noqa: E402
from staffwise.operators import activity as act  # noqa: E402
from staffwise.operators import classifier as cf  # noqa: E402
from staffwise.operators import features as fe  # noqa: E402
from staffwise.operators import forest as fo  # noqa: E402
from staffwise.operators import lasso as lo  # noqa: E402
from staffwise.operators import models as mo  # noqa: E402
from staffwise.operators import quantiles as qb  # noqa: E402
from staffwise.operators import whatif as wi  # noqa: E402
from staffwise.operators.fte import match_languages  # noqa: E402
from staffwise.session import scratch_path  # noqa: E402
from staffwise.sources import adapters as ad  # noqa: E402
from staffwise.sources.artefacts import Artefacts  # noqa: E402
from staffwise.sources import exports as ex  # noqa: E402
from staffwise.sources import sinks as sk  # noqa: E402

GK = ["language", "req_media", "usd", "level"]


def _clean_calls(spark, sf):
    return cl.convert_calls(ad.calls_text(spark, sf))


@query("clean_numeric")
def q_clean_numeric(spark, sf):
    """CLN1-CLN3 + DAT1: the calls export cleaned (mixed dates, '%' and commas, junk -> NULL)."""
    return _clean_calls(spark, sf)


@query("clean_fte")
def q_clean_fte(spark, sf):
    """CLN4 + STR3: the FTE export cleaned (level code, location / product mapping)."""
    f = cl.convert_fte(ad.fte_text(spark, sf))
    return f.withColumn("level", level_of_text("level_ix"))


@query("clean_occ")
def q_clean_occ(spark, sf):
    """CLN5 + CLN7: the occupancy export cleaned, 'Video' -> 'VIDEO'."""
    return cl.convert_occ(ad.occ_text(spark, sf))


def _exported(spark, df, prefix):
    """``df`` written as a CSV export below the shared folder and scanned again by its prefix."""
    folder = scratch_path(spark, "exports")
    sk.write_report(df, f"{folder}/{prefix}-1.csv")
    return ex.read_exports(spark, folder, {prefix: df.columns})[prefix]


@query("calls_csv")
def q_calls_csv(spark, sf):
    """SNK2, SRC1, SRC5, SRC6, CLN3: the calls export through CSV files."""
    return cl.convert_calls(_exported(spark, ad.calls_text(spark, sf), "HMO-Calls"))


@query("fte_csv")
def q_fte_csv(spark, sf):
    """SNK2, SRC1, SRC5, CLN4: the FTE export through CSV files."""
    return cl.convert_fte(_exported(spark, ad.fte_text(spark, sf), "HMO-FTE")).withColumn("level", level_of_text("level_ix"))


@query("occ_csv")
def q_occ_csv(spark, sf):
    """SNK2, SRC1, SRC5, CLN5, CLN7: the occupancy export through CSV files."""
    return cl.convert_occ(_exported(spark, ad.occ_text(spark, sf), "HMO-OCC"))


@query("datamart_stored")
def q_datamart_stored(spark, sf):
    """SNK1 + SRC2: the day-wise datamart written by language and read again."""
    path = scratch_path(spark, "datamart")
    sk.write_datamart(pp.datamart_day(spark, sf), path)
    return sk.read_datamart(spark, path)


@query("report_csv")
def q_report_csv(spark, sf):
    """SNK2: the demand x staffing report of every group as CSV, read again with its types."""
    report, path = q_scenario_double(spark, sf), scratch_path(spark, "report")
    sk.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


def in_batch(key: str, k: int, n: int = 2):
    """Whether a row falls into batch ``k`` of ``n`` by its key; every row falls into exactly one, nulls too."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(n)), F.lit(0)) == k


@query("usage_log")
def q_usage_log(spark, sf):
    """SNK6 + ACT4: tool visits, with their duration as text, appended to the usage log in two batches (by user), and
    the log read again."""
    visits, path = q_tool_dwell(spark, sf), scratch_path(spark, "usage")
    visits = materialize(visits.withColumn("duration", act.duration_text("seconds")))  # both batches read them
    for half in (0, 1):
        sk.append_log(visits.where(in_batch("user", half)), path)
    return spark.read.schema(visits.schema).parquet(path)


MINUTE_TEXT = ["dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm"]


@query("lenient_minute")
def q_lenient_minute(spark, sf):
    """DAT2: event times written in four formats parsed back in priority order (day first), to the minute."""
    from staffwise.sources.tables import read_table
    e = read_table(spark, sf, "events", ["event_id", "ts"])
    k = F.col("event_id") % 4
    txt = F.when(k == 0, F.date_format("ts", MINUTE_TEXT[0])).when(k == 1, F.date_format("ts", MINUTE_TEXT[1])) \
        .when(k == 2, F.date_format("ts", MINUTE_TEXT[2])).otherwise(F.date_format("ts", MINUTE_TEXT[3]))
    return e.select("event_id", txt.alias("ts_text")).select("event_id", "ts_text",
                                                             dt.lenient_minute("ts_text").alias("minute"))


@query("impute_mean")
def q_impute_mean(spark, sf):
    """CLN10: NULL calls / AHT replaced by the column mean over all rows."""
    return cl.impute_mean(materialize(_clean_calls(spark, sf)), ["calls", "aht"])


@query("coerce_numeric")
def q_coerce_numeric(spark, sf):
    """CLN8: measures of the raw calls export as numbers; text that is no plain number ('7,870', '91.4%', junk) is NULL."""
    return cl.coerce_numeric(ad.calls_text(spark, sf), ["abns", "calls", "q2", "aht", "abn_pct"]).select(
        "date_text", "language", "usd", "req_media", "level", "abns", "calls", "q2", "aht", "abn_pct")


@query("fill_zero")
def q_fill_zero(spark, sf):
    """CLN9: NULL calls / AHT replaced by 0."""
    return cl.fill_zero(_clean_calls(spark, sf), ["calls", "aht"])


@query("drop_incomplete")
def q_drop_incomplete(spark, sf):
    """CLN11: rows with a NULL calls or AHT dropped."""
    return cl.drop_incomplete(_clean_calls(spark, sf), ["calls", "aht"])


@query("sundays")
def q_sundays(spark, sf):
    """DAT6-DAT8 + AGG24: per group the latest Sunday present, the Sunday on/before and strictly before the last date."""
    c = pp.calls(spark, sf)
    g = c.groupBy(*GK).agg(dt.latest_sunday(F.col("date")).alias("latest_sunday"), F.max("date").alias("max_date"),
                           F.min("date").alias("min_date"), F.count(F.lit(1)).alias("n_days"))
    return g.withColumns({"sunday_on_or_before": dt.sunday_on_or_before(F.col("max_date")),
                          "sunday_before": dt.sunday_strictly_before(F.col("max_date"))})


@query("week_of_year_sunday")
def q_week_of_year(spark, sf):
    """DAT3-DAT5 + DAT9: every distinct day with its Sunday-based week number, year and ISO text."""
    d = pp.calls(spark, sf).select("date").distinct()
    return d.select("date", dt.week_of_year_sunday(F.col("date")).alias("week_of_year"),
                    F.year("date").alias("year"), F.date_format("date", "yyyy-MM-dd").alias("date_text"))


@query("day_spine")
def q_day_spine(spark, sf):
    """DAT10 + AGG22: the 7 days from the week start for every group, with the daily mean demand and requirement."""
    dm = pp.datamart_day(spark, sf)
    groups = dm.select(*GK).distinct()
    days = groups.select(*GK, F.explode(dt.week_days(F.to_date(F.lit(pp.WEEK_START)))).alias("date"))
    daily = dm.groupBy(*GK, "date").agg(F.avg("demand").alias("demand"), F.avg("requirement").alias("requirement"))
    return days.join(daily, [*GK, "date"], "left")


@query("language_match")
def q_language_match(spark, sf):
    """STR5-STR7: three-letter codes matched to the hybrid table by prefix (first row wins), containment count, alias."""
    hyb = materialize(pp.hybrid_clean(spark, sf))
    names = pp.calls(spark, sf).select("language").unionByName(hyb.select("language"))
    codes = materialize(names.select(F.upper(F.substring("language", 1, 3)).alias("language")).distinct())
    m = match_languages(codes, hyb)
    cnt = codes.join(hyb.withColumnRenamed("language", "h"), contains_match(F.col("language"), F.col("h"))) \
        .groupBy(F.col("language").alias("code")).agg(F.count(F.lit(1)).alias("n_contains"))
    return m.join(cnt, "code", "left").withColumn("alias", language_alias(F.col("matched_language")))


# --- features, splits ------------------------------------------------------------------------------------

def _dm(spark, sf):
    return pp.datamart_day(spark, sf)


@query("bucket_abn_q2")
def q_bucket(spark, sf):
    """RSH5: ABN % (percent points) and Q2 buckets, left-closed, last open."""
    dm = _dm(spark, sf)
    return dm.select(*GK, "date", "abn_pct", "q2",
                     fe.bucketize(F.col("abn_pct"), fe.abn_edges(), ABN_LABELS).alias("abn_bucket"),
                     fe.bucketize(F.col("q2"), [float(e) for e in Q2_EDGES], Q2_LABELS).alias("q2_bucket"))


@query("onehot")
def q_onehot(spark, sf):
    """RSH6 + ML10: prepared features with one-hot buckets (first label dropped)."""
    x = fe.prepare_features(_dm(spark, sf))
    return x.select(*GK, "date", *fe.onehot_names(ABN_LABELS, "abn"), *fe.onehot_names(Q2_LABELS, "q2"))


@query("ratios")
def q_ratios(spark, sf):
    """PRJ13: calls and demand per FTE, abandon demand."""
    return fe.ratios(_dm(spark, sf)).select(*GK, "date", "calls_per_fte", "demand_per_fte", "abandon_demand")


@query("trim_quantile")
def q_trim(spark, sf):
    """FLT6: positive staffing within the group's 5-95 % quantiles."""
    return fe.trim_quantiles(_dm(spark, sf).select(*GK, "date", "staffing"), GK)


@query("time_split")
def q_time_split(spark, sf):
    """WIN3: positional 70/30 time split per group."""
    return fe.time_split(_dm(spark, sf).select(*GK, "date"), GK)


@query("hash_split")
def q_hash_split(spark, sf):
    """ML1: repeatable 80/20 split by md5 of the row key."""
    return fe.hash_split(_dm(spark, sf).select(*GK, "date"), [*GK, "date"])


@query("folds")
def q_folds(spark, sf):
    """WIN5: five contiguous folds in date order per group."""
    return fe.folds(_dm(spark, sf).select(*GK, "date"), GK)


@query("ols_two_feature")
def q_ols2(spark, sf):
    """ML2 + ML11: per group service level ~ Q2 + ABN % on the train part, MAE / R2 on the test part."""
    dm = fe.hash_split(_dm(spark, sf).select(*GK, "date", "q2", "abn_pct", F.col("met").alias("sl")),
                       [*GK, "date"])
    m = mo.moments(dm.where(F.col("part") == "train"), GK, ["q2", "abn_pct"], "sl")
    coef = m.select(*GK, F.col("n").cast("long").alias("n_train"), *mo.ols2_closed_form("q2", "abn_pct", "sl"))
    test = dm.where(F.col("part") == "test").join(coef, GK).withColumn("pred", mo.predict(["q2", "abn_pct"]))
    return coef.join(mo.metrics(test, GK, "sl"), GK, "left")


@query("standardized")
def q_standardized(spark, sf):
    """ML8: the week features scaled per group by their mean and population deviation."""
    rows = _dm(spark, sf).select(*GK, "date", *wi.WEEK_FEATURES).na.drop()
    scaler = rows.groupBy(*GK).agg(*(F.avg(f).alias(f"mean_{f}") for f in wi.WEEK_FEATURES),
                                   *(F.stddev_pop(f).alias(f"std_{f}") for f in wi.WEEK_FEATURES))
    return mo.scale(rows, scaler, GK, wi.WEEK_FEATURES)


@query("features_filled")
def q_features_filled(spark, sf):
    """ML10 + CLN12 + CLN10: the prepared measures of the forest, missing and infinite values as the group's mean."""
    x = fe.prepare_features(_dm(spark, sf))
    return fe.fill_means(x, GK, fo.MEASURES).select(*GK, "date", *fo.MEASURES)


@query("quantile_buckets")
def q_quantile_buckets(spark, sf):
    """RSH7 + ML12: ABN % in up to five buckets by the group's quantiles, their labels and alphabetical codes."""
    rows = cf.model_rows(_dm(spark, sf), GK)
    return qb.quantile_buckets(rows, GK, cf.TARGET).select(*GK, "date", "abn_pct", "n_buckets", "bucket", "label", "code")


# --- activity ----------------------------------------------------------------------------------------------

@query("sessions")
def q_sessions(spark, sf):
    """ACT1: inactivity sessions (gap 195 s) per user."""
    return act.sessions(ad.activity(spark, sf))


@query("session_summary")
def q_session_summary(spark, sf):
    """ACT2: per-user session totals."""
    return act.session_summary(act.session_rows(ad.activity(spark, sf)))


@query("tool_dwell")
def q_tool_dwell(spark, sf):
    """ACT3: one row per tool visit with its dwell time."""
    return act.tool_dwell(ad.activity(spark, sf))


@query("sessions_stream")
def q_sessions_stream(spark, sf):
    """ACT5: the sessions of ACT1 on Structured Streaming (watermark + session_window, closed sessions)."""
    from staffwise.streaming.sessions_stream import run_sessions_stream
    return run_sessions_stream(spark, sf)


# --- models (rows-only check: fitted per group from Gram sums, solved with numpy per group) ----------

def _week_means(dm):
    ws = F.to_date(F.lit(pp.WEEK_START))
    return dm.where(F.col("date").between(ws, F.date_add(ws, 6))).groupBy(*GK).agg(
        F.avg("q2").alias("m_q2"), F.avg("abn_pct").alias("m_abn_pct"), F.avg("occ_assumption").alias("m_occ_assumption"),
        F.avg("staffing").alias("m_staffing"), F.avg("occupancy_rate").alias("m_occupancy_rate"),
        (F.sum("demand") / 7.0).alias("m_demand"))


@query("sl_sensitivity", MODEL_DIGITS)
def q_sl_sensitivity(spark, sf):
    """ML2 + SCN9: service level predicted at the week's Q2 shifted by -2..+2 seconds, per group, with the
    model's accuracy on the rows it was not fitted on. Missing measures are 0."""
    from staffwise.constants import SL_Q2_OFFSETS
    dm = _dm(spark, sf).withColumnRenamed("met", "sl")
    coef = mo.held_out_fit(dm.na.fill(0.0, subset=["q2", "abn_pct", "sl"]), GK, ["q2", "abn_pct"], "sl", [*GK, "date"])
    grid = F.broadcast(spark.createDataFrame([(float(o),) for o in SL_Q2_OFFSETS], "q2_change double"))  # a fixed list
    x = _week_means(dm).join(coef, GK).crossJoin(grid).select(
        *GK, "q2_change", (F.col("m_q2") + F.col("q2_change")).alias("q2"), F.col("m_abn_pct").alias("abn_pct"),
        "intercept", "b_q2", "b_abn_pct", "n_eval", "mae", "r2")
    return x.select(*GK, "q2_change", "q2", "abn_pct", F.bround(mo.predict(["q2", "abn_pct"]), 4).alias("predicted_sl"),
                    "n_eval", "mae", "r2")


REQ_FEATURES = ["occ_assumption", "staffing", "demand", "occupancy_rate"]
#: Rows that miss one of these are not used by the requirement model.
REQ_COMPLETE = ["date", "met", "q2", "aht", "demand", "occ_assumption", "requirement", "staffing", "occupancy_rate",
                "staffing_diff", "abn_pct", "calls"]


def _requirement_model(dm):
    """ML3: lifted staffing, complete rows, 80 % of them by hash."""
    from staffwise.constants import STAFFING_UPLIFT
    rows = dm.withColumn("staffing", F.col("staffing") * STAFFING_UPLIFT)
    coef = mo.held_out_fit(rows.na.drop(subset=REQ_COMPLETE), GK, REQ_FEATURES, "requirement", [*GK, "date"])
    return _week_means(rows).join(coef, GK)


@query("fte_demand_grid", MODEL_DIGITS)
def q_fte_demand_grid(spark, sf):
    """ML3 + SCN10 + SCN11: FTE requirement predicted with daily demand changed by -25..+25 %, per group, with
    the model's accuracy on the rows it was not fitted on."""
    from staffwise.constants import PERCENT_STEPS_15
    grid = F.broadcast(spark.createDataFrame([(float(o),) for o in PERCENT_STEPS_15], "demand_change double"))  # a fixed list
    x = _requirement_model(_dm(spark, sf)).crossJoin(grid).select(
        *GK, "demand_change", F.col("m_occ_assumption").alias("occ_assumption"), F.col("m_staffing").alias("staffing"),
        (F.col("m_demand") * (1 + F.col("demand_change") / 100.0)).alias("demand"),
        F.col("m_occupancy_rate").alias("occupancy_rate"), "intercept", *[f"b_{f}" for f in REQ_FEATURES], "n_eval", "mae", "r2")
    return x.select(*GK, "demand_change", "demand", mo.predict(REQ_FEATURES).alias("prediction"),
                    mo.predict(REQ_FEATURES).cast("long").alias("fte"), "n_eval", "mae", "r2")


@query("fte_occ_grid", MODEL_DIGITS)
def q_fte_occ_grid(spark, sf):
    """ML3 + SCN12: FTE requirement predicted with the occupancy assumption moved -10..+10 points, clamped to [0, 1]."""
    from staffwise.constants import OCC_ASSUMPTION_POINT_STEPS
    from staffwise.functions.mathx import clamp
    grid = F.broadcast(spark.createDataFrame([(float(o),) for o in OCC_ASSUMPTION_POINT_STEPS], "occ_change double"))  # a fixed list
    x = _requirement_model(_dm(spark, sf)).crossJoin(grid).select(
        *GK, "occ_change", clamp(F.col("m_occ_assumption") + F.col("occ_change") / 100.0, 0.0, 1.0).alias("occ_assumption"),
        F.col("m_staffing").alias("staffing"), F.col("m_demand").alias("demand"),
        F.col("m_occupancy_rate").alias("occupancy_rate"), "intercept", *[f"b_{f}" for f in REQ_FEATURES])
    return x.select(*GK, "occ_change", "occ_assumption", mo.predict(REQ_FEATURES).alias("prediction"),
                    mo.predict(REQ_FEATURES).cast("long").alias("fte"))


@query("accuracy_log", MODEL_DIGITS)
def q_accuracy_log(spark, sf):
    """ML4 + ML11 + SNK5: train and test errors of the requirement model, appended to the accuracy log and read again."""
    records, path = wi.requirement_accuracy(_dm(spark, sf), GK), scratch_path(spark, "accuracy")
    sk.append_log(records, path)
    return spark.read.schema(records.schema).parquet(path)


@query("stored_model", MODEL_DIGITS)
def q_stored_model(spark, sf):
    """SNK4 + ML4 + ML8 + ML11: scaler and requirement model of each group, fitted on the earlier 70 % of its days,
    stored as versioned artefacts, loaded again and evaluated on both parts."""
    f, store = wi.WEEK_FEATURES, Artefacts(spark, scratch_path(spark, "artefacts"))
    parts = materialize(fe.time_split(_dm(spark, sf).select(*GK, "date", *f, "requirement").na.drop(), GK))
    fitted = mo.Scaled.fit(parts.where("part = 'train'"), GK, f, "requirement")
    for name, table in (("requirement/scaler", fitted.scaler), ("requirement/model", fitted.model)):
        store.save_table(name, table)
    loaded = mo.Scaled(store.load_table("requirement/scaler"), store.load_table("requirement/model"))
    return mo.metrics(loaded.predict(parts, GK, f), [*GK, "part"], "requirement")


#: The choice that the scenario pages start with; forests and the classifier are fitted for it in every language.
CHOICE = "req_media = 'OPI' AND usd = 'Combined' AND level = 'Combined'"


def _forests(spark, sf):
    """The forest's rows of the choice and a fitted forest per language; the languages are fitted side by side."""
    rows = materialize(fo.forest_rows(_dm(spark, sf).where(CHOICE), GK))
    languages = sorted(r["language"] for r in rows.select("language").distinct().collect())  # one forest each: a short list
    part = {x: rows.where(F.col("language") == x) for x in languages}
    with ThreadPoolExecutor(max_workers=4) as pool:
        fitted = pool.map(lambda x: fo.fit_forest(part[x].where("part = 'train'"), fo.FEATURES), languages)
        return rows, {x: (part[x], f) for x, f in zip(languages, fitted) if f}


@query("forest_importance")
def q_forest_importance(spark, sf):
    """ML9 + ML10 + ML11: importance of every feature for staffing, those kept, R2 of the forest refitted on them."""
    out = []
    for language, (rows, forest) in _forests(spark, sf)[1].items():
        got = fo.scores(forest, rows)
        (n_train, r2_train), (n_test, r2_test) = (got.get(p, (0, None)) for p in ("train", "test"))
        out += [(language, f, w, f in forest.features, n_train, n_test, r2_train, r2_test) for f, w in forest.importances.items()]
    return spark.createDataFrame(out, "language string, feature string, importance double, kept boolean, n_train long, "
                                      "n_test long, r2_train double, r2_test double")


@query("forest_effect")
def q_forest_effect(spark, sf):
    """SCN16 + SNK4 + ML9 + AGG21: staffing predicted by the stored forest with each kept feature's weekly mean changed
    by -100..+100 %, every language."""
    store, out = Artefacts(spark, scratch_path(spark, "artefacts")), None
    for language, (rows, forest) in _forests(spark, sf)[1].items():
        name = f"staffing/{language}"
        store.save_model(name, forest.model)
        start = F.to_date(F.lit(pp.WEEK_START))
        part = fo.staffing_effect(store.load_model(name), forest.features,
                                  rows.where(F.col("date").between(start, F.date_add(start, 6))), GK)
        out = part if out is None else out.unionByName(part)
    return out


@query("abn_classifier")
def q_abn_classifier(spark, sf):
    """ML13 + ML12 + RSH7: classifier of the ABN % bucket over all languages of the choice: grid search over
    stratified folds, report per class on the held-out fifth."""
    return cf.class_report(cf.fit_classifier(materialize(cf.classifier_rows(_dm(spark, sf).where(CHOICE), GK))))


@query("abn_transitions")
def q_abn_transitions(spark, sf):
    """SCN18: predicted ABN % bucket of every held-out row before and after a change of one feature, as counts."""
    fitted = cf.fit_classifier(materialize(cf.classifier_rows(_dm(spark, sf).where(CHOICE), GK)))
    return cf.transitions(fitted)


@query("fte_week", MODEL_DIGITS)
def q_fte_week(spark, sf):
    """ML4 + SCN13: requirement of each day of the week with demand changed by -25..+25 %, per group."""
    from staffwise.constants import PERCENT_STEPS_15
    return wi.fte_week(_dm(spark, sf), pp.WEEK_START, GK, PERCENT_STEPS_15)


@query("fte_week_totals", MODEL_DIGITS)
def q_fte_week_totals(spark, sf):
    """SCN13: the week's means and totals of fte_week and the change of the requirement."""
    from staffwise.constants import PERCENT_STEPS_15
    return wi.fte_week_totals(wi.fte_week(_dm(spark, sf), pp.WEEK_START, GK, PERCENT_STEPS_15), GK)


@query("lasso_cv")
def q_lasso_cv(spark, sf):
    """ML6 + ML7 + ML11: lasso of the requirement on six features per group, five-fold R2."""
    return lo.fit_lasso(_dm(spark, sf), GK)


@query("lasso_demand")
def q_lasso_demand(spark, sf):
    """SCN17 + SRT3 + MTH4: requirement by the lasso with calls raised by 5..25 %, per group."""
    dm = _dm(spark, sf)
    return lo.demand_effect(dm, lo.fit_lasso(dm, GK), GK)


@query("kpi_per_fte", MODEL_DIGITS)
def q_kpi_per_fte(spark, sf):
    """ML5 + SCN15: requirement and calls per FTE with the week's KPIs moved by -25..+25 %, per group."""
    from staffwise.constants import PERCENT_STEPS_15, STAFFING_UPLIFT
    dm = _dm(spark, sf).withColumn("staffing", F.col("staffing") * STAFFING_UPLIFT)
    week = dm.where(F.col("date").between(F.to_date(F.lit(pp.WEEK_START)), F.date_add(F.to_date(F.lit(pp.WEEK_START)), 6)))
    return wi.kpi_per_fte(dm, week, GK, PERCENT_STEPS_15)
