"""FTE shaping: media pivot, hybrid split and combined-level roll-up (AGG1, AGG2, AGG4, AGG5, PRJ6, PRJ9-PRJ11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffwise.constants import COMBINED, DETAIL_LEVELS, DETAIL_USD, MEDIA
from staffwise.functions.text import level_of_text, prefix_match

# which hybrid share applies to which level (Q1: the intent; pass {} to reproduce "never applies")
DEFAULT_HYBRID_KEYS = {"L4": "l4_hybrid_pct", "L5": "l5_hybrid_pct"}

# the six combined cells of every (date, language); VRI of (Combined, L3) is undefined
COMBINED_CELLS = [(COMBINED, "L3"), (COMBINED, "L4"), (COMBINED, "L5"),
                  ("USD", COMBINED), ("Global", COMBINED), (COMBINED, COMBINED)]


def match_languages(codes: DataFrame, hybrid: DataFrame, code_col: str = "language") -> DataFrame:
    """STR5: for each distinct code, the first hybrid row (by ``src_order``) whose name starts with it.

    Codes and hybrid rows are both one row per language, so the prefix (non-equi) match runs on two
    small distinct sets and the result is joined back by equality.
    """
    c = codes.select(F.col(code_col).alias("code")).distinct()
    m = c.join(hybrid, prefix_match(F.col("code"), F.col("language")))
    return m.groupBy("code").agg(
        F.min_by(F.struct("language", "l4_hybrid_pct", "l5_hybrid_pct"), F.col("src_order")).alias("h")
    ).select("code", F.col("h.language").alias("matched_language"),
             F.col("h.l4_hybrid_pct").alias("l4_hybrid_pct"), F.col("h.l5_hybrid_pct").alias("l5_hybrid_pct"))


def fte_pivot(fte: DataFrame) -> DataFrame:
    """AGG2 + PRJ6: weekly FTEs per (date, usd, language, level_ix) with Hybrid / OPI / VIDEO columns (0 when absent)."""
    f = fte.where(F.col("date").isNotNull()).na.fill(0, ["weekly_ftes"])
    p = f.groupBy("date", "usd", "language", "level_ix").pivot("req_media", MEDIA).agg(F.sum("weekly_ftes"))
    return p.na.fill(0, MEDIA)


def hybrid_split(pivoted: DataFrame, shares: DataFrame, hybrid_keys: dict | None = None,
                 shared: bool = False) -> DataFrame:
    """PRJ9-PRJ11: split Hybrid FTEs into OPI and VRI shares by the per-language share of the level.

    ``shares`` has (language, l4_hybrid_pct, l5_hybrid_pct); ``shared=True`` is the older variant that
    adds the VRI share to both media (PRJ10).
    """
    keys = DEFAULT_HYBRID_KEYS if hybrid_keys is None else hybrid_keys
    pct = F.lit(0.0)
    for lvl, colname in keys.items():
        pct = F.when(F.col("level_ix") == lvl, F.col(colname)).otherwise(pct)
    j = pivoted.join(shares.select("language", *set(keys.values()) or ["language"]), "language", "left") \
        if keys else pivoted
    j = j.withColumn("hybrid_pct", F.coalesce(pct, F.lit(0.0)))
    vri_share = F.col("Hybrid") * F.col("hybrid_pct")
    opi_share = vri_share if shared else F.col("Hybrid") - vri_share
    return j.select("date", "language", "usd", F.col("level_ix").alias("level"),
                    (F.col("OPI") + opi_share).alias("total_opi"),
                    (F.col("VIDEO") + vri_share).alias("total_vri"))


def fte_combined(totals: DataFrame) -> DataFrame:
    """AGG1 + AGG4 + AGG5: detail rows plus the six combined (usd, level) rows per (date, language).

    Grouping sets over (usd) and (level) inside (date, language) replace the per-day Python loop;
    only USD/Global x L3-L5 feed the roll-up, VRI totals leave L3 out, and a fixed six-row spine
    guarantees every combined row (0 when there is nothing to add).
    """
    det = totals.groupBy("date", "language", "usd", "level").agg(
        F.sum("total_opi").alias("total_opi"), F.sum("total_vri").alias("total_vri"))
    inbox = det.where(F.col("usd").isin(DETAIL_USD) & F.col("level").isin(DETAIL_LEVELS))
    gs = inbox.groupingSets(
        [["date", "language", "usd"], ["date", "language", "level"], ["date", "language"]],
        "date", "language", "usd", "level",
    ).agg(F.sum("total_opi").alias("opi"),
          F.sum(F.when(F.col("level") != "L3", F.col("total_vri"))).alias("vri"),
          F.grouping_id().alias("gid"))
    labelled = gs.select("date", "language",
                         F.coalesce("usd", F.lit(COMBINED)).alias("usd"),
                         F.coalesce("level", F.lit(COMBINED)).alias("level"), "opi", "vri")
    days = gs.where(F.col("gid") == 3).select("date", "language")
    spine = F.broadcast(totals.sparkSession.createDataFrame(COMBINED_CELLS, "usd string, level string"))
    comb = days.crossJoin(spine).join(labelled, ["date", "language", "usd", "level"], "left").select(
        "date", "language", "usd", "level",
        F.coalesce("opi", F.lit(0.0)).alias("total_opi"),
        F.when((F.col("usd") == COMBINED) & (F.col("level") == "L3"), F.lit(None).cast("double"))
        .otherwise(F.coalesce("vri", F.lit(0.0))).alias("total_vri"))
    return det.unionByName(comb)


def fte_levels(fte_converted: DataFrame) -> DataFrame:
    """STR3 on the two-character level code (kept as level_ix for the pivot)."""
    return fte_converted.withColumn("level_ix", level_of_text("level_ix"))
