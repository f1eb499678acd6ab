"""Cleaning and casting expressions (CLN1-CLN13). All JVM-side; bad text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffwise.functions.dates import lenient_day


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c) -> Column:
    """CLN1: strip '%' and thousands commas, cast leniently to double (bad text -> NULL)."""
    x = F.trim(F.regexp_replace(_c(c).cast("string"), "[%,]", "")).try_cast("double")
    # NaN means missing, as in the exports
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def percent(c) -> Column:
    """CLN2: numeric() then divide by 100."""
    return numeric(c) / F.lit(100.0)


def inf_to_null(c) -> Column:
    """CLN12: +-inf and NaN become NULL."""
    x = _c(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def safe_delta(new, old) -> Column:
    """CLN13: (new-old)/old when old is present and non-zero, else 0 (a NULL new stays NULL)."""
    o = _c(old)
    return F.when(o.isNotNull() & ~F.isnan(o) & (o != 0), (_c(new) - o) / o).otherwise(F.lit(0.0))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """CLN8: lenient numeric cast of a column list."""
    return df.withColumns({c: _c(c).cast("string").try_cast("double") for c in cols})


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """CLN9: NULL -> 0 on numeric columns (all numeric columns when cols is None)."""
    return df.na.fill(0, subset=cols) if cols else df.na.fill(0)


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """CLN11: drop rows with a NULL in any of cols (all columns when None)."""
    return df.na.drop(how="any", subset=cols)


def impute_mean(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """CLN10: NULL -> mean of the column over all rows (or within ``by`` groups).

    The means are a one-row (or one-row-per-group) aggregate joined back; partial aggregation
    keeps the aggregate cheap, and AQE broadcasts the tiny side once its real size is known.
    """
    by = by or []
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"__mean_{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(means)) if not by else df.join(means, on=by, how="left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__mean_{c}")) for c in cols}).drop(
        *[f"__mean_{c}" for c in cols])


# --- converters for the four CSV exports (CLN3-CLN7) -------------------------------------------

def convert_calls(df: DataFrame, date_col: str = "date_text", parse=lenient_day) -> DataFrame:
    """CLN3: calls export: lenient date (``parse``: day or minute), numeric on five columns, percent on two."""
    return df.select(
        parse(date_col).alias("date"),
        "language", "usd", "req_media", "level",
        numeric("abns").alias("abns"),
        numeric("calls").alias("calls"),
        numeric("q2").alias("q2"),
        numeric("aht").alias("aht"),
        numeric("abn_pct").alias("abn_pct"),
        percent("met").alias("met"),
        percent("missed").alias("missed"),
    )


def convert_fte(df: DataFrame, date_col: str = "date_text", parse=lenient_day) -> DataFrame:
    """CLN4: fte export: level_ix = first two chars of agent type, location/product renamed and mapped."""
    from staffwise.constants import FTE_LOCATION_MAP, FTE_PRODUCT_MAP
    loc = F.col("location")
    for k, v in FTE_LOCATION_MAP.items():
        loc = F.when(F.col("location") == k, F.lit(v)).otherwise(loc)
    prod = F.col("product")
    for k, v in FTE_PRODUCT_MAP.items():
        prod = F.when(F.col("product") == k, F.lit(v)).otherwise(prod)
    return df.select(
        parse(date_col).alias("date"),
        "language",
        loc.alias("usd"),
        F.substring(F.col("agent_type").cast("string"), 1, 2).alias("level_ix"),
        prod.alias("req_media"),
        numeric("weekly_ftes").alias("weekly_ftes"),
    )


def convert_occ(df: DataFrame, date_col: str = "date_text", parse=lenient_day) -> DataFrame:
    """CLN5 + CLN7: occ export: numeric OCC (no /100), media 'Video' -> 'VIDEO'."""
    from staffwise.constants import OCC_MEDIA_MAP
    media = F.col("req_media")
    for k, v in OCC_MEDIA_MAP.items():
        media = F.when(F.col("req_media") == k, F.lit(v)).otherwise(media)
    return df.select(parse(date_col).alias("date"), "language", "usd", "level",
                     media.alias("req_media"), numeric("occ").alias("occ"))


def convert_hybrid(df: DataFrame) -> DataFrame:
    """CLN6: hybrid shares: percent text -> fraction."""
    return df.select("language", "src_order", percent("l4_hybrid_pct").alias("l4_hybrid_pct"),
                     percent("l5_hybrid_pct").alias("l5_hybrid_pct"))
