"""Date expressions (DAT1-DAT10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# day-first formats are tried before month-first ones
DAY_FORMATS = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy/M/d", "M/d/yyyy",
               "yyyy-M-d H:m:s", "yyyy-M-d H:m", "d-M-yyyy H:m", "d/M/yyyy H:m"]
# DAT2 priority order, then a general fallback
MINUTE_FORMATS = ["d-M-yyyy H:m", "yyyy-M-d H:m", "d/M/yyyy H:m", "M/d/yyyy H:m"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_day(c) -> Column:
    """DAT1 + DAT3: mixed-format text (day first), then a general parse -> DATE; unparseable -> NULL."""
    s = F.trim(_c(c).cast("string"))
    return F.to_date(F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DAY_FORMATS], s.try_cast("timestamp")))


def lenient_minute(c) -> Column:
    """DAT2: four formats in priority order, then a general parse; floored to the minute."""
    s = F.trim(_c(c).cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in MINUTE_FORMATS], s.try_cast("timestamp"))
    return F.date_trunc("minute", parsed)


def sunday_on_or_before(c) -> Column:
    """DAT7: the Sunday on or before the date."""
    return F.date_sub(F.next_day(_c(c), "Sun"), 7)


def sunday_strictly_before(c) -> Column:
    """DAT8: the Sunday before the date; a Sunday maps to the one 7 days earlier."""
    return F.date_sub(F.next_day(F.date_sub(_c(c), 1), "Sun"), 7)


def week_of_year_sunday(c) -> Column:
    """DAT9: Sunday-based week of year (strftime %U): days before the first Sunday are week 0."""
    d = _c(c)
    return F.floor((F.dayofyear(d) - 1 + 7 - (F.dayofweek(d) - 1)) / 7).cast("int")


def latest_sunday(c) -> Column:
    """DAT6 (aggregate): the latest date in the column that is a Sunday."""
    return F.max(F.when(F.dayofweek(_c(c)) == 1, _c(c)))


def week_days(start) -> Column:
    """DAT10 / RSH1: the 7 dates start .. start+6 as an array (explode it)."""
    s = _c(start)
    return F.sequence(s, F.date_add(s, 6))


def week_hours(start) -> Column:
    """RSH3: the 168 hourly timestamps of the week starting at ``start``."""
    ts = _c(start).cast("timestamp")
    return F.sequence(ts, ts + F.expr("INTERVAL 167 HOURS"), F.expr("INTERVAL 1 HOUR"))
