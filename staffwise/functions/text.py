"""Text expressions (STR1-STR8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staffwise.constants import LANGUAGE_ALIASES, PLANNER_MARKER


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has_parens(s: Column) -> Column:
    return s.rlike(r"\([^)]*\)")


def level_in_parens(c) -> Column:
    """STR1: text between the first '(' and the next ')', kept only if it names L3/L4/L5/Combined."""
    s = _c(c)
    inner = F.regexp_extract(s, r"\(([^)]*)\)", 1)
    ok = _has_parens(s) & inner.rlike("L3|L4|L5|Combined")
    return F.when(ok, inner)


def category_of_label(c) -> Column:
    """STR2: USD, else Global, else Combined (by containment), only for labels with parentheses."""
    s = _c(c)
    cat = (F.when(s.contains("USD"), F.lit("USD"))
           .when(s.contains("Global"), F.lit("Global"))
           .when(s.contains("Combined"), F.lit("Combined")))
    return F.when(_has_parens(s), cat)


def level_of_text(c) -> Column:
    """STR3: L3 / L4 / L5 by upper-cased containment, else 'Other'."""
    u = F.upper(_c(c).cast("string"))
    return (F.when(u.contains("L3"), F.lit("L3")).when(u.contains("L4"), F.lit("L4"))
            .when(u.contains("L5"), F.lit("L5")).otherwise(F.lit("Other")))


def after_marker(c, marker: str = PLANNER_MARKER) -> Column:
    """STR4: text after the first marker, trimmed; NULL when the marker is absent."""
    s = _c(c)
    pos = F.instr(s, marker)
    return F.when(pos > 0, F.trim(F.substring(s, pos + F.lit(len(marker)), F.lit(1 << 30))))


def language_alias(c) -> Column:
    """STR7: map short codes to the language name used in the FTE export."""
    out = _c(c)
    for k, v in LANGUAGE_ALIASES.items():
        out = F.when(_c(c) == k, F.lit(v)).otherwise(out)
    return out


def media_of_sheets(c) -> Column:
    """STR8: planner kind from the sheet text: contains OPI -> OPI, else VIDEO."""
    return F.when(F.upper(_c(c)).contains("OPI"), F.lit("OPI")).otherwise(F.lit("VIDEO"))


def prefix_match(code, name) -> Column:
    """STR5: upper-cased name starts with the trimmed, upper-cased code."""
    return F.upper(_c(name)).startswith(F.upper(F.trim(_c(code))))


def contains_match(code, name) -> Column:
    """STR6: the older variant, containment instead of prefix."""
    return F.upper(_c(name)).contains(F.upper(F.trim(_c(code))))
