"""Line dedup over overlapping windows of three lines.

Every run of three consecutive lines is a window, keyed by 128 bits of hash. A window that stands at
more than one place keeps its first place, by document id and line number; at every later place its
three lines are covered, and the union of covered lines is removed from the document. Only window
keys and line numbers are shuffled; occurrences of one window are combined before the shuffle, and
the later places come from an equi-join that adaptive execution can split when one window holds a
large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 3


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Row keys: null ids come last, rows that share an id are told apart by their text."""
    return [F.col(id_col).isNull().alias("k_null"), F.coalesce(F.col(id_col), F.lit(0)).alias("k_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_text")]


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``(k_null, k_id, k_text, covered)``: 0-based numbers of the lines to remove, for rows with any."""
    row = docs.select(*_keys(id_col, text_col), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("l"))
    row = row.where(F.size("l") >= lines)
    at = F.sequence(F.lit(0), F.size("l") - lines)

    def window(i: Column) -> Column:
        part = [F.get("l", i + j) for j in range(lines)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("|"), *reversed(part)).alias("h2"))

    places = row.select("k_null", "k_id", "k_text", F.posexplode(F.transform(at, window)).alias("pos", "w")).select(
        "w.h1", "w.h2", F.struct("k_null", "k_id", "k_text", "pos").alias("place"))
    first = (places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
             .where("first <> last").select("h1", "h2", "first"))
    later = places.join(first, ["h1", "h2"]).where("place > first").select("place.*")
    return (later.groupBy("k_null", "k_id", "k_text").agg(F.collect_set("pos").alias("starts"))
            .select("k_null", "k_id", "k_text", F.array_distinct(F.flatten(F.transform(
                "starts", lambda p: F.array(*(p + j for j in range(lines)))))).alias("covered")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of the text, plus ``_lines`` and
    ``_removed`` counts. One row per input row.

    Lines are split at "\\n" alone. Texts of fewer than ``lines`` lines have no window and stay; null
    stays null. A text may become empty. Rows that repeat an id and its text are one document: none
    is a later occurrence of the other, and all get the same result. Null ids order after all others.
    """
    cut = covered_lines(docs, id_col, text_col, lines)
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *_keys(id_col, text_col))
    text = F.col("row").getField(text_col)
    joined = row.join(cut, ["k_null", "k_id", "k_text"], "left").select(
        "row", "covered", F.split(F.coalesce(text, F.lit("")), "\n").alias("l"))
    # a set difference of line numbers: time in proportion to the lines, however many are covered
    numbers = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "covered")
    kept = F.array_join(F.transform(numbers, lambda i: F.get("l", i)), "\n")
    return joined.select(
        *((F.when(F.col("covered").isNull(), text).otherwise(kept) if c == text_col else F.col("row").getField(c)).alias(c)
          for c in names),
        F.size("l").cast("long").alias("_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("_removed"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(a) - 2)) AS p, a FROM l WHERE len(a) >= 3),
k AS (SELECT doc_id, p, a[p + 1] || chr(10) || a[p + 2] || chr(10) || a[p + 3] AS t FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS n FROM k),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE n > 1),
g AS (SELECT doc_id, list(p) AS cut FROM c GROUP BY doc_id)
SELECT doc_id, len(a)::BIGINT AS n_lines, coalesce(len(cut), 0)::BIGINT AS n_removed,
  md5(array_to_string([x FOR x, i IN a IF cut IS NULL OR NOT list_contains(cut, i - 1)], chr(10))) AS text_md5
FROM l LEFT JOIN g USING (doc_id)
"""
