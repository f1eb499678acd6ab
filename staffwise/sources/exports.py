"""CSV exports in a folder: scan by file name prefix (SRC1, SRC5, SRC6).

Every column is read as text; the converters of ``functions.clean`` give the types. Files of one
prefix may have different headers: files with equal headers are one scan, and the scans are united
by column name. Only the header lines and the list of files are seen by the driver.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Data files whose name, or whose folder's name, starts with ``prefix``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{prefix}*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(path) or []:
        inner = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [f.getPath().toString() for f in inner
                if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "_."]
    return sorted(out)


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(c.strip() for c in next(csv.reader([(line or "").lstrip("\ufeff")]), []))


def read_exports(spark: SparkSession, folder: str, required: dict[str, list[str]]) -> dict[str, DataFrame]:
    """prefix -> text columns of all its files. ``required`` has the columns each prefix must have.

    Raises if a prefix has no file (SRC6) or none of its files has a required column; a file
    without one of them gives NULL there.
    """
    files = {prefix: _files(spark, folder, prefix) for prefix in required}
    if none := [p for p, f in files.items() if not f]:
        raise ValueError(f"no file in {folder} for: {', '.join(none)}")
    out = {}
    for prefix, paths in files.items():
        by_header: dict[tuple, list[str]] = {}
        for p in paths:
            by_header.setdefault(_header(spark, p), []).append(p)
        scans = [spark.read.schema(", ".join(f"`{c}` string" for c in header)).option("header", True)
                 .option("multiLine", False).csv(same) for header, same in by_header.items()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
        if missing := [c for c in required[prefix] if c not in df.columns]:
            raise ValueError(f"{prefix} in {folder} lacks: {', '.join(missing)}")
        out[prefix] = df
    return out
