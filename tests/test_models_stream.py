"""Least squares at realistic magnitudes, and the session stream against the batch sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffwise.operators import activity, models, planner
from staffwise.sources import adapters
from staffwise.streaming.sessions_stream import run_sessions_stream

SF = "/root/testdata/sf0.001"


def test_least_squares_at_large_magnitudes(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for g in range(6):
        n = 80
        demand = rng.uniform(103_631, 124_479, n)
        occ, staff = rng.uniform(0.6, 0.8, n), rng.uniform(90, 120, n)
        same = np.full(n, 7.25)
        y = 3 + 2e-4 * demand + 40 * occ - 0.1 * staff + rng.normal(0, 0.01, n)
        data += [(f"g{g}", *map(float, r)) for r in zip(demand, occ, staff, same, y)]
        x = np.column_stack([np.ones(n), demand - demand.mean(), occ, staff])
        c = np.linalg.lstsq(x, y, rcond=None)[0]
        want[f"g{g}"] = [c[0] - c[1] * demand.mean(), c[1], c[2], c[3], 0.0]
    data += [("flat", float(i), 2.0 * i, 1.0, 1.0, float(i)) for i in range(9)] + [("g0", None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, demand double, occ double, staff double, same double, y double")
    names = ["demand", "occ", "staff", "same"]
    got = {r.g: r for r in models.fit_ols(df, ["g"], names, "y").collect()}
    for g, c in want.items():
        assert np.allclose([got[g].intercept, *(got[g][f"b_{f}"] for f in names)], c, rtol=1e-6, atol=1e-8)
    assert got["flat"].b_demand is None  # collinear features
    assert models.fit_ols(df.limit(0), ["g"], names, "y").collect() == []


@pytest.mark.parametrize("layout", ["file", "folder", "interleaved"])
def test_stream_gives_the_batch_sessions(spark, tmp_path, layout):
    events = spark.read.parquet(f"{SF}/events.parquet")
    sf = SF
    if layout != "file":
        sf = str(tmp_path)
        parts = events.repartition(4, F.col("event_id") % 4) if layout == "interleaved" else events.repartitionByRange(4, "ts")
        parts.write.parquet(f"{sf}/events.parquet")
    got = sorted(map(tuple, run_sessions_stream(spark, sf).collect()))
    assert got == sorted(map(tuple, activity.sessions(adapters.activity(spark, SF)).collect()))


def test_missing_sheet_raises(spark):
    cells = spark.createDataFrame([("w", "a", 3, 3, "Week Of:")], "workbook string, sheet string, row int, col int, value string")
    with pytest.raises(ValueError, match="'b'"):
        planner.shape_planner(cells, ["a", "b"])
