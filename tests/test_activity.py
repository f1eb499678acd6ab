"""Sessions and visits against one pass in order, with users that fill several chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from staffwise.operators import activity

GAP = 195


def make(seed, n):
    rng, rows, t0 = random.Random(seed), [], dt.datetime(2024, 5, 1)
    for i in range(n):
        user = rng.choice(["hot"] * 12 + ["a", "b", None])
        # the hot user's events crowd into a few hours, with ties and repeats
        ts = t0 + dt.timedelta(seconds=rng.choice([rng.randrange(7200), rng.randrange(40) * 10, rng.randrange(400_000)]))
        rows.append((user, rng.choice(["x", "y,z", "w", None]), ts))
    return rows + rows[:20] + [("a", "x", None)]


def by_user(rows):
    out = {}
    for u, tool, ts in rows:
        if ts is not None:
            out.setdefault(u, []).append((ts, tool is not None, tool or "", tool))
    return {u: [(r[0], r[3]) for r in sorted(v)] for u, v in out.items()}


def brute_sessions(rows):
    out = []
    for u, events in by_user(rows).items():
        now = None
        for ts, tool in events:
            if now is None or (ts - now[2]).total_seconds() > GAP:
                now = [u, ts, ts, 0, set()]
                out.append(now)
            now[2], now[3] = ts, now[3] + 1
            now[4] |= {tool} - {None}
    return sorted(((u, s, e, n, (e - s).total_seconds(), sorted(t)) for u, s, e, n, t in out), key=str)


def brute_visits(rows):
    out = []
    for u, events in by_user(rows).items():
        runs = []
        for ts, tool in events:
            if not runs or runs[-1][0] != tool:
                runs.append([tool, ts, ts])
            runs[-1][2] = ts
        for r, after in zip(runs, [*runs[1:], None]):
            out.append((u, r[0], r[1], ((after[1] if after else r[2]) - r[1]).total_seconds()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunks", [1, 3, 17])
def test_sessions_and_visits_in_any_number_of_chunks(spark, chunks):
    rows = make(chunks, 900)
    ev = spark.createDataFrame(rows, "user string, tool string, ts timestamp").withColumn("extra", F.lit(1))
    got = [tuple(r) for r in activity.session_rows(ev, GAP, chunks).collect()]
    want = brute_sessions(rows)
    assert sorted([(u, s, e, n, sec, list(t)) for u, s, e, n, sec, t in got], key=str) == want
    assert sorted(map(tuple, activity.tool_dwell(ev, chunks).collect()), key=str) == brute_visits(rows)
    summary = {r["user"]: r for r in activity.session_summary(activity.session_rows(ev, GAP, chunks)).collect()}
    for u, r in summary.items():
        mine = [w for w in want if w[0] == u]
        assert (r["n_sessions"], r["n_events"]) == (len(mine), sum(w[3] for w in mine))
        assert r["n_tools"] == len({t for w in mine for t in w[5]}) and r["ended_at"] == max(w[2] for w in mine)
        assert r["total_seconds"] == pytest.approx(sum(w[4] for w in mine))


def test_chunks_are_even_for_a_hot_user(spark):
    ev = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user"),
                                    F.lit("x").alias("tool"), F.timestamp_seconds(F.col("id") % 50).alias("ts"))
    sizes = [r["n"] for r in activity.chunked(ev, 16).groupBy("chunk").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 20_000 / 16
    assert activity.session_rows(ev, GAP, 16).where("user = 'hot'").collect()[0]["n_events"] == 10_000


def test_no_events(spark):
    none = spark.createDataFrame([], "user string, tool string, ts timestamp")
    assert activity.session_rows(none).collect() == [] and activity.tool_dwell(none).collect() == []
    assert activity.session_summary(activity.session_rows(none)).collect() == []
