import datetime as dt
import itertools

from pyspark.sql import functions as F

from staffwise.operators import activity, fte, lookalike as la


def _hist(spark, rows):
    return spark.createDataFrame(rows, "language string, req_media string, usd string, level string, date date, "
                                       "year int, demand double, staffing double, staffing_raw double, uplift double, "
                                       "calls double, q2 double, occupancy_rate double, abn_pct double, "
                                       "service_level double, occ_assumption double")


def test_band_join_matches_brute_force(spark):
    rows = []
    d0 = dt.date(2001, 5, 1)
    for i, (d, s) in enumerate(itertools.product([0.0, 50.0, 90.0, 100.0, 105.0, 110.0, 111.0, 130.0],
                                                 [8.0, 9.0, 10.0, 11.0, 12.0])):
        rows.append(("A", "OPI", "USD", "L3", d0 + dt.timedelta(days=i), 2001, d, s * 1.4, s, 1.4, 10.0,
                     20.0 + i, 0.8, 2.0, 0.9, 0.75))
    h = _hist(spark, rows)
    tg = spark.createDataFrame([("A", "OPI", "USD", "L3", dc, sc, 100.0 * (1 + dc / 100), 14.0 * (1 + sc / 100))
                                for dc in (-10.0, 0.0, 10.0, -100.0) for sc in (0.0, 5.0)],
                               "language string, req_media string, usd string, level string, demand_change double, "
                               "staffing_change double, new_demand double, new_staffing double")
    got = sorted((r.demand_change, r.staffing_change, r.q2) for r in la.band_join(h, tg).collect())
    want = []
    for t in tg.collect():
        for r in rows:
            if 0.9 * t.new_demand <= r[6] <= 1.1 * t.new_demand and 0.9 * t.new_staffing <= r[7] <= 1.1 * t.new_staffing:
                want.append((t.demand_change, t.staffing_change, r[11]))
    assert got == sorted(want)
    # the -100 % scenario has a zero target: it matches exactly the zero-demand rows
    assert any(x[0] == -100.0 for x in got)


def test_scenario_origin_has_zero_delta(spark):
    rows = [("A", "OPI", "USD", "L3", dt.date(2001, 6, 3) + dt.timedelta(days=i), 2001, 100.0 + i, 14.0, 10.0, 1.4,
             10.0, 20.0 + i, 0.8, 2.0, 0.9, 0.75) for i in range(30)]
    h = _hist(spark, rows)
    ch = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0)], "demand_change double, staffing_change double")
    out = {(r.demand_change, r.staffing_change): r for r in la.evaluate(h, "2001-06-03", ch, "weighted", 2001).collect()}
    o = out[(0.0, 0.0)]
    assert abs(o.new_q2 - o.q2) < 1e-12 and o.reliability in ("Moderate", "High")
    assert out[(5.0, 0.0)].n_matches > 0


def test_fte_combined_totals(spark):
    d = dt.date(2001, 1, 1)
    rows = [(d, "X", u, lv, float(i + 1), float(10 * (i + 1))) for i, (u, lv) in
            enumerate(itertools.product(["USD", "Global"], ["L3", "L4", "L5"]))]
    rows.append((d, "X", "USD", "Ot", 100.0, 100.0))
    t = spark.createDataFrame(rows, "date date, language string, usd string, level string, total_opi double, "
                                    "total_vri double")
    out = {(r.usd, r.level): r for r in fte.fte_combined(t).collect()}
    assert out[("Combined", "Combined")].total_opi == sum(range(1, 7))
    assert out[("Combined", "L3")].total_vri is None
    assert out[("USD", "Combined")].total_vri == 20 + 30        # VRI leaves L3 out
    assert out[("USD", "Ot")].total_opi == 100.0                # other levels stay detail only
    assert len(out) == 7 + 6


def test_sessions_split_across_chunks(spark):
    base = dt.datetime(2024, 1, 1, 0, 58, 0)
    ts = [base, base + dt.timedelta(seconds=100), base + dt.timedelta(seconds=250),   # crosses 01:00
          base + dt.timedelta(seconds=600)]
    ev = spark.createDataFrame([(1, "a", t) for t in ts], "user long, tool string, ts timestamp")
    s = sorted((r.n_events, r.total_seconds) for r in activity.sessions(ev).collect())
    assert s == [(1, 0.0), (3, 250.0)]
