import datetime as dt

import numpy as np
import pytest

from staffwise.operators import whatif

SCHEMA = ("g string, date date, calls double, demand double, q2 double, abn_pct double, occ_assumption double, "
          "staffing double, occupancy_rate double, requirement double")


def _hist(noise):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b"):
        for i in range(60):
            calls, demand, q2, abn = rng.uniform(50, 90), rng.uniform(1e5, 1.2e5), rng.uniform(10, 30), rng.uniform(1, 4)
            assume, staff, occ = rng.uniform(0.6, 0.8), rng.uniform(80, 120), rng.uniform(0.5, 0.9)
            rows.append([g, dt.date(2025, 1, 1) + dt.timedelta(i), calls, demand, q2, abn, assume, staff, occ])
    x = np.array([r[2:] for r in rows])
    return rows, x, rng.normal(0, noise, len(rows)) if noise else np.zeros(len(rows))


def test_kpi_per_fte_follows_a_linear_requirement(spark):
    rows, x, _ = _hist(0)
    y = 5 + 0.3 * x[:, 2] - 2 * x[:, 3] + 40 * x[:, 4] + 0.1 * x[:, 5] + 7 * x[:, 6]
    hist = spark.createDataFrame([(*r, float(v)) for r, v in zip(rows, y)], SCHEMA)
    week = hist.where("g = 'a' AND date < '2025-01-08'")
    got = {r.change: r for r in whatif.kpi_per_fte(hist, week, ["g"], [-10, 0, 25]).collect()}
    assert sorted(got) == [-10.0, 0.0, 25.0]
    calls, staff = np.median(x[:7, 0]), np.median(x[:7, 5])
    q2, abn, assume, occ = x[:7, [2, 3, 4, 6]].mean(0)
    for c, r in got.items():
        u = 1 + c / 100
        assert r.prediction == pytest.approx(5 + (0.3 * q2 - 2 * abn + 40 * assume + 7 * occ) * u + 0.1 * staff)
        assert r.calls_per_fte == pytest.approx(calls * u / staff, abs=0.005)
        assert (r.q2, r.occupancy_pct) == (pytest.approx(q2 * u, abs=0.006), pytest.approx(100 * occ * u, abs=0.006))


def test_requirement_accuracy_by_brute_force(spark):
    rows, x, noise = _hist(3.0)
    y = 2 + 1e-3 * x[:, 1] + 0.5 * x[:, 2] + 30 * x[:, 6] + 10 * x[:, 4] + noise
    data = [(*r, float(v)) for r, v in zip(rows, y)] + [("a", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {(r.g, r.part): r for r in whatif.requirement_accuracy(spark.createDataFrame(data, SCHEMA), ["g"]).collect()}
    assert len(got) == 4
    for g, at in (("a", slice(0, 60)), ("b", slice(60, 120))):
        f = np.column_stack([np.ones(60), x[at][:, [1, 2, 6, 4]]])
        f[:, 1] -= f[:43, 1].mean()
        first = 43  # rows up to the date at position floor(0.7 * 60) = 42
        coef = np.linalg.lstsq(f[:first], y[at][:first], rcond=None)[0]
        for part, s in (("train", slice(0, first)), ("test", slice(first, 60))):
            true = y[at][s]
            e = true - f[s] @ coef
            r = got[g, part]
            assert (r.n_eval, r.mse, r.mae) == (len(e), pytest.approx((e * e).mean()), pytest.approx(np.abs(e).mean()))
            assert r.r2 == pytest.approx(1 - (e * e).sum() / ((true - true.mean()) ** 2).sum())


def test_fte_week_by_brute_force(spark):
    rows, x, noise = _hist(2.0)
    y = 5 + 0.001 * x[:, 1] - 0.3 * x[:, 2] + 9 * x[:, 6] + noise
    rows = [(*r, float(v)) for r, v in zip(rows, y) if r[1] != dt.date(2025, 1, 14)]
    hist = spark.createDataFrame(rows, SCHEMA)
    days = whatif.fte_week(hist, "2025-01-12", ["g"], [-10, 20])
    got = {(r.g, r.change, r.date): r for r in days.collect()}
    assert len(got) == 2 * 2 * 7
    totals = {(r.g, r.change): r for r in whatif.fte_week_totals(days, ["g"]).collect()}
    for g in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        f = np.array([[r[3], r[4], r[8], r[6]] for r in mine])
        n = int(0.7 * len(mine)) + 1
        b = np.linalg.lstsq(np.column_stack([np.ones(n), f[:n]]), np.array([r[9] for r in mine[:n]]), rcond=None)[0]
        week = [i for i, r in enumerate(mine) if dt.date(2025, 1, 12) <= r[1] <= dt.date(2025, 1, 18)]
        demand = {mine[i][1]: f[i, 0] for i in week}
        mean = f[week].mean(0)
        want = []
        for k in range(7):
            d = dt.date(2025, 1, 12) + dt.timedelta(k)
            want.append(b[0] + b[1] * demand.get(d, 0.0) * 1.2 + b[2:] @ mean[1:])
            assert got[g, 20.0, d].prediction == pytest.approx(want[-1], rel=1e-6)
        assert got[g, 20.0, dt.date(2025, 1, 14)].actual is None
        actual = np.mean([mine[i][9] for i in week])
        t = totals[g, 20.0]
        assert (t.weekly_predicted, t.change_pct) == (pytest.approx(sum(want)), pytest.approx((np.mean(want) / actual - 1) * 100))
