import datetime as dt
import hashlib

import numpy as np
import pytest

from staffwise.operators import lasso

KEYS = ["g"]
SCHEMA = "g string, date date, demand double, " + ", ".join(f"{f} double" for f in lasso.FEATURES) + ", requirement double"


def _data():
    rng = np.random.default_rng(8)
    rows = []
    for g in ("a", "b"):
        for i in range(83):
            x = [rng.uniform(5, 40), rng.uniform(0, 6), rng.uniform(0.6, 0.9), rng.uniform(300, 500), rng.uniform(9e3, 1.2e4),
                 0.75 if g == "b" else rng.uniform(0.5, 0.9)]  # constant in one group
            y = 3 + 0.4 * x[0] - 2 * x[1] + 0.05 * x[3] + 0.03 * x[4] + rng.normal(0, 4)
            rows.append((g, dt.date(2025, 1, 1) + dt.timedelta(i), 1e5, *map(float, x), float(y)))
    return rows


def _plain(x, y, alpha=0.1):
    """Coordinate descent on the rows themselves."""
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            z = xc[:, j] @ xc[:, j] / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / z if z > 1e-18 else 0
    return w, y.mean() - x.mean(0) @ w


def _r2(w, b, x, y):
    return 1 - ((y - x @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_lasso_equals_coordinate_descent(spark):
    rows = _data()
    hist = spark.createDataFrame([*rows, ("a", dt.date(2026, 1, 1), None, *[1.0] * 7), ("c", dt.date(2025, 1, 1), *[1.0] * 8)], SCHEMA)
    model = lasso.fit_lasso(hist, KEYS)
    got = {r.g: r for r in model.collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].cv_mean is None
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        x, y = np.array([r[3:9] for r in mine]), np.array([r[9] for r in mine])
        train = np.array([int(hashlib.md5(f"{g}|{r[1]}".encode()).hexdigest()[:8], 16) % 5 > 0 for r in mine])
        w, b = _plain(x[train], y[train])
        r = got[g]
        assert [r[f"b_{f}"] for f in lasso.FEATURES] == pytest.approx(list(w), rel=1e-5, abs=1e-7)
        assert r.intercept == pytest.approx(b, rel=1e-5) and r.n_rows == len(y)
        assert r.r2_train == pytest.approx(_r2(w, b, x[train], y[train]), abs=1e-6)
        assert r.r2_test == pytest.approx(_r2(w, b, x[~train], y[~train]), abs=1e-6)
        assert r.mae == pytest.approx(np.abs(y - x @ w - b)[~train].mean(), rel=1e-5)
        scores = []
        for part in np.array_split(np.arange(len(y)), 5):
            rest = np.setdiff1d(np.arange(len(y)), part)
            scores.append(_r2(*_plain(x[rest], y[rest]), x[part], y[part]))
        assert (r.cv_mean, r.cv_std) == (pytest.approx(np.mean(scores), abs=1e-6), pytest.approx(np.std(scores), abs=1e-6))
    effect = {(r.g, r.change): r for r in lasso.demand_effect(hist, model, KEYS).collect()}
    r, m = effect["a", 25], got["a"]
    mid = np.median(np.array([q[3:9] for q in rows if q[0] == "a"]), axis=0) * [1, 1, 1, 1, 1.25, 1]
    assert r.prediction == pytest.approx(m.intercept + sum(m[f"b_{f}"] * v for f, v in zip(lasso.FEATURES, mid)))
    assert r.lowest_service_level == 0.8 and len(effect) == 15
