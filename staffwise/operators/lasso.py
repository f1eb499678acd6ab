"""Lasso per group with five-fold accuracy (ML6, ML7, SCN17, SRT3, MTH4).

Lasso needs of the data only its means and covariances, and those of several parts combine exactly. One
partial aggregation gives the moments of every (group, fold, split part), a handful of rows per group;
the fits and the R2 of folds and parts are small sums over them. Only the mean absolute error goes
over the rows again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffwise.constants import CV_FOLDS, LASSO_ALPHA
from staffwise.operators import features as fe
from staffwise.operators import models as mo

FEATURES = ["q2", "abn_pct", "occ_assumption", "staffing", "calls", "occupancy_rate"]
LABEL = "requirement"
SERVICE_LEVELS = (0.80, 0.99, 20)  # first, last, number
DEMAND_CHANGES = [5, 10, 15, 20, 25]
SWEEPS = 1000  # of coordinate descent at most


def combine(n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and population covariance of the union of parts."""
    total = n.sum()
    if not total:
        return 0.0, np.zeros(mean.shape[1]), np.zeros(cov.shape[1:])
    middle = (n[:, None] * mean).sum(0) / total
    away = mean - middle
    return total, middle, (n[:, None, None] * (cov + away[:, :, None] * away[:, None, :])).sum(0) / total


def descend(cov: np.ndarray, to_label: np.ndarray, alpha: float) -> np.ndarray:
    """Coordinate descent on w'Cw/2 - w'c + alpha |w|; a constant feature gets coefficient 0."""
    w, spread = np.zeros(len(to_label)), np.sqrt(np.diag(cov))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in np.flatnonzero(spread > 0):
            rest = to_label[j] - cov[j] @ w + cov[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / cov[j, j]
            moved, w[j] = max(moved, abs(new - w[j]) * spread[j]), new
        if moved <= 1e-12 * max(1.0, np.abs(w * spread).max(initial=0.0)):
            break
    return w


def r2(w: np.ndarray, first: float, mean: np.ndarray, cov: np.ndarray) -> float:
    """R2 of a linear model on rows with these moments; the label is the last column. No spread: NaN."""
    if not cov[-1, -1] > 0:
        return float("nan")
    error = cov[-1, -1] - 2 * w @ cov[:-1, -1] + w @ cov[:-1, :-1] @ w + (mean[-1] - first - w @ mean[:-1]) ** 2
    return float(1 - error / cov[-1, -1])


def fit_lasso(hist: DataFrame, keys: list[str], alpha: float = LASSO_ALPHA) -> DataFrame:
    """ML6 + ML7, one row per group: coefficients of the train part (80 % by hash), R2 of both parts, MAE
    of the test part, mean and population deviation of the R2 of five contiguous folds in date order.

    Rows without requirement, staffing or demand are dropped, other missing values are 0. What has no
    rows or no spread gives NULL.
    """
    rows = hist.na.drop(subset=[LABEL, "staffing", "demand"]).na.fill(0.0, subset=FEATURES)
    parts = fe.hash_split(fe.folds(rows.select(*keys, "date", *FEATURES, LABEL), keys, CV_FOLDS), [*keys, "date"])
    m = mo.moments(parts, [*keys, "fold", "part"], FEATURES, LABEL)
    names = [*FEATURES, LABEL]
    kinds = dict(m.dtypes)
    numbers = ["intercept", *(f"b_{f}" for f in FEATURES), "r2_train", "r2_test", "cv_mean", "cv_std"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_rows long", "equation string", *(f"{c} double" for c in numbers)])

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        """One group: at most a row per fold and part."""
        n, mean = p["n"].to_numpy(float), p[[f"m_{a}" for a in names]].to_numpy(float)
        cov = np.empty((len(p), len(names), len(names)))
        for i, a in enumerate(names):
            for j, b in enumerate(names[i:], i):
                cov[:, i, j] = cov[:, j, i] = p[f"c_{a}_{b}"]

        def model(pick: np.ndarray) -> tuple[np.ndarray, float]:
            _, mid, c = combine(n[pick], mean[pick], cov[pick])
            w = descend(c[:-1, :-1], c[:-1, -1], alpha)
            return w, float(mid[-1] - w @ mid[:-1])

        def score(fitted: tuple[np.ndarray, float], pick: np.ndarray) -> float:
            return r2(*fitted, *combine(n[pick], mean[pick], cov[pick])[1:])

        train, fold = (p["part"] == "train").to_numpy(), p["fold"].to_numpy()
        w, first = main = model(train) if train.any() else (np.full(len(FEATURES), np.nan), np.nan)
        cv = [score(model(fold != k), fold == k) for k in np.unique(fold)] if len(np.unique(fold)) == CV_FOLDS else [np.nan]
        equation = "Requirement = " + " + ".join(f"{c:.4f} * {f}" for c, f in zip(w, FEATURES)) + f" + {first:.4f}"
        values = [first, *w, score(main, train), score(main, ~train), np.mean(cv), np.std(cv)]
        return pd.DataFrame([[*p.iloc[0][keys], int(n.sum()), equation, *values]],
                            columns=[*keys, "n_rows", "equation", *numbers])

    fitted = m.groupBy(*keys).applyInPandas(fit, schema).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in numbers})
    test = parts.where("part = 'test'").join(fitted.select(*keys, "intercept", *(f"b_{f}" for f in FEATURES)), keys)
    mae = test.groupBy(*keys).agg(F.avg(F.abs(F.col(LABEL) - mo.predict(FEATURES))).alias("mae"))
    return fitted.join(mae, keys, "left")


def demand_effect(hist: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """SCN17 + SRT3: requirement at the group's medians with calls raised by 5..25 %, and the service level
    whose prediction is nearest the median requirement.

    No feature of the model is a service level, so all levels predict the same and the lowest one wins
    the tie; the distance says how near the prediction is.
    """
    rows = hist.na.drop(subset=[LABEL, "staffing", "demand"]).na.fill(0.0, subset=FEATURES)
    middle = rows.groupBy(*keys).agg(*(F.median(f).alias(f) for f in FEATURES), F.median(LABEL).alias("median_requirement"))
    at = middle.join(model.select(*keys, "intercept", *(f"b_{f}" for f in FEATURES)), keys)
    lo, hi, count = SERVICE_LEVELS
    levels = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(lo) + i * F.lit((hi - lo) / (count - 1)))
    distance = F.abs(mo.predict(FEATURES) - F.col("median_requirement"))
    nearest = F.array_min(F.transform(levels, lambda s: F.struct(distance.alias("distance"), s.alias("level"))))
    at = at.withColumn("nearest", nearest)
    moved = at.select("*", F.explode(F.array(*map(F.lit, DEMAND_CHANGES))).alias("change")).withColumn(
        "calls", F.col("calls") * (1 + F.col("change") / 100.0))
    return moved.select(*keys, "change", "calls", mo.predict(FEATURES).alias("prediction"), "median_requirement",
                        F.col("nearest.level").alias("lowest_service_level"), F.col("nearest.distance").alias("distance"))
