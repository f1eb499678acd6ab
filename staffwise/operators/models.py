"""Regression models per group (ML2-ML5, ML8, ML11, SCN9-SCN15).

One model per (language, req_media, usd, level) group, fitted from moments: a single partial
aggregation computes counts, means and covariances per group (map-side combine, so a hot group
costs no more than any other), and the small k x k systems of a batch of groups are solved together
with numpy in ``mapInPandas`` over the moments (one row per group). Scenario grids are joined
to the coefficients and predicted with column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffwise.operators import features as fe

GKEYS = ["language", "req_media", "usd", "level"]


def moments(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """Means and covariances per group, by the built-in streaming aggregates: unlike sums of squares
    they don't cancel where the mean is large against the spread. Rows with a NULL are dropped."""
    x = df.na.drop(subset=[*features, label])
    names = [*features, label]
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in names),
        *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[i:]))


#: Least eigenvalue of a correlation matrix that counts as regular, whatever the scale of the features.
REGULAR = 1e-10


def solve(m: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """Least squares per group from its moments -> intercept and coefficients.

    The system is that of the standardised features, so their magnitude does not matter. A feature
    that is constant in a group gets coefficient 0; collinear features give NULL coefficients.
    """
    k, names = len(features), ["intercept", *(f"b_{f}" for f in features)]
    kinds = dict(m.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "n double", *(f"{c} double" for c in names)])

    def fit(batches):
        for p in batches:  # one row per group, all groups of a batch at once
            mean = p[[f"m_{f}" for f in features]].to_numpy(float)
            cov = np.empty((len(p), k, k))
            for i, a in enumerate(features):
                for j, b in enumerate(features[i:], i):
                    cov[:, i, j] = cov[:, j, i] = p[f"c_{a}_{b}"]
            to_label = p[[f"c_{f}_{label}" for f in features]].to_numpy(float)
            spread = np.sqrt(np.einsum("gii->gi", cov))
            fixed = spread <= 1e-12 * np.maximum(np.abs(mean), 1e-300)
            scale = np.where(fixed, 1.0, spread)
            corr = cov / scale[:, :, None] / scale[:, None, :]
            corr = np.where(fixed[:, :, None] | fixed[:, None, :], np.eye(k), corr)
            right = np.where(fixed, 0.0, to_label / scale)
            regular = np.linalg.eigvalsh(corr)[:, 0] > REGULAR
            coef = np.full((len(p), k), np.nan)
            coef[regular] = np.linalg.solve(corr[regular], right[regular][:, :, None])[:, :, 0] / scale[regular]
            first = p[f"m_{label}"].to_numpy(float) - (coef * mean).sum(1)
            yield pd.concat([p[[*keys, "n"]].reset_index(drop=True),
                             pd.DataFrame(np.column_stack([first, coef]), columns=names)], axis=1)

    return m.mapInPandas(fit, schema)


def fit_ols(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    return solve(moments(df, keys, features, label), keys, features, label)


def predict(features: list[str]) -> Column:
    out = F.col("intercept")
    for f in features:
        out = out + F.col(f"b_{f}") * F.col(f)
    return out


def metrics(scored: DataFrame, keys: list[str], label: str, pred: str = "pred") -> DataFrame:
    """ML11: MAE, MSE and R2 per group in one aggregate; a label without spread has no R2."""
    e = F.col(label) - F.col(pred)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_eval"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(label))).alias("r2"))


def ols2_closed_form(x1: str, x2: str, y: str) -> list[Column]:
    """ML2: two-feature least squares by Cramer's rule on the covariances of ``moments`` (also written in SQL).
    Constant or collinear features have no solution: NULL."""
    def c(a, b):
        return F.col(f"c_{a}_{b}")
    det = c(x1, x1) * c(x2, x2) - c(x1, x2) * c(x1, x2)
    b1 = F.try_divide(c(x1, y) * c(x2, x2) - c(x2, y) * c(x1, x2), det)
    b2 = F.try_divide(c(x2, y) * c(x1, x1) - c(x1, y) * c(x1, x2), det)
    return [(F.col(f"m_{y}") - b1 * F.col(f"m_{x1}") - b2 * F.col(f"m_{x2}")).alias("intercept"),
            b1.alias(f"b_{x1}"), b2.alias(f"b_{x2}")]


def held_out_fit(hist: DataFrame, keys: list[str], features: list[str], label: str, row_keys: list[str]) -> DataFrame:
    """ML2, ML3 + ML11: least squares per group on the 80 % of its rows that their hash deals to training, with
    the rows, MAE and R2 of the other part. Rows with a missing feature or label are left out."""
    rows = fe.hash_split(hist.na.drop(subset=[*features, label]).select(*dict.fromkeys([*keys, *row_keys, *features, label])), row_keys)
    coef = fit_ols(rows.where("part = 'train'"), keys, features, label)
    test = rows.where("part = 'test'").join(coef, keys).withColumn("pred", predict(features))
    return coef.join(metrics(test, keys, label).drop("mse"), keys, "left")


@dataclass
class Scaled:
    """ML4 + ML8: a scaler (means and population deviations per group) and a model of the scaled features."""
    scaler: DataFrame
    model: DataFrame

    @staticmethod
    def fit(train: DataFrame, keys: list[str], features: list[str], label: str) -> "Scaled":
        rows = train.na.drop(subset=[*features, label])
        scaler = rows.groupBy(*keys).agg(*(F.avg(f).alias(f"mean_{f}") for f in features),
                                         *(F.stddev_pop(f).alias(f"std_{f}") for f in features))
        return Scaled(scaler, fit_ols(scale(rows, scaler, keys, features), keys, features, label))

    def predict(self, rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
        """``rows`` with ``pred``; the features themselves stay as they are."""
        z = [scaled(f) * F.col(f"b_{f}") for f in features]
        return rows.join(self.scaler, keys).join(self.model, keys).withColumn(
            "pred", reduce(lambda a, b: a + b, z, F.col("intercept"))).select(*rows.columns, "pred")


def scaled(f: str) -> Column:
    """(x - mean) / deviation; a feature without spread is 0, as scalers leave it."""
    return F.coalesce(F.try_divide(F.col(f) - F.col(f"mean_{f}"), F.col(f"std_{f}")), F.lit(0.0))


def scale(rows: DataFrame, scaler: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """ML8: ``rows`` with their features scaled by their group's scaler."""
    return rows.join(scaler, keys).withColumns({f: scaled(f) for f in features}).select(rows.columns)
