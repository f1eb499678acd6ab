"""Whitening of embeddings: principal components of a distributed covariance, unit variance along each.

Three passes over the vectors: sums per dimension (whole numbers, so exact), the covariance with
every entry centred before it is multiplied, and the projection. Each task sums its own rows and
hands on one partial row per dimension pair; Spark adds them up. Only the covariance, whose size is
the square of the dimension whatever the number of rows, reaches the driver, where it is brought to
tridiagonal form by Householder reflections; its leading eigenvalues are found by bisection on the
Sturm count, their vectors by inverse iteration, made orthogonal again within clusters of close
eigenvalues. The projection matrix (dimension x components) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored

SCALE, OFFSET = 1024, 100_000
EPS = np.finfo(float).eps
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are made orthogonal to each other


# ---------------------------------------------------------------- eigenvectors of one small matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diag, off, q)`` with ``q @ T @ q.T = a``: Householder reflections of a symmetric matrix."""
    a = np.array(a, dtype=float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        rest = np.abs(x[1:]).max()
        if rest == 0:
            continue
        top = max(abs(x[0]), rest)
        x /= top
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        sub = a[k + 1:, k + 1:]
        p = sub @ v
        w = p - v * (v @ p)
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        new = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = new
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_count(diag: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are below ``x``: negative pivots of ``T - x``."""
    least = EPS * max(1e-300, np.abs(diag).max(), np.abs(off).max(initial=0))
    count, pivot = 0, 1.0
    for i, d in enumerate(diag):
        pivot = d - x - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot < 0
    return count


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval can't be halved."""
    n = len(diag)
    around = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = (diag - around).min(), (diag + around).max()
    width = max(high - low, abs(low), abs(high)) * EPS * n
    out = []
    for i in range(k):
        a, b = low - width, high + width
        while True:
            mid = a + (b - a) / 2
            if mid <= a or mid >= b:
                break
            if n - sturm_count(diag, off, mid) > i:
                a = mid
            else:
                b = mid
        out.append(b)
    return np.array(out)


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; a vanishing pivot becomes ``least``."""
    n = len(diag)
    u = diag - shift
    u1, u2, x = np.append(off, 0.0), np.zeros(n), b.copy()
    below = off.copy()
    for i in range(n - 1):
        if abs(below[i]) > abs(u[i]):  # exchange rows i and i + 1
            u[i], below[i] = below[i], u[i]
            u1[i], u[i + 1] = u[i + 1], u1[i]
            u2[i], u1[i + 1] = u1[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if u[i] == 0:
            u[i] = least
        m = below[i] / u[i]
        u[i + 1] -= m * u1[i]
        u1[i + 1] -= m * u2[i]
        x[i + 1] -= m * x[i]
    if abs(u[-1]) < least:
        u[-1] = least
    for i in range(n - 1, -1, -1):
        s = x[i]
        if i + 1 < n:
            s -= u1[i] * x[i + 1]
        if i + 2 < n:
            s -= u2[i] * x[i + 2]
        x[i] = s / (u[i] if abs(u[i]) >= least else np.copysign(least, u[i]))
    return x


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for its leading eigenvalues."""
    n = len(diag)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0), 1e-300)
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    first = 0  # of the present cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        x = rng.standard_normal(n)
        for _ in range(8):
            x = solve_shifted(diag, off, value, x / np.linalg.norm(x), EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
                if np.linalg.norm(x) < 1e-8:
                    x = rng.standard_normal(n)
                x /= np.linalg.norm(x)
            t = diag * x
            t[:-1] += off * x[1:]
            t[1:] += off * x[:-1]
            if np.linalg.norm(t - value * x) <= 4 * EPS * norm:
                break
        out[:, j] = x
    return out


def principal_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of up to ``k`` leading eigenvalues that differ from zero in double precision."""
    diag, off, q = tridiagonal(cov)
    values = leading_eigenvalues(diag, off, min(k, len(cov)))
    values = values[values > 4 * EPS * len(cov) * max(values.max(initial=0), 0)]
    return values, q @ inverse_iteration(diag, off, values)


# ---------------------------------------------------------------- passes over the vectors

def _whole(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``(kept, x)``: the rows without missing, null or non-finite entries, and their whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=0).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(lengths)
    kept = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    sizes = np.unique(lengths[kept])
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths have no covariance")
    if not len(sizes):
        return kept, np.zeros((0, 0), dtype=np.int64)
    wide = np.floor(flat[np.repeat(kept, lengths)] * SCALE)
    if np.abs(wide).max() >= 2.0 ** 53:
        raise ValueError("an entry is too large for its whole number to be exact")
    return kept, wide.astype(np.int64).reshape(-1, sizes[0]) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, dim = 0, None, 0
    for batch in batches:
        _, x = _whole(batch.column(0))
        if len(x):
            if dim and x.shape[1] != dim:
                raise ValueError("vectors of different lengths have no covariance")
            dim, n = x.shape[1], n + len(x)
            # whole numbers of any size: the high and the low 32 bits are added apart
            part = [int(h) * 2 ** 32 + int(w) for h, w in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            total = part if total is None else [a + b for a, b in zip(total, part)]
    if n:
        yield pa.RecordBatch.from_pydict({"i": list(range(dim)), "n": [n] * dim, "s": [str(v) for v in total]},
                                         schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``: the whole part of the mean is taken off exactly, then the fraction."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    return (x - whole) - fraction


def _covariance(vectors: DataFrame, centred) -> np.ndarray | None:
    """Divisor-free covariance sums of the batches that ``centred`` makes of ``vectors``; Spark adds the tasks' parts."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = centred(batch)
            if len(z):
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(total[i, j])], names=["i", "j", "v"])

    rows = vectors.mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(rows):
        return None
    d = int(rows["j"].max()) + 1
    out = np.zeros((d, d))
    out[rows["i"], rows["j"]] = rows["v"]
    out[rows["j"], rows["i"]] = rows["v"]
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """``sum((n x - S)^2)`` of each row, exact at any size."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    apart = np.abs(x - whole).max(initial=0) + 1
    if n * int(apart) < 2 ** 31 and (n * int(apart)) ** 2 * x.shape[1] < 2 ** 63:
        rest = np.array([s % n for s in sums], dtype=np.int64)
        return ((n * (x - whole) - rest) ** 2).sum(axis=1).tolist()
    # sum(n^2 u^2 - 2 n u r + r^2) with u = x - whole, r = S mod n: u is small, so its sums are
    u, rest = (x - whole).astype(object), [s % n for s in sums]
    square = sum(r * r for r in rest)
    return [n * n * int((row * row).sum()) - 2 * n * sum(a * b for a, b in zip(row, rest)) + square for row in u]


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n, deviation, whitened, explained, identity_error``: one row per usable vector.

    ``whitened`` and ``explained`` are arrays, leading component first. Vectors that are null, empty
    or hold null or non-finite entries are dropped; null and repeated ids and repeated vectors are
    rows like any other. Components whose eigenvalue is zero in double precision (constant or
    dependent dimensions, a single vector) have no whitened direction and are left out, so the arrays
    may be shorter than ``components`` or empty. No usable vector gives no row. Vectors of different
    lengths are an error, as are entries of 2^43 or more, whose whole numbers a double can't hold.
    ``deviation`` is a whole number of up to 38 digits. Other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    bounded_batches(spark)
    schema = "id {}, n bigint, deviation decimal(38,0), whitened array<double>".format(
        vectors.schema[id_col].dataType.simpleString())
    only = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    totals = (only.mapInArrow(_sums, "i int, n bigint, s string")
              .groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect())
    full = schema + ", explained array<double>, identity_error double"
    if not totals:
        return spark.createDataFrame([], full)
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    if any(r["n"] != n for r in totals):
        raise ValueError("vectors of different lengths have no covariance")
    cov = _covariance(only, lambda batch: _centred(_whole(batch.column(0))[1], n, sums) if batch.num_rows else []) / n
    values, axes = principal_components(cov, components)
    trace = float(np.trace(cov))
    shared = spark.sparkContext.broadcast((n, sums, axes / np.sqrt(values)))  # dimension x components doubles

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, matrix = shared.value
        for batch in batches:
            kept, x = _whole(batch.column(1))
            if not len(x):
                continue
            y = _centred(x, n, sums) @ matrix
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(kept)), pa.array(np.full(len(y), n)),
                 pa.array([str(v) for v in _deviation(x, n, sums)]), flat], names=["id", "n", "deviation", "whitened"])

    rows, _ = stored(
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .mapInArrow(project, schema.replace("decimal(38,0)", "string"))
        .withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), "whitened")

    def entries(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(values))

    error = 0.0
    if len(values):
        means = np.array(rows.select(*(F.avg(F.col("whitened")[k]) for k in range(len(values)))).first())
        white = _covariance(rows.select("whitened"), lambda batch: entries(batch) - means) / n
        error = float(np.abs(white - np.eye(len(values))).max())
    return rows.withColumns({"explained": F.array(*(F.lit(float(v) / trace) for v in values)).cast("array<double>"),
                             "identity_error": F.lit(error)})
