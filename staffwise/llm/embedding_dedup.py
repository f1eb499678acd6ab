"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors link at cosine c, that is at squared distance D = 2 - 2c or less. A fixed random
rotation spreads the variance evenly, and the rotated coordinates are split into blocks. If a pair is
within D, then in at least one block its squared distance is within D times the block's share of the
coordinates, so a range join of each block under that budget misses no pair. The range join uses a
grid over the block's leading coordinates whose cells are two budget radii wide: a vector goes to its
own cell and, if its ball reaches over a border, to the neighbours above its own in the order of
cells, so that a pair of different cells meets exactly once.

A cell is cut into chunks of bounded size and each pair of chunks is one unit of work, so that a cell
with a third of all vectors is many tasks of bounded memory. A unit finds the pairs within the
block's budget, drops those that an earlier block finds as well, checks the rest by the exact cosine,
and returns the number of links of each vector and links that connect its rows; pairs are not
written out. Equal vectors are merged beforehand and counted by their number.

Distances within blocks are taken on rotated coordinates rounded to a fixed grid, so their sums are
exact whatever the order, every unit decides alike which block finds a pair first, and a small margin
in the budget makes up for the rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

BLOCK = 8  # coordinates in a block
GRID = 2  # leading coordinates of a block that make the grid
CHUNK = 1024  # vectors in a chunk of a cell
SCALE = float(1 << 20)  # rotated coordinates are rounded to 1 / SCALE
MARGIN = 1e-4  # added to budgets, far above what rounding can do
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation of ``dim`` coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rounded rotated coordinates, summed in a fixed order so that a row's result is its own."""
    out = np.zeros((len(x), turn.shape[1]))
    for j in range(turn.shape[0]):
        out += x[:, j:j + 1] * turn[j]
    return np.rint(out * SCALE)


def blocks(dim: int) -> list[slice]:
    return [slice(i, min(dim, i + BLOCK)) for i in range(0, dim, BLOCK)]


def budgets(dim: int, threshold: float) -> np.ndarray:
    """Squared-distance budget of each block in units of the rounded coordinates."""
    share = np.array([(b.stop - b.start) / dim for b in blocks(dim)])
    return (2 - 2 * threshold) * share * SCALE ** 2 * (1 + MARGIN) + MARGIN * SCALE


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of whole-numbered rows; exact below 2^53."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def cells(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Cells of every vector in every block: its home and the neighbours above that its ball reaches."""
    for batch in batches:
        reps, vecs, labels = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        off = vecs.offsets.to_numpy()
        lengths, flat = np.diff(off), vecs.values.to_numpy()
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            z = rotated(unit(np.stack([flat[off[r]:off[r + 1]] for r in rows]).astype(float)), rotation(dim))
            for k, (part, budget) in enumerate(zip(blocks(dim), budgets(dim, threshold))):
                lead = z[:, part][:, :GRID]
                radius = np.sqrt(budget)
                home = np.floor(lead / (2 * radius)).astype(np.int64)
                for step in product((-1, 0, 1), repeat=lead.shape[1]):
                    if step < (0,) * len(step):
                        continue
                    near = home + np.array(step)
                    gap = np.where(np.array(step) > 0, near * 2 * radius - lead,
                                   np.where(np.array(step) < 0, lead - home * 2 * radius, 0.0))
                    at = np.flatnonzero((np.maximum(gap, 0) ** 2).sum(1) <= budget)
                    if not len(at):
                        continue
                    cell = (near[at, 0] + (1 << 20)) * (1 << 21) + (near[at, 1] + (1 << 20) if lead.shape[1] > 1 else 0)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(reps[rows[at]]), labels.take(pa.array(rows[at])), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), k, np.int32)),
                        pa.array(cell), pa.array(np.full(len(at), step == (0,) * len(step)))], ["rep", "label", "dim", "block", "cell", "home"])


def unit_links(x: pd.DataFrame, block: int, dim: int, threshold: float, same: bool) -> pd.DataFrame:
    """Links between the rows of chunk 0 and chunk 1 of ``x`` (or inside chunk 0 if ``same``)."""
    v = np.stack(x["v"].to_numpy()).astype(float)
    home, mult, rep = x["home"].to_numpy(), x["mult"].to_numpy(), x["rep"].to_numpy()
    first = x["side"].to_numpy() == 0
    a, b = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
    none = pd.DataFrame({"rep": np.empty(0, np.int64), "links": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
    if not len(a) or not len(b):
        return none
    u = unit(v)
    z, budget, parts = rotated(u, rotation(dim)), budgets(dim, threshold), blocks(dim)
    near = (squared(z[a][:, parts[block]], z[b][:, parts[block]]) <= budget[block]) & (home[a][:, None] | home[b][None, :])
    if same:
        near &= a[:, None] != b[None, :]
    for k in range(block):
        if not near.any():
            return none
        near &= squared(z[a][:, parts[k]], z[b][:, parts[k]]) > budget[k]
    if not near.any():
        return none
    near &= u[a] @ u[b].T >= threshold
    if not near.any():
        return none
    links = np.zeros(len(x), np.int64)
    links[a] += near @ mult[b]
    if not same:
        links[b] += mult[a] @ near
    # the smallest row that each row reaches inside this unit
    label, big = rep.copy(), np.iinfo(np.int64).max
    while True:
        old = label.copy()
        label[a] = np.minimum(label[a], np.where(near, label[b][None, :], big).min(1))
        label[b] = np.minimum(label[b], np.where(near, label[a][:, None], big).min(0))
        if (label == old).all():
            break
    on = links > 0
    return pd.DataFrame({"rep": rep[on], "links": links[on], "to": label[on]})


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per input row.

    Only vectors of the same non-null label and length are compared. Null, empty and zero vectors and
    those with null or non-finite components link with nothing and are their own component; rows with
    a null id too, with a null component, never kept. Rows that repeat an id are one node of the
    graph; each row counts its own links, all other rows that link to it included.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    wide = rows.withColumn("d", F.col("v").cast("array<double>"))
    fine = (F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)
            & F.forall("d", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
            & F.exists("d", lambda c: c != 0))
    linkable = wide.where(F.coalesce(fine, F.lit(False))).select("id", "v", "label", F.xxhash64("v").alias("h"))
    # one class per label and vector; its name is its smallest id
    classes, _ = stored(linkable.groupBy("label", "h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
                        .select(F.xxhash64("label", "h", "rep").alias("node"), "rep", "label", "v", "mult"), "vectors")
    # an id may be in several classes; every class has one row with a name of its own
    named = classes.withColumn("rep_name", F.col("node"))
    slim = named.select(F.col("rep_name").alias("rep"), F.col("v").cast("array<double>").alias("v"), "label")
    dealt, _ = stored(slim.mapInArrow(
        lambda b: cells(b, threshold), f"rep long, label {slim.schema['label'].dataType.simpleString()}, "
        "dim int, block int, cell long, home boolean"), "cells")
    key = ["label", "dim", "block", "cell"]
    sizes = dealt.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"),
                                    F.max("home").alias("any_home"), F.count("*").alias("m")).where("any_home AND m > 1")
    chunk = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n")).cast("int")
    units = (dealt.join(sizes.select(*key, "n"), key).withColumn("own", chunk)
             .select("rep", *key, "home", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
             .select("rep", *key, "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")))
    full = units.join(named.select(F.col("rep_name").alias("rep"), F.col("v"), "mult"), "rep")

    def work(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        _, dim, block, _, i, j = key
        return unit_links(x, block, dim, threshold, i == j)

    linked, _ = stored(full.groupBy(*key, "i", "j").applyInPandas(work, "rep long, links long, to long"), "links")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = named.join(links.withColumnRenamed("rep", "rep_name"), "rep_name", "left").select(
        F.col("rep_name").alias("node"), "label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    member = linkable.groupBy("id", "label", "h", "v").agg(F.count("*").alias("copies")).join(
        per_class.withColumn("h", F.xxhash64("v")), ["label", "h", "v"])
    # graph over ids: each class is tied to its smallest id, classes are tied by links
    name_to_id = named.select(F.col("rep_name").alias("to"), F.col("rep").alias("to_id"))
    edges = (linked.join(named.select(F.col("rep_name").alias("rep"), F.col("rep").alias("a")), "rep")
             .join(name_to_id, "to").select("a", F.col("to_id").alias("b"))
             .unionAll(member.join(named.select(F.col("rep_name").alias("node"), F.col("rep").alias("b")), "node")
                       .select(F.col("id").alias("a"), "b")))
    comp = components(edges)
    per_row = member.select(F.col("id").alias("m_id"), F.col("label").alias("m_label"), F.col("v").alias("m_v"), "n_links")
    out = (wide.withColumn("h", F.xxhash64("v"))
           .join(per_row.withColumn("m_h", F.xxhash64("m_v")),
                 (F.col("id") == F.col("m_id")) & (F.col("label") == F.col("m_label")) & (F.col("h") == F.col("m_h"))
                 & (F.col("v") == F.col("m_v")), "left")
           .join(comp, F.col("id") == F.col("node"), "left"))
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
