"""SimHash near-dedup: byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints at Hamming distance d share at
least T = 8 - d of them. A posting list holds the fingerprints with one value at one byte position. Of
d + 1 positions a pair of tally T or more shares at least one, so the first d + 1 positions are indexed.
Inside a list the bytes that each pair shares are tallied, pairs that reach T are kept and their bits
compared.

A list of more than ``LIST`` fingerprints is split by the value of a further position: its pairs share at
least T - 1 of the remaining positions, so again only the next ones, d skipped in all, are needed. Lists
are split until they are short or T positions deep, where only d bytes are free and at most 256^d
distinct fingerprints (65,536 at d = 2) can share a list, whatever the corpus holds; these are compared
by one look-up per row and bit mask, not by pairs. In a large corpus the first lists would all be split:
the index starts at the depth at which evenly spread fingerprints make lists of an eighth of ``LIST`` or
less, so that only uneven ones are split.

Exact copies are merged before the index (one row per fingerprint), and a list returns links that
connect its rows, not all pairs, so a group of thousands of copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidy
from .components import components

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLICE = 1 << 15  # shingles whose bits are counted at once
LIST = 1024  # fingerprints of a posting list whose pairs are tallied; longer lists are split


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text: bit set if it is set in over half of the shingle hashes; 0 for no words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        h = np.fromiter((digest(b" ".join(words[i:i + shingle]), SEED) for i in range(lo, hi)), "<u8", hi - lo)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` with fp as a signed long, one row per input row; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], ["id", "fp"])
        tidy()

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    """The bytes at some positions, as a signed long."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _free(fp: np.ndarray, positions: int) -> np.ndarray:
    """The bytes of fingerprints that are not among ``positions`` (a bit each), as one integer."""
    rest = np.zeros(len(fp), np.int64)
    for i, p in enumerate(p for p in range(8) if not positions >> p & 1):
        rest |= (fp >> (8 * p) & 0xFF) << (8 * i)
    return rest


def tally(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their difference (exclusive or, unsigned)."""
    low = np.uint64(0x0101010101010101)
    for shift in (4, 2, 1):
        x = x | (x >> np.uint64(shift))  # seven places in all: a byte's lowest bit becomes the union of its own bits
    return 8 - np.bitwise_count(x & low)


def _tallied(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of a short list: pairs by tally, then by bits, thinned to a forest."""
    u = fp.view("<u8")
    x = u[:, None] ^ u
    near = tally(x) >= 8 - max_bits
    near &= np.bitwise_count(x) <= max_bits
    np.fill_diagonal(near, False)
    left, a, b = near.any(1), [], []
    while left.any():
        front = np.array([left.argmax()])
        left[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(0) & left)
            a.append(front[near[np.ix_(front, new)].argmax(0)])
            b.append(new)
            left[new] = False
            front = new
    return np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])


def _looked_up(free: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of a list of full depth; ``free`` has their differing bytes as an integer."""
    order = np.argsort(free)
    free = free[order]
    a, b = [], []
    for m in masks:
        at = np.searchsorted(free, free ^ m)
        at[at == len(free)] = 0
        hit = np.flatnonzero((free[at] == free ^ m) & (free < free ^ m))
        a.append(order[hit])
        b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def posting_lists(classes: DataFrame, max_bits: int = 2, longest: int = LIST) -> DataFrame:
    """``(positions, held, fp, rep)``: the index. ``positions`` has a bit per byte position of a list, ``held`` the
    bytes there. No list is longer than ``longest`` unless it is of full depth."""
    least = 8 - max_bits
    spark = classes.sparkSession
    # the classes are few bytes but become several rows each: dealt evenly, whatever their files are
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.where("rep IS NOT NULL")
    total, depth = rows.count(), 1
    while depth < least and total >> (8 * depth) > longest // 8:
        depth += 1
    rows = rows.repartition(n, "fp").select("fp", "rep", F.lit(None).cast("int").alias("split"))
    short = []
    while True:
        keys = []
        for at in combinations(range(depth + max_bits), depth):
            bits = sum(1 << p for p in at)
            keys.append(F.struct(F.lit(bits).alias("positions"), F.col("fp").bitwiseAND(F.lit(_mask(at))).alias("held"),
                                 F.lit(bits - (1 << at[-1])).alias("parent")))
        wanted = F.filter(F.array(*keys), lambda x: F.col("split").isNull() | (F.col("split") == x["parent"]))
        index = rows.select("fp", "rep", F.explode(wanted).alias("x")).select("x.positions", "x.held", "fp", "rep")
        if depth == least:
            short.append(index)
            break
        long, _ = stored(index.groupBy("positions", "held").count().where(F.col("count") > longest).select("positions", "held"),
                         "simhash-long-lists")
        short.append(index.join(long, ["positions", "held"], "left_anti"))
        if not long.head(1):
            break
        split = index.join(long, ["positions", "held"], "left_semi").select("fp", "rep", F.col("positions").alias("split"))
        rows, _ = stored(split, "simhash-split")
        depth += 1
    out = short[0]
    for more in short[1:]:
        out = out.unionAll(more)
    return out


def near_links(classes: DataFrame, max_bits: int = 2, longest: int = LIST) -> DataFrame:
    """``(a, b)`` links between the ids of distinct fingerprints that differ in 1..max_bits bits: enough of
    them to connect all such fingerprints.

    ``classes`` has ``fp`` (distinct) and ``rep`` (its id), and is read several times. A linked pair may come more than once.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    if max_bits == 0:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    # the work of a list is the square of its few bytes: lists are dealt over all partitions
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (posting_lists(classes, max_bits, longest).repartition(n, "positions", "held").groupBy("positions", "held").agg(F.collect_list(F.struct("fp", "rep")).alias("rows"))
             .where(F.size("rows") > 1).select("positions", F.col("rows.fp").alias("fp"), F.col("rows.rep").alias("rep")))
    bits = 8 * max_bits
    masks = np.array([sum(1 << i for i in c) for n in range(1, max_bits + 1) for c in combinations(range(bits), n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            positions = batch.column(0).to_numpy()
            off, fps, reps = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
            two = np.flatnonzero(np.diff(off) == 2)  # lists of one pair: checked together
            x, y = off[two], off[two] + 1
            differ = (fps[x] ^ fps[y]).view("<u8")
            near = (tally(differ) >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
            a.append(reps[x[near]])
            b.append(reps[y[near]])
            for i in np.flatnonzero(np.diff(off) > 2):
                fp, rep = fps[off[i]:off[i + 1]], reps[off[i]:off[i + 1]]
                u, v = _tallied(fp, max_bits) if len(fp) <= longest else _looked_up(_free(fp, int(positions[i])), masks)
                a.append(rep[u])
                b.append(rep[v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 2) -> DataFrame:
    """``(id, fp, component)``, one row per input row: the smallest id reachable over links of at
    most ``max_bits`` differing bits.

    Null texts count as empty, texts without words have fingerprint zero and link like any other.
    Rows with a null id keep their fingerprint, link nothing and have a null component. Rows that
    repeat an id are one node of the graph, with all their fingerprints. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    fps, _ = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    return groups_of(fps, max_bits)


def groups_of(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``simhash_groups`` of known fingerprints (``id, fp``), a stored table: it is read several times."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    classes, _ = stored(classes, "simhash-classes")
    same_id = (fps.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
               .where("lo <> hi").select("id"))
    extra = (fps.join(same_id, "id", "left_semi").join(classes, "fp")
             .select(F.col("id").cast("long").alias("a"), F.col("rep").cast("long").alias("b")))
    comp = components(near_links(classes.select("fp", F.col("rep").cast("long")), max_bits).unionAll(extra))
    of_class = (classes.join(comp, classes.rep == comp.node, "left")
                .select("fp", F.coalesce("component", "rep").alias("component")))
    return (fps.join(of_class, "fp", "left")
            .select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")))
