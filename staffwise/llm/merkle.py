"""Merkle manifest of a dataset with incremental witnesses, as appends of blocks.

A leaf's witness is the list of siblings that lead from it to the root. Nodes are appended to a
stream of open subtrees (``Appender``): a new node starts with an empty witness, and each time that a
run of siblings is complete, the partial witnesses of all leaves below it are extended by that run's
other members. Streams are aligned: the leaves of a group, in order, are cut into blocks of
``ARITY ** LEVELS``, blocks are appended in parallel, and the root of a block is a further append to
the tree of block roots, whose witness then extends those of all leaves of the block. The same is
done for the groups' roots. A hot group is thereby many blocks, and no task holds more than a block.

Positions come from a sort by range over all partitions, counts per partition and group, and their
running sums. Digests are lower-case hex SHA-256 of the concatenated inputs, children as hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored

ARITY = 16
LEVELS = 2
BLOCK = ARITY ** LEVELS
STEP = "array<struct<left:string,right:string>>"
STEP_TYPE = pa.struct([("left", pa.string()), ("right", pa.string())])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """A stream of nodes in order, with the open run of each level and the witnesses of all leaves."""

    def __init__(self, arity: int = ARITY, witnesses: bool = True):
        self.arity, self.keep = arity, witnesses
        self.open: list[list[tuple[str, int]]] = [[]]  # per level: (digest, end of its leaves)
        self.closed = [0]                               # per level: nodes in complete runs
        self.leaves = 0
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        self.leaves += 1
        if self.keep:
            self.witnesses.append([])
        self._add(0, digest, self.leaves)

    def _add(self, level: int, digest: str, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
            self.closed.append(0)
        self.open[level].append((digest, end))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Close the open run: extend the witnesses below it, hand its digest to the next level."""
        run, self.open[level] = self.open[level], []
        self.closed[level] += len(run)
        text = "".join(d for d, _ in run)
        if self.keep:
            width = self.arity ** level
            start = (run[0][1] - 1) // width * width  # streams are aligned, so are their subtrees
            for i, (_, end) in enumerate(run):
                step = (text[:64 * i], text[64 * (i + 1):])
                for leaf in range(start, end):
                    self.witnesses[leaf].append(step)
                start = end
        self._add(level + 1, sha256(text), run[-1][1])

    def finish(self, levels: int | None = None) -> str:
        """Close what is open: up to a single node, or to exactly ``levels`` levels above the leaves."""
        level = 0
        while True:
            total = self.closed[level] + len(self.open[level])
            if level == levels or (levels is None and total == 1):
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:``, the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings(witness: Column) -> Column:
    """All siblings of a witness as one text, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "")


def positions(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``pos`` (from 0, by ``order``, nulls first) and ``total`` within ``group`` (a null group is one).

    One sort by range over all partitions; rows that are equal in ``order`` are taken in scan order,
    so neither a hot group nor many equal rows fall into one task. Also the folders to forget later.
    """
    tied = rows.withColumn("_scan", F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_scan").asc()]
    sort, sort_path = stored(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_scan")
                             .withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33).alias("_part")
    # one row per partition and group: their running sums are as small as the number of partitions
    counts, count_path = stored(sort.groupBy(F.col(group).alias("_group"), part).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "merkle-counts")
    w = Window.partitionBy("_group")
    starts = counts.select("_group", "_part", F.sum("_n").over(w).alias("total"), (
        F.sum("_n").over(w.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    out = sort.withColumn("_part2", part).join(
        starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part2") == F.col("_part")))
    return (out.withColumn("pos", F.col("_at") + F.col("_shift"))
            .select(*(c for c in rows.columns), "pos", "total")), [sort_path, count_path]


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = []
        for digests, total in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            stream = Appender(witnesses=False)
            for digest in digests:
                stream.append(digest)
            roots.append(stream.finish(None if total <= BLOCK else LEVELS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(roots, pa.string())],
                                         names=["grp", "block", "total", "digest"])


def _leaf_witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per member of each block: its digests are appended again, now with witnesses, and the
    block's own witness extends them all."""
    names = ["grp", "pos", "member", "witness", "subroot", "root"]
    for batch in batches:
        group, block, members, total, upper, sub, root = (batch.column(i) for i in range(7))
        for k in range(batch.num_rows):
            nodes = pa.array(members[k:k + 1].flatten())
            stream = Appender()
            for digest in nodes.field("digest").to_pylist():
                stream.append(digest)
            top = stream.finish(None if total[k].as_py() <= BLOCK else LEVELS)
            above = [(s["left"], s["right"]) for s in upper[k].as_py()] if upper[k].is_valid else []
            left, right, ends = [], [], [0]
            for witness in stream.witnesses:
                for a, b in [*witness, *above]:
                    left.append(a)
                    right.append(b)
                ends.append(len(left))
            steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(STEP_TYPE)))
            n, first = len(nodes), block[k].as_py() * BLOCK
            # without anything above it, a block is a whole tree: its root is that of the group, or of all
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[k].as_py()] * n, group.type), pa.array(range(first, first + n), pa.int64()), nodes, steps,
                 pa.array([sub[k].as_py() or top] * n, pa.string()), pa.array([root[k].as_py() or top] * n, pa.string())],
                names=names)


class Forest:
    """The trees of all groups of ``nodes`` (``grp, pos, total, member`` with a ``digest``), tier by tier."""

    def __init__(self, nodes: DataFrame):
        self.tiers: list[tuple[DataFrame, DataFrame]] = []  # (blocks with their members, their roots)
        self.paths: list[str] = []
        while True:
            packed, path = stored(nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("members"),
                F.first("total").alias("total")), "merkle-blocks")  # at most BLOCK members each
            kind = packed.schema["grp"].dataType.simpleString()
            roots, root_path = stored(
                packed.select("grp", "block", F.transform("members", lambda m: m["digest"]).alias("digests"), "total")
                .mapInArrow(_block_roots, f"grp {kind}, block bigint, total bigint, digest string"), "merkle-roots")
            self.tiers.append((packed, roots))
            self.paths += [path, root_path]
            nodes = roots.where(F.col("total") > BLOCK).select(
                "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.struct("digest").alias("member"))
            if not nodes.limit(1).count():
                break

    def roots(self) -> DataFrame:
        """``grp, digest``: the root of each group, from the tier at which it is a single block."""
        out = None
        for _, roots in self.tiers:
            part = roots.where(F.col("total") <= BLOCK).select("grp", "digest")
            out = part if out is None else out.unionAll(part)
        return out

    def witnesses(self, upper: DataFrame | None) -> DataFrame:
        """``grp, pos, member, witness, subroot, root`` of the lowest nodes; ``upper`` has ``grp,
        witness, subroot, root`` of the groups' roots in the tree above, or there is none."""
        nodes = None
        for packed, _ in reversed(self.tiers):
            kind = packed.schema["grp"].dataType.simpleString()
            none = [F.lit(None).cast(STEP).alias("witness"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root")]
            # a block that is its group's only one has the group's witness, others that of their root
            whole = packed.where(F.col("total") <= BLOCK)
            if upper is None:
                whole = whole.select("grp", "block", "members", "total", *none)
            else:
                whole = whole.join(upper.withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g"))).select(
                    "grp", "block", "members", "total", "witness", "subroot", "root")
            below = whole
            if nodes is not None:
                above = nodes.select(F.col("grp").alias("_g"), F.col("pos").alias("_b"), "witness", "subroot", "root")
                below = whole.unionAll(packed.where(F.col("total") > BLOCK).join(
                    above, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).select(
                    "grp", "block", "members", "total", "witness", "subroot", "root"))
            member = packed.schema["members"].dataType.elementType.simpleString()
            nodes = below.mapInArrow(
                _leaf_witnesses, f"grp {kind}, pos bigint, member {member}, witness {STEP}, subroot string, root string")
        return nodes


def manifest(rows: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """``rows`` with ``pos, witness, subroot, root``: each row's place in its group and its way to the root.

    Per ``group`` (null is one of its own), rows ascend by ``order`` (nulls first), then ``digest``;
    rows equal in both have the same leaf and may take either place. Every ``ARITY`` consecutive nodes
    become their parent until one is left; the groups' roots, ordered by group (null first, bytewise),
    become the root in the same way. A run of one is hashed too as long as its level has several nodes.
    No rows give no rows. Columns may have any names but ``pos, total, witness, subroot, root`` and those
    that begin with an underscore. The digest may not be null.
    """
    spark: SparkSession = rows.sparkSession
    bounded_batches(spark)
    rows, rows_path = stored(rows, "merkle-leaves")  # the sort samples its input first: digests are not taken twice
    placed, sort_paths = positions(rows, group, order, digest)
    rest = [c for c in rows.columns if c not in (group, digest)]
    leaves = Forest(placed.select(F.col(group).alias("grp"), "pos", "total", F.struct(
        F.col(digest).alias("digest"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("member")))
    tops, top_paths = positions(leaves.roots().select(F.lit(0).alias("one"), "grp", "digest"), "one", "grp")
    groups = Forest(tops.select(F.col("one").alias("grp"), "pos", "total", F.struct("digest", F.col("grp").alias("g")).alias("member")))
    upper, upper_path = stored(groups.witnesses(None).select(
        F.col("member.g").alias("grp"), "witness", F.col("member.digest").alias("subroot"), "root"), "merkle-upper")
    for path in [rows_path, *sort_paths, *top_paths]:
        forget(spark, path)
    out = leaves.witnesses(upper)
    names = {group: F.col("grp"), digest: F.col("member.digest"), **{c: F.col(f"member.c{i}") for i, c in enumerate(rest)}}
    return out.select(*(names[c].alias(c) for c in rows.columns), "pos", "witness", "subroot", "root")


def _oracle(leaf_levels: int = 6, group_levels: int = 4) -> str:
    """The manifest of ``documents`` in DuckDB, level by level (up to 16^6 rows of a source, 16^4 sources)."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def digest(text: str) -> str:
        return f"sha256({' || '.join([part('doc_id'), part('source'), part('lang'), part('n_chars'), part(text)])})"

    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ctes = [
        # CRC-32 of the decimal id: the usual table, then one step per character
        "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
        "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        "d AS (SELECT *, doc_id::VARCHAR AS k FROM documents)",
        "tampered AS (SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), "
        "lambda i: ord(k[i])::BIGINT)), lambda c, b: xor(t[(xor(c, b) % 256) + 1], c >> 8)), 4294967295) % 5 = 0, false) AS hit "
        "FROM d, crc_table)",
        f"leaves AS (SELECT doc_id, source, {digest('text')} AS leaf, translate(text, '{up}', '{low}') AS text2, hit, lang, n_chars FROM tampered)",
        f"placed AS MATERIALIZED (SELECT doc_id, source, leaf, CASE WHEN hit THEN {digest('text2')} ELSE leaf END AS altered, "
        "dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves)",
        "l0 AS MATERIALIZED (SELECT g, p AS pos, leaf AS d, count(*) OVER (PARTITION BY g) AS c FROM placed)"]

    def tier(name: str, levels: int) -> None:
        run = f"OVER (PARTITION BY g, pos // {ARITY} ORDER BY pos ROWS BETWEEN "
        for k in range(levels):
            ctes.append(f"{name}s{k} AS MATERIALIZED (SELECT g, pos, c > 1 AS up, "
                        f"coalesce(string_agg(d, '') {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                        f"coalesce(string_agg(d, '') {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, pos // {ARITY} AS pos, CASE WHEN any_value(c) > 1 "
                        f"THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d, "
                        f"(any_value(c) + {ARITY - 1}) // {ARITY} AS c FROM {name}{k} GROUP BY ALL)")

    tier("l", leaf_levels)
    ctes.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, d, count(*) OVER () AS c FROM l{leaf_levels})")
    tier("t", group_levels)
    ctes.append("f0 AS (SELECT *, altered AS fold, '' AS proof FROM placed)")
    n = 0
    for name, levels, at, group in (("l", leaf_levels, "p", "f.g"), ("t", group_levels, "f.g", "0")):
        for k in range(levels):
            ctes.append(f"f{n + 1} AS (SELECT f.* EXCLUDE (fold, proof), CASE WHEN up THEN sha256(lft || fold || rgt) ELSE fold END AS fold, "
                        f"proof || lft || rgt AS proof FROM f{n} f JOIN {name}s{k} s ON s.g = {group} AND s.pos = {at} // {ARITY ** k})")
            n += 1
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT f.doc_id, f.leaf, sub.d AS subroot, top.d AS root, sha256(f.proof) AS proof_sha256, "
            f"f.fold AS folded_root, f.fold = top.d AS verified FROM f{n} f JOIN l{leaf_levels} sub ON sub.g = f.g, t{group_levels} top")


ORACLE = _oracle()
