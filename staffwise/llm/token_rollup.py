"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive: a change adds its new state with sign
+1 and takes back its old state with sign -1. A batch of changes is reduced to one signed row per
group (combined before the shuffle, so a hot source costs no more than any other) and committed
under its batch id. A commit is one marker file that is created or found: a batch that is sent again
changes nothing, and one whose job was lost half way can be sent again. ``compact`` folds the committed deltas
into a snapshot, so that reading the totals does not grow with the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """One signed row per group of a batch of changes.

    ``changes`` has ``op`` (insert, delete, revise), the new state ``source, lang, tokenizer,
    n_tokens`` (insert, revise) and the old state ``old_source, ...`` (delete, revise). Null group
    values are a group of their own, null counts are 0, rows with another or null ``op`` are an
    error. Other columns are ignored; groups whose changes cancel out are dropped.
    """
    def state(prefix: str, sign: int):
        return F.struct(*(F.col(prefix + k).cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("n_docs"),
                        (F.coalesce(F.col(prefix + "n_tokens"), F.lit(0)).cast("long") * sign).alias("n_tokens"))

    op = F.col("op")
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.lit("unknown op of a change")))
    both = F.array_compact(F.array(F.when(known.isin("insert", "revise"), state("", 1)),
                                   F.when(known.isin("delete", "revise"), state("old_", -1))))
    return (changes.select(F.explode(both).alias("s")).select("s.*").groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0"))


class Rollup:
    """A store of committed deltas below ``path``, which all executors must share.

    What counts is named by empty marker files, ``<batch>-<folder id>`` for a delta and ``<version>-<folder id>`` for a
    snapshot, so a marker is whole as soon as it exists. A job that is lost before its marker leaves a folder that
    nobody reads, and its batch can be sent again. Of two writers of one batch or version the first
    by name counts; both hold the same changes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _marked(self, folder: str) -> dict[str, str]:
        """Name -> folder id of the markers in ``folder``, by a listing alone."""
        p = self._path(folder)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []
        found: dict[str, str] = {}
        for n in names:
            found.setdefault(n[:-33], n[-32:])
        return found

    def _mark(self, folder: str, name: str, key: str) -> None:
        self._fs.create(self._path(f"{folder}/{name}-{key}"), False).close()

    def committed(self) -> list[str]:
        return sorted(self._marked("commits"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if its id is committed already (its changes are not looked at)."""
        if not batch_id or "/" in batch_id:
            raise ValueError("a batch needs an id without '/'")
        if batch_id in self._marked("commits"):
            return False
        key = uuid.uuid4().hex
        signed_deltas(changes).write.parquet(f"{self.path}/deltas/{batch_id}-{key}")
        self._mark("commits", batch_id, key)
        return self._marked("commits")[batch_id] == key

    def _snapshot(self) -> tuple[int, str | None, set[str]]:
        """Version, folder and batches of the latest snapshot."""
        marked = self._marked("snapshots")
        if not marked:
            return 0, None, set()
        version = max(marked)
        folder = f"{self.path}/snapshot-{version}-{marked[version]}"
        batches = self.spark.read.schema("batch string").parquet(f"{folder}/batches").collect()  # one row per batch
        return int(version), f"{folder}/totals", {r["batch"] for r in batches}

    def _sum(self, commits: dict[str, str], snapshot: str | None, folded: set[str]) -> DataFrame:
        """Totals of a snapshot and of those of the listed commits that it doesn't hold."""
        folders = [f"{self.path}/deltas/{b}-{key}" for b, key in commits.items() if b not in folded] + ([snapshot] if snapshot else [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        return (rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 OR n_tokens <> 0"))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches, groups of no documents left out."""
        _, snapshot, folded = self._snapshot()
        return self._sum(self._marked("commits"), snapshot, folded)

    def compact(self) -> None:
        """Fold the batches committed so far into the next snapshot: those of one listing, which it names. A batch that is
        committed meanwhile stays a delta."""
        version, snapshot, folded = self._snapshot()
        commits, key = self._marked("commits"), uuid.uuid4().hex
        name = f"{version + 1:08d}"
        folder = f"{self.path}/snapshot-{name}-{key}"
        self._sum(commits, snapshot, folded).write.parquet(f"{folder}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(folded | set(commits))], "batch string").coalesce(1).write.parquet(f"{folder}/batches")
        self._mark("snapshots", name, key)

    def vacuum(self) -> int:
        """Delete the deltas that the latest snapshot holds and the snapshots before it; how many folders. For when no
        earlier result of ``totals`` is read any more."""
        version, _, folded = self._snapshot()
        commits, snapshots = self._marked("commits"), self._marked("snapshots")
        gone = [f"deltas/{b}-{commits[b]}" for b in folded if b in commits]
        gone += [f"snapshot-{v}-{key}" for v, key in snapshots.items() if int(v) < version]
        return sum(self._fs.delete(self._path(g), True) for g in gone)
