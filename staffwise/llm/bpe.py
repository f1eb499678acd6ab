"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Spark splits every text by the tokenizer's pattern; a task collects the distinct words of a batch,
turns those it has not met into token-position rows and lets one recursive query contract them:
each step joins the rows of every unfinished word with the merge table, picks the word's leftmost
pair of minimum rank, and replaces it, until no pair is left. Decoding joins position rows with the
vocabulary and concatenates the pieces by an ordered aggregation, once per distinct run of tokens.

Both work on distinct words and runs, in chunks of fixed size, so a task's memory is bounded by its
batch; the word memory of a Python worker only saves time and is replaced in two generations of
``MEMORY`` words. A word takes one step of the query per merge, and a step rewrites the word, so the query
costs time and memory with the square of a word's length. An unbroken word of ``LONG`` bytes or more is
therefore contracted by a heap of its pairs, to the same fixpoint. There is no shuffle, and nothing but
the vocabulary leaves the driver.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

CHUNK = 25_000  # words or runs in one DuckDB query
STEP_ROWS = 3_000_000  # bound of the rows of all steps of one query: a word of n bytes has less than n * n
MEMORY = 200_000  # words in each of the two generations a worker remembers
LONG = 128  # bytes; longer words do not go through the recursive query
MAX_VOCABULARY = 8 << 20  # bytes; the vocabulary is sent to every task

ENCODE = """
WITH RECURSIVE t(step, wid, pos, id, nid, m) AS (
  SELECT 0, wid, pos, id, nid, merged FROM tok LEFT JOIN merges ON pair = id::BIGINT * 16777216 + nid
  UNION ALL
  (WITH best AS (SELECT wid, min(m::BIGINT * 1048576 + pos) AS b FROM t WHERE m IS NOT NULL GROUP BY wid),
   cur AS (SELECT t.*, (b & 1048575)::INT AS spot, (b >> 20)::INT AS new FROM t JOIN best USING (wid)),
   nxt AS (
     SELECT step + 1 AS step, cur.wid, pos - (pos > cur.spot)::INT AS pos,
       CASE WHEN pos = cur.spot THEN new ELSE id END AS id,
       CASE WHEN pos = cur.spot THEN gone.nid WHEN pos = cur.spot - 1 THEN new ELSE cur.nid END AS nid,
       CASE WHEN pos NOT IN (cur.spot, cur.spot - 1) THEN m END AS m,
       pos IN (cur.spot, cur.spot - 1) AS touched
     FROM cur LEFT JOIN (SELECT wid, spot, nid FROM cur WHERE pos = spot + 1) gone
       ON gone.wid = cur.wid AND gone.spot = cur.pos
     WHERE pos <> cur.spot + 1)
   SELECT step, wid, pos, id, nid, coalesce(m, merged)
   FROM nxt LEFT JOIN merges ON pair = CASE WHEN touched THEN id::BIGINT * 16777216 + nid END)
)
SELECT wid, list(id ORDER BY pos) AS ids
FROM t JOIN (SELECT wid, max(step) AS step FROM t GROUP BY wid) USING (wid, step)
GROUP BY wid ORDER BY wid
"""

DECODE = """
SELECT run, string_agg(hex, '' ORDER BY pos) AS hex FROM rows JOIN pieces USING (id) GROUP BY run ORDER BY run
"""


def joined(parts: pa.Array, off: np.ndarray, between: bytes) -> list[bytes]:
    """The ``parts`` of each row as one."""
    rows = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), parts)
    return pc.binary_join(rows, pa.scalar(between, parts.type)).to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Codec:
    """Encoder and decoder of one vocabulary in one Python worker."""

    _kept: dict[bytes, "Codec"] = {}

    @classmethod
    def of(cls, vocabulary: bytes) -> "Codec":
        key = hashlib.sha256(vocabulary).digest()
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(vocabulary)
        return cls._kept[key]

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.n = max(self.ranks.values()) + 1
        self.bits = self.n.bit_length()
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.starts_word = np.zeros(self.n, bool)
        left, right, merged = [], [], []
        for piece, rank in self.ranks.items():
            self.starts_word[rank] = piece[:1] in (b" ", b"\n")
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        # no folder to spill to: what a query holds is bounded by STEP_ROWS
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        pairs = pa.table({"pair": np.array(left, np.int64) * 16777216 + np.array(right, np.int64),
                          "merged": np.array(merged, np.int32)})
        pieces = pa.table({"id": np.array(list(self.ranks.values()), np.int32), "hex": [p.hex() for p in self.ranks]})
        for name, table in (("merges", pairs), ("pieces", pieces)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.packed = [i.to_bytes(4, "little") for i in range(self.n)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def contract_long(self, word: bytes) -> bytes:
        """The fixpoint of ``contract`` for one word, by a heap of its pairs instead of a step per merge.

        A heap entry is rank and start in one number; it counts only while the pair that starts there
        still has that rank, so of equal ranks the leftmost goes first.
        """
        n, rank_of = len(word), self.ranks.get
        end_of, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        live = bytearray(b"\1") * n
        heap = [r << 40 | i for i in range(n - 1) if (r := rank_of(word[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 40, entry & (1 << 40) - 1
            if not live[i] or (mid := end_of[i]) == n or rank_of(word[i:(end := end_of[mid])]) != rank:
                continue
            live[mid], end_of[i] = 0, end
            if end < n:
                before[end] = i
                if (r := rank_of(word[i:end_of[end]])) is not None:
                    heappush(heap, r << 40 | i)
            if (p := before[i]) >= 0 and (r := rank_of(word[p:end])) is not None:
                heappush(heap, r << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(self.packed[self.ranks[word[i:end_of[i]]]])
            i = end_of[i]
        return b"".join(out)

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Token ids (packed int32) of non-empty words that are no vocabulary entry themselves."""
        out, lo = [], 0
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cost = np.cumsum(sizes * sizes)
        while lo < len(words):
            done = int(cost[lo - 1]) if lo else 0
            hi = min(lo + CHUNK, max(lo + 1, int(np.searchsorted(cost, done + STEP_ROWS, "right"))))
            part, lengths = words[lo:hi], sizes[lo:hi]
            lo = hi
            ids = self.base[np.frombuffer(b"".join(part), np.uint8)]
            ends = np.cumsum(lengths)
            nid = np.empty_like(ids)
            nid[:-1] = ids[1:]
            nid[ends - 1] = -1
            self.db.register("tok", pa.table({
                "wid": np.repeat(np.arange(len(part), dtype=np.int32), lengths),
                "pos": ragged(np.zeros(len(part), np.int64), lengths).astype(np.int32), "id": ids, "nid": nid}))
            got = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
            flat, off = got.values.to_numpy().astype(np.int32), got.offsets.to_numpy()
            packed, at = flat.tobytes(), ((off - off[0]) * 4).tolist()
            out += [packed[a:b] for a, b in zip(at[:-1], at[1:])]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Token ids (packed int32) of distinct words."""
        out: list = [None] * len(words)
        new = []
        young, old, whole = self.young, self.old, self.ranks
        for i, w in enumerate(words):
            got = young.get(w)
            if got is None and (got := old.get(w)) is not None:
                young[w] = got
            if got is None:
                b = w.encode("utf-8", "replace")
                rank = whole.get(b)
                if rank is None:
                    new.append((i, w, b))
                else:
                    young[w] = got = self.packed[rank]
            out[i] = got
        short = [x for x in new if len(x[2]) < LONG]
        for (i, w, _), ids in zip(short, self.contract([b for _, _, b in short]), strict=True):
            out[i] = young[w] = ids
        for i, _, b in new:
            if len(b) >= LONG:  # not remembered: the memory counts words, not bytes
                out[i] = self.contract_long(b)
        if len(young) > MEMORY:
            self.young, self.old = {}, young
        return out

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets of rows that hold lists of words."""
        off = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self.words(coded.dictionary.to_pylist())
        if not ids:
            return np.empty(0, np.int32), np.zeros(len(off), np.int64)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(lengths) - lengths
        per_word = lengths[index]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        return flat[ragged(starts[index], per_word)], ends[off - off[0]]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The bytes of each row of token ids. Runs of a few tokens that repeat are decoded once."""
        n, width = len(ids), 63 // self.bits
        if not n:
            return [b""] * (len(off) - 1)
        at = np.arange(n)
        first = self.starts_word[ids]
        first[off[:-1][off[:-1] < n]] = True
        since = at - np.maximum.accumulate(np.where(first, at, 0))
        run_at = np.flatnonzero(since % width == 0)
        lengths = np.diff(np.append(run_at, n))
        place = at - np.repeat(run_at, lengths)
        key = np.add.reduceat((ids.astype(np.int64) + 1) << (place * self.bits), run_at)
        coded = pa.array(key).dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        pieces: list[bytes] = []
        for lo in range(0, len(distinct), CHUNK):
            part = distinct[lo:lo + CHUNK]
            k = (part[:, None] >> (np.arange(width) * self.bits)) & ((1 << self.bits) - 1)
            run, pos = np.nonzero(k)
            self.db.register("rows", pa.table({"run": run, "pos": pos, "id": (k[run, pos] - 1).astype(np.int32)}))
            pieces += map(bytes.fromhex, self.db.sql(DECODE).to_arrow_table().column("hex").to_pylist())
        parts = pa.array(pieces, pa.large_binary()).take(pa.array(index))
        return joined(parts, np.searchsorted(run_at, off), b"")


def read_vocabulary(path: str) -> bytes:
    """A rank file (base64 piece and rank per line), at most ``MAX_VOCABULARY`` bytes."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is over {MAX_VOCABULARY} bytes")
    return data


def split_words(text: Column, pattern: str) -> Column:
    """All matches of the tokenizer's pattern, with Unicode classes; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


ROWS = 1_000  # rows whose words are coded together


def encode(df: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: token ids of every whole text, one row per input row, ids null or repeated as given.

    A null or empty text has no ids. Other columns are ignored, whatever their names.
    """
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), split_words(F.col(text_col), pattern).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
            ids, off = codec.encode(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], ["id", "ids"])
        tidy()

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, vocabulary: bytes, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: the bytes of every row of token ids; a null row counts as empty.

    An id that the vocabulary lacks, or a null id, is an error.
    """
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
            off = b.column(1).offsets.to_numpy().astype(np.int64)
            values = b.column(1).values.slice(off[0], off[-1] - off[0])
            if values.null_count or (len(values) and (min(ids := values.to_numpy()) < 0 or max(ids) >= codec.n)):
                raise ValueError("an id outside the vocabulary")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(codec.decode(values.to_numpy(), off - off[0]), pa.binary())], ["id", "bytes"])
        tidy()

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass, as digests."""
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), split_words(F.col(text_col), pattern).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
            ids, off = codec.encode(b.column(1))
            texts = joined(pa.array(ids).cast(pa.large_string()).cast(pa.large_binary()), off, b",")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off)), pa.array(list(map(sha, texts))), pa.array(list(map(sha, codec.decode(ids, off))))],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, "
                                "ids_sha256 string, decoded_sha256 string")
