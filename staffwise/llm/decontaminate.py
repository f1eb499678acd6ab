"""Benchmark decontamination by spaced seeds.

Test items and training texts are lists of tokens. A seed looks at a window of ``SPAN`` tokens and
ignores some positions of it: the window falls into ``PARTS`` equal parts, and each mask leaves out
two of them. Two substitutions lie in at most two parts, so for any window with up to two substituted
tokens at least one mask sees only equal tokens. Hashes of masked windows of both sides are joined;
each hit fixes an alignment of text and item, and is verified there: the longest stretch with a high
share of equal tokens, then the longest ones left and right of it, must each reach a minimum length.

Items shorter than a window are cut into one piece more than the substitutions that the share of
equal tokens allows, so one piece is always intact; the first ``PIECE`` tokens of the pieces are
joined, and the whole item is compared at each hit. Tokens are words, and single characters in scripts
that are written without blanks; such a character counts as the part of a word that it is on average.

The benchmark is a stated query set. It is cut into blocks of bounded size, and each block is sent
to all tasks, which join its hashes with those of their texts in sorted arrays. Where there are several
blocks, each is a job of its own over the stored texts that writes what it finds to the shared folder, and is
freed before the next one is read, so the driver and the executors hold one block at a time however large the
benchmark is; the finds are then joined to the rows.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidy

SPAN, PARTS, LEFT_OUT = 12, 4, 2
PIECE = 3
MIN_TOKENS = 13  # words of a verified overlap; items with fewer must be there as a whole
MIN_WORDS = 3  # of an item; one with fewer is found only in a text that consists of it
MIN_SURE = 5  # words that are equal in an overlap with substitutions
CANDIDATES = 1 << 18  # short items compared at once
MIN_EQUAL = 0.8  # share of equal tokens in an overlap
BLOCK_CHARS = 16 << 20  # characters of the benchmark in one block
MULTIPLIER = 0x9E3779B97F4A7C15
PIECE_CHARS = 4 << 20  # of texts that are searched together
ROW = "_decontaminate_row"
BITS = 22  # of the table that tells most foreign hashes before the join


def masks(span: int = SPAN, parts: int = PARTS, left_out: int = LEFT_OUT) -> list[np.ndarray]:
    """Positions that each mask looks at."""
    part = np.arange(span) * parts // span
    return [np.flatnonzero(~np.isin(part, gone)) for gone in combinations(range(parts), left_out)]


#: All non-word signs of ASCII become blanks, so that bytes.split() gives the tokens of most texts.
PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


#: Scripts without blanks between words, as character ranges; those of Han stand for half a word, the others for a quarter.
HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{HAN}\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f]")
IDEOGRAPH = re.compile(f"[{HAN}]")


def _signs() -> re.Pattern:
    """Characters beyond ASCII that separate: punctuation, symbols, blanks and controls."""
    ranges: list[list[int]] = []
    for c in range(128, sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PSZ" or kind in ("Cc", "Cf"):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")


SIGNS = _signs()


def tokens(text: str | None) -> list[bytes]:
    """Lower-case tokens: runs of letters, marks and digits; single characters in scripts without blanks."""
    low = (text or "").lower()
    if not low.isascii():
        low = UNSPACED.sub(r" \g<0> ", SIGNS.sub(" ", low))
    return low.encode("utf-8", "replace").translate(PLAIN).split()


def worth(token: bytes) -> float:
    """The part of a word that a token stands for."""
    c = token.decode("utf-8", "replace")
    return (0.5 if IDEOGRAPH.match(c) else 0.25) if UNSPACED.match(c) else 1.0


class Block:
    """The joined side of one block of items: token ids, masked hashes and where they come from."""

    def __init__(self, items: list[tuple[int, str]], min_tokens: int, min_equal: float):
        self.min_tokens, self.min_equal = min_tokens, min_equal
        self.item_ids = [i for i, _ in items]
        words = [tokens(t) for _, t in items]
        self.vocabulary = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.words = pa.array([w.decode() for w in self.vocabulary], pa.large_string())
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in words]
        rows = []
        for n, ids in enumerate(self.ids):
            for m in range(len(MASKS)):
                h = hashes(ids, m)
                rows.append((h, np.full(len(h), n), np.arange(len(h))))
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        flat = [np.concatenate([none[i], *(r[i] for r in rows)]) for i in range(3)]
        order = np.argsort(flat[0], kind="stable")
        self.hash, self.item, self.pos = (f[order] for f in flat)
        self.table = np.zeros(1 << BITS, bool)
        self.table[self.hash >> np.uint64(64 - BITS)] = True
        value = np.array([0.0, *(worth(w) for w in self.vocabulary)])
        self.value = [value[ids] for ids in self.ids]
        self.tiny: dict[tuple, list[int]] = {}  # items that say too little to be looked for inside a text
        pieces, short = [], []
        for n, ids in enumerate(self.ids):
            if len(ids) and self.value[n].sum() < MIN_WORDS:
                self.tiny.setdefault(tuple(ids.tolist()), []).append(n)
            elif 0 < len(ids) < SPAN:
                gone = max(0, min(int((1 - min_equal) * len(ids) + 1e-9), len(ids) // PIECE - 1))
                pieces += [(len(short), len(ids) * k // (gone + 1)) for k in range(gone + 1)]
                short.append((n, len(ids) - gone))
        self.short = np.array([n for n, _ in short], np.int64)
        self.least = np.array([k for _, k in short], np.int64)  # tokens of a short item that must be equal
        self.length = np.array([len(self.ids[n]) for n, _ in short], np.int64)
        self.padded = np.full((len(short), SPAN), -1, np.int64)
        self.worths = np.zeros((len(short), SPAN))
        for k, (n, _) in enumerate(short):
            self.padded[k, :len(self.ids[n])] = self.ids[n]
            self.worths[k, :len(self.ids[n])] = self.value[n]
        heads = np.array([self.padded[k, o:o + PIECE] for k, o in pieces], np.int64).reshape(-1, PIECE)
        key = grams(heads.ravel())[::PIECE] if len(heads) else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.piece = key[order]
        self.piece_item, self.piece_at = (np.array([x[i] for x in pieces], np.int64)[order] for i in range(2))
        self.piece_table = np.zeros(1 << BITS, bool)
        self.piece_table[self.piece >> np.uint64(64 - BITS)] = True

    def overlaps(self, text: str | None) -> list[tuple[int, int, int]]:
        """Verified ``(item, start, end)`` in tokens of the text, sorted, merged per item."""
        return self.search(pa.array([text], pa.string()))[0]

    def search(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """``overlaps`` of every text. All texts are one row of token ids, SPAN foreign ids apart, so that no window
        lies in two of them; a window is hashed only if every token that the mask sees is known to the benchmark."""
        ids, starts, ends = self.read(texts)
        known = ids > 0
        found: dict[tuple[int, int, int], None] = {}
        for m, mask in enumerate(MASKS):
            n = len(ids) - SPAN + 1
            if n <= 0:
                break
            seen = known[mask[0]:mask[0] + n].copy()
            for i in mask[1:]:
                seen &= known[i:i + n]
            at = np.flatnonzero(seen)
            if not len(at):
                continue
            h = hashes(ids, m, at)
            hit = self.table[h >> np.uint64(64 - BITS)]
            at, h = at[hit], h[hit]
            lo = np.searchsorted(self.hash, h, "left")
            hi = np.searchsorted(self.hash, h, "right")
            text = np.searchsorted(starts, at, "right") - 1
            for t, p, a, b in zip(text[hi > lo].tolist(), at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                p -= int(starts[t])
                for k in range(a, b):
                    found[t, int(self.item[k]), p - int(self.pos[k])] = None
        out: list[list] = [[] for _ in range(len(texts))]
        for (t, n, shift) in sorted(found):
            out[t] += [(n, a + shift, b + shift) for a, b in self.verify(n, ids[starts[t]:ends[t]], shift)]
        for t in range(len(texts)):
            own = ids[starts[t]:ends[t]]
            if len(own) < SPAN * 4:
                out[t] += [(n, 0, len(own)) for n in self.tiny.get(tuple(own.tolist()), ())]
        for t, *span in self.whole(ids, starts, ends):
            out[t].append(tuple(span))
        return [sorted(set(x)) for x in out]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts (0: not in the benchmark), and where each text begins and ends among them."""
        plain = [(t or "").lower().encode("utf-8", "replace").translate(PLAIN) for t in texts.to_pylist()]
        lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).cast(pa.large_string()))
        sizes = np.diff(np.asarray(lists.offsets))
        flat = lists.flatten().dictionary_encode()
        code, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        first = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        many = pc.invert(pc.string_is_ascii(words)) if len(words) else pa.array([], pa.bool_())
        count = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts: dict[int, list[int]] = {}
        for w in np.flatnonzero(many.to_numpy(zero_copy_only=False)).tolist():  # words that other signs or scripts may divide
            parts[w] = [self.vocabulary.get(x, 0) for x in tokens(words[w].as_py())]
            count[w] = len(parts[w])
        at = np.concatenate([[0], np.cumsum(count)])  # the ids of all distinct words in one row
        row = np.zeros(at[-1], np.int64)
        single = np.flatnonzero(count == 1)
        row[at[single]] = first[single]
        for w, ids in parts.items():
            row[at[w]:at[w + 1]] = ids
        n = count[code]
        to = np.concatenate([[0], np.cumsum(n)])
        bounds = to[np.concatenate([[0], np.cumsum(sizes)])]  # of texts among the tokens
        inside = np.arange(to[-1]) - np.repeat(to[:-1], n)
        text = np.repeat(np.arange(len(sizes)), np.diff(bounds))
        ids = np.zeros(to[-1] + SPAN * len(sizes), np.int64)
        ids[np.arange(to[-1]) + SPAN * text] = row[np.repeat(at[code], n) + inside]
        starts = bounds[:-1] + SPAN * np.arange(len(sizes))
        return ids, starts, starts + np.diff(bounds)

    def whole(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> set[tuple[int, int, int, int]]:
        """Short items that a text holds as a whole, but for the substitutions that the share allows, with the text."""
        if not len(self.piece) or len(ids) < PIECE:
            return set()
        known = ids > 0
        seen = known[:len(ids) - PIECE + 1].copy()
        for i in range(1, PIECE):
            seen &= known[i:i + len(seen)]
        at = np.flatnonzero(seen)
        key = grams(ids, at)
        hit = self.piece_table[key >> np.uint64(64 - BITS)]
        at, key = at[hit], key[hit]
        lo = np.searchsorted(self.piece, key, "left")
        n = np.searchsorted(self.piece, key, "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        ends = np.cumsum(n)
        found: set[tuple[int, int, int, int]] = set()
        total = int(ends[-1]) if len(ends) else 0
        for first in range(0, total, CANDIDATES):
            k = np.arange(first, min(total, first + CANDIDATES))
            hit = np.searchsorted(ends, k, "right")
            row = lo[hit] + k - (ends[hit] - n[hit])
            item = self.piece_item[row]
            start = at[hit] - self.piece_at[row]
            text = np.searchsorted(starts, at[hit], "right") - 1
            ok = (start >= starts[text]) & (start + self.length[item] <= stops[text])
            item, start, text = item[ok], start[ok], text[ok]
            seen = ids[np.minimum(start[:, None] + np.arange(SPAN), len(ids) - 1)]
            same = seen == self.padded[item]
            equal = same.sum(1)
            ok = (equal == self.length[item]) | (
                (equal >= self.least[item]) & ((same * self.worths[item]).sum(1) >= MIN_SURE))
            start, text, item = (start - starts[text])[ok], text[ok], item[ok]
            found.update(zip(text.tolist(), self.short[item].tolist(), start.tolist(), (start + self.length[item]).tolist()))
        return found

    def verify(self, n: int, ids: np.ndarray, shift: int) -> list[tuple[int, int]]:
        """Stretches of item ``n`` aligned at ``shift`` whose tokens are equal but for substitutions."""
        item = self.ids[n]
        lo, hi = max(0, -shift), min(len(item), len(ids) - shift)
        if hi <= lo:
            return []
        same = item[lo:hi] == ids[lo + shift:hi + shift]
        gain = np.where(same, 1.0 - self.min_equal, -self.min_equal)
        total = np.concatenate(([0.0], np.cumsum(gain)))
        starts = np.flatnonzero(same | (np.arange(lo, hi) == 0))
        ends = np.flatnonzero(same | (np.arange(lo, hi) == len(item) - 1)) + 1
        value = np.concatenate(([0.0], np.cumsum(self.value[n][lo:hi])))
        sure = np.concatenate(([0.0], np.cumsum(self.value[n][lo:hi] * same)))
        need = min(self.min_tokens, self.value[n].sum())
        out, open_parts = [], [(0, hi - lo)]
        while open_parts:  # the longest stretch of a part, then the parts left and right of it
            left, right = open_parts.pop()
            if value[right] - value[left] < need:
                continue
            a, b = longest(total, starts[(starts >= left) & (starts < right)], ends[(ends > left) & (ends <= right)])
            if a == b:
                continue
            gone = b - a - int(round((total[b] - total[a]) + self.min_equal * (b - a)))
            if value[b] - value[a] >= need and (not gone or sure[b] - sure[a] >= MIN_SURE):
                out.append((lo + a, lo + b))
            open_parts += [(left, a), (b, right)]
        return sorted(out)


def longest(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """The longest stretch from one of ``starts`` to one of ``ends`` whose running ``total`` does not fall; of
    several the one that ends first."""
    if not len(starts) or not len(ends):
        return (0, 0)
    least = np.minimum.accumulate(total[starts])
    first = np.searchsorted(-least, -(total[ends] + 1e-9))  # of the starts that are no higher than the end
    length = np.where(first < len(starts), ends - starts[np.minimum(first, len(starts) - 1)], 0)
    k = int(np.argmax(length))
    return (int(starts[first[k]]), int(ends[k])) if length[k] > 0 else (0, 0)


MASKS = masks()
WEIGHTS = np.array([pow(MULTIPLIER, 2 * i + 1, 1 << 64) for i in range(SPAN)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashes(ids: np.ndarray, mask: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the seen token ids of the windows of ``SPAN`` tokens that begin at ``at`` (all of them), tagged by the mask."""
    at = np.arange(max(0, len(ids) - SPAN + 1)) if at is None else at
    h = np.full(len(at), (mask + 1) * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    for i in MASKS[mask]:
        h += ids[at + i].astype(np.uint64) * WEIGHTS[i]
    return mixed(h)


def grams(ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``PIECE`` adjacent token ids that begin at ``at`` (all of them)."""
    at = np.arange(max(0, len(ids) - PIECE + 1)) if at is None else at
    h = np.zeros(len(at), np.uint64)
    for i in range(PIECE):
        h += ids[at + i].astype(np.uint64) * WEIGHTS[i]
    return mixed(h)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS,
                  min_equal: float = MIN_EQUAL, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``_items`` (sorted distinct ids of items found in the row) and ``_spans``
    (structs item, start, end in tokens). One row per input row.

    Null and empty texts contain nothing; items with a null id or without tokens are ignored; items
    that repeat are compared once each. An item shorter than ``min_tokens`` words must be there as a whole,
    with at least ``min_equal`` of its tokens equal and, unless all are, ``MIN_SURE`` words of them. An item
    of fewer than ``MIN_WORDS`` words is found only in a text that consists of it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where(
        "item IS NOT NULL AND length(text) > 0").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c"), F.count("*").alias("n")).first()
    n_blocks = max(1, math.ceil(size.c / block_chars))
    kind = "array<struct<item:bigint,start:bigint,end:bigint>>"
    nothing = F.array().cast(kind)

    def block(k: int):
        """Block ``k`` of the items, sent to the executors: about ``block_chars`` characters."""
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).orderBy("item", "text")
        return spark.sparkContext.broadcast(([(r.item, r.text) for r in part.collect()], min_tokens, min_equal))

    if n_blocks == 1:
        out = docs.withColumn("_spans", nothing)
        out = out.mapInArrow(_search(block(0), docs.columns.index(text_col)), out.schema)
    else:
        rows, _ = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "decontaminate-rows")  # ids that stay
        texts, found = rows.select(ROW, text_col).withColumn("_spans", nothing), []
        for k in range(n_blocks):
            sent = block(k)
            hits = texts.mapInArrow(_search(sent, 1), texts.schema).where(F.size("_spans") > 0).select(ROW, "_spans")
            found.append(stored(hits, "decontaminate-found")[1])
            sent.destroy()
        finds = spark.read.schema(hits.schema).parquet(*found).groupBy(ROW).agg(  # a list per block and row
            F.array_sort(F.flatten(F.collect_list("_spans"))).alias("_spans"))
        out = rows.join(finds, ROW, "left").select(*docs.columns, F.coalesce("_spans", nothing).alias("_spans"))
    return out.withColumn("_items", F.array_sort(F.array_distinct(F.col("_spans.item"))))


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about PIECE_CHARS bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, before = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE_CHARS, "right")))
        yield texts.slice(first, last - first)
        first, before = last, int(ends[last - 1])


def _search(sent, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*sent.value)
        for b in batches:
            spans = b.column(b.num_columns - 1).to_pylist()
            done, texts = 0, b.column(at)
            for part in pieces(texts):
                for k, new in enumerate(block.search(part), done):
                    spans[k] = (spans[k] or []) + [{"item": block.item_ids[n], "start": s, "end": e} for n, s, e in new]
                done += len(part)
            kind = b.schema.field(b.num_columns - 1).type
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, kind)], schema=b.schema)
        tidy()

    return run


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found, with their columns."""
    return find_overlaps(docs, benchmark, **options).where(F.size("_items") == 0).drop("_items", "_spans")
