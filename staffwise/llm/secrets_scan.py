"""Secret scans: known forms, and sliding-window entropy over candidate strings.

Known forms (assignments, access keys, long hexadecimal strings) are matched as patterns. Beside
them, every run of key characters is a candidate. Over each stretch of one character class
(hexadecimal, base 64, letters) a window of fixed width slides; its Shannon entropy comes from
counts that change by one character in and one out. Windows that reach the class's bound are merged into
spans. The allow list then works on what is hot, not on the run around it: a window that touches a
placeholder, a counting sequence or an identifier of another kind is not hot, and a span that consists of
words between separators is dropped. Texts are scanned row by row in their own partition, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20

WIDTH = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WIDTH},}}")
#: Character classes: name, stretches, least entropy in bits of a window of WIDTH characters, and what it must mix.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0, "digits"),
           ("base64", re.compile(r"[A-Za-z0-9+/_-]{20,}"), 3.7, "digits"),
           ("letters", re.compile(r"[A-Za-z]{20,}"), 3.9, "cases"))
CASE_CHANGES = 9  # in a window of letters: words that are written together change it less often
#: Parts that no secret has: identifiers of other kinds, placeholders, counting sequences.
HARMLESS = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|example|sample|placeholder|changeme|xxxx|0123456789|123456789|abcdefgh", re.I)
#: Words between separators, each with a few digits at its end.
WORDS = re.compile(r"([A-Za-z]+[0-9]{0,4}[/_+=-]+)*[A-Za-z]+[0-9]{0,4}")
SEPARATORS = "/_+=-"
LOG = [0.0] + [c * math.log2(c) for c in range(1, WIDTH + 2)]  # one in before one out
KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


def hot_windows(s: str, least: float, width: int = WIDTH, mix: str = "digits", harmless=()) -> list[tuple[int, int]]:
    """Merged windows of ``s`` whose Shannon entropy reaches ``least`` bits, that mix digits and letters ("digits") or
    change case often ("cases"), and that touch none of the ``harmless`` spans."""
    counts: dict[str, int] = {}
    total, digits, changes, out = 0.0, 0, 0, []
    free = 0  # windows that begin before it touch a harmless span
    waiting = list(harmless)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += LOG[n + 1] - LOG[n]
        counts[c] = n + 1
        digits += c in "0123456789"
        changes += i > 0 and c.isupper() != s[i - 1].isupper()
        if i >= width:
            old = s[i - width]
            n = counts[old]
            total += LOG[n - 1] - LOG[n]
            counts[old] = n - 1
            digits -= old in "0123456789"
            changes -= s[i - width + 1].isupper() != old.isupper()
        while waiting and waiting[0][0] <= i:
            free = max(free, waiting.pop(0)[1])
        lo = i - width + 1
        mixed = 0 < digits < width if mix == "digits" else changes >= CASE_CHANGES
        if lo >= free and mixed and math.log2(width) - total / width >= least - 1e-12:
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy that are not on the allow list."""
    found = []
    for m in CANDIDATE.finditer(text):
        lo, run = m.start(), m[0]
        harmless = [h.span() for h in HARMLESS.finditer(run)]
        hot = []
        for _, pattern, least, mix in CLASSES:
            for part in pattern.finditer(run):
                at = part.start()
                near = [(a - at, b - at) for a, b in harmless if b > at and a < part.end()]
                hot += [(at + a, at + b, mix) for a, b in hot_windows(part[0], least, WIDTH, mix, near)]
        merged: list[list] = []
        for a, b, mix in sorted(hot):
            if merged and a <= merged[-1][1]:
                merged[-1][1:] = [max(b, merged[-1][1]), merged[-1][2] | {mix}]
            else:
                merged.append([a, b, {mix}])
        for a, b, mixes in merged:
            first, last = a, b  # with the rest of the words at its ends
            while first > 0 and run[first - 1] not in SEPARATORS:
                first -= 1
            while last < len(run) and run[last] not in SEPARATORS:
                last += 1
            if "cases" in mixes or not WORDS.fullmatch(run[first:last].strip(SEPARATORS)):
                found.append((lo + a, lo + b))
    return found


def known_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known forms, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS[s[0]]))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` in code points, by start and then kind."""
    text = text or ""
    return sorted(known_spans(text) + [("entropy", a, b) for a, b in entropy_spans(text)],
                  key=lambda s: (s[1], KINDS[s[0]], s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` with structs kind, start, end; one row per input row.

    Null and empty texts have no spans, ids may be null or repeat, other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["id", "spans"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, "
                                "spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``find_secrets``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("entropy").alias("n_entropy"))
