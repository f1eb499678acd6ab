"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A writer who disguises a word replaces letters by look-alike signs, puts separators between them or
repeats them. Each suspicious span of a text becomes a lattice: every character offers itself, the
letters it may stand for, or nothing (a separator, a repeat), each at a channel cost. Viterbi
decoding finds the cheapest path under a character trigram model whose counts come from all
documents; a boundary is a symbol of the model, so decoded words start and end like words.

Two things open a lattice. Signs beside letters, letters written three times and runs of single letters
are suspicious in any text, whatever the words; the classifier is fitted on the text that they give. A
doubled letter or a single separator stands in many plain words and gaps. There a lattice is opened
wherever one of its paths can spell a word of the classifier: texts and words are reduced to skeletons
(separators dropped, repeats collapsed, look-alikes folded), and the words' skeletons are searched for in
the text's. Only such words change a score, so no other doubled letter or gap needs a lattice. A word
that plain neighbours often spell by chance ("los ta") is no evidence then: clean labelled rows in which
it is decoded from such a place count against it there.

The classifier is a logistic regression over words and word beginnings of the restored text, fitted by
Spark on labelled rows that are stored once, restored, equal texts as one row. Its vocabulary is what stands
in toxic rows far more often than in all rows, by the lower end of a Wilson interval; support counts distinct
neighbour pairs, not documents, so that near copies of one text don't vouch for a word. The evidence of all
distinct entries that a text holds adds up, and the score is the regression's probability. Words of one writer
stand together, so a regression spreads their evidence; a text with a single one of them still scores no less than
the lower end of that word's own rate, if it is strong. Only strong entries, those whose rate alone says toxic, open
lattices at doubled letters and gaps.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidy

ALPHABET = " abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœßúùûüÿý"  # symbol 0 is any non-letter
SIZE = 64
OTHER = len(ALPHABET)  # letters of other scripts share one symbol
#: Fixed values of the channel: letters that a sign may stand for, and costs in nats.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = " .-_*~·'`"
SWAP, DROP, REPEAT, KEEP_SIGN, BREAK = 0.7, 0.7, 0.7, 4.0, 2.5

SAMPLE = 20_000  # labelled rows that the classifier is fitted on at most
MIN_SUPPORT = 5
MIN_RATE = 0.6  # of a strong entry
BEGINNING_RATE = 0.9  # of strong word beginnings, which other words share
LIFT = 2.0  # an entry's rate in toxic rows against that of all rows
RIDGE = 0.7  # squared weights cost half of this, against the log loss summed over the labelled rows
SURE = 1e-9  # probabilities are kept this far from 0 and 1
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
Z = 1.96
FLUSH = 400_000  # features a task holds before it passes them on
BLOCK = 1 << 20  # characters whose trigrams are counted at once
REMEMBER, REMEMBER_CHARS = 50_000, 200  # decoded spans that a worker remembers, and the longest of them

LETTER, SIGN, SEPARATOR = 1, 2, 4
BARRIER = "\n"  # in a skeleton: any sign that is no letter, look-alike or separator


def _table(value, dtype) -> np.ndarray:
    return np.array([value(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x10000)], dtype)


SYMBOL = _table(lambda c: ALPHABET.find(c) if c in ALPHABET else OTHER * c.isalpha(), np.uint8)
KIND = _table(lambda c: LETTER * c.isalpha() | SIGN * (c in LOOKALIKES) | SEPARATOR * (c in SEPARATORS), np.uint8)

#: Skeleton letter of each character, 0 for separators; l and i are one letter, since signs stand for both.
FOLDED = _table(lambda c: 0 if c in SEPARATORS else ord("i" if c == "l" else c) if c.isalpha()
                else ord(LOOKALIKES[c][0]) if c in LOOKALIKES else ord(BARRIER), np.uint16)
FOLDED[0] = ord(BARRIER)


def codes(text: str) -> np.ndarray:
    """Code points, those beyond the basic plane as zero."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(a < 0x10000, a, 0)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts: a cube of SIZE^3 cells, bounded whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)

        def count(block: list[str]) -> None:
            s = SYMBOL[codes("  ".join(["", *block, ""]).lower())].astype(np.int32)
            total[:] += np.bincount(s[:-2] * SIZE * SIZE + s[1:-1] * SIZE + s[2:], minlength=SIZE ** 3)

        for b in batches:
            block, held = [], 0
            for t in b.column(0):
                text = t.as_py() or ""
                block.append(text)
                held += len(text)
                if held > BLOCK:
                    count(block)
                    block, held = [], 0
            count(block)
        at = np.flatnonzero(total)
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = (docs.select(text_col).mapInArrow(run, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())  # at most SIZE^3 rows
    cube = np.zeros(SIZE ** 3)
    cube[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return cube


def log_model(cube: np.ndarray, k: float = 5.0) -> np.ndarray:
    """``cost[a, b, c]``: minus log P(c | a, b), trigrams backed by bigrams backed by symbols."""
    tri = cube.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + k * p1) / (bi.sum(1, keepdims=True) + k)
    p3 = (tri + k * p2) / (tri.sum(2, keepdims=True) + k)
    return -np.log(p3).astype(np.float32)


@dataclass
class Model:
    """cost: the character model; weights: word -> probability of a text that holds only it, or "beginning*" ->
    the same; base: that of a text that holds none; rates: strong entry -> the least score of a text that holds it;
    hidden: the same for entries decoded from places that only a known word makes suspicious (None: all, no least score)."""
    cost: np.ndarray
    weights: dict[str, float]
    base: float
    rates: dict[str, float] = field(default_factory=dict)
    hidden: dict[str, float] | None = None


def logit(p: float) -> float:
    p = min(max(p, SURE), 1 - SURE)
    return math.log(p / (1 - p))


def probability(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -700.0), 700.0)))


def spans(text: str) -> list[tuple[int, int]]:
    """Where a lower-case text looks disguised: signs inside words, letters written three times or set apart."""
    a = codes(text)
    if len(a) < 3:
        return []
    kind = KIND[a]
    letter, sign = (kind & LETTER) > 0, (kind & SIGN) > 0
    near = np.zeros(len(a), bool)
    near[1:] |= letter[:-1]
    near[:-1] |= letter[1:]
    marks = [np.flatnonzero(sign & near)]
    marks.append(np.flatnonzero(letter[2:] & (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2])))
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    # runs of three or more single letters, with gaps of any length: nothing but separators between them
    solid = np.flatnonzero((kind & SEPARATOR) == 0)
    single = np.concatenate(([False], alone[solid], [False])).astype(np.int8)
    first, last = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1) - 1
    set_apart = [(int(solid[i]), int(solid[j]) + 1) for i, j in zip(first, last) if j - i >= 2]
    if not sum(map(len, marks)) and not set_apart:
        return []
    blank = np.flatnonzero(~(letter | sign | ((kind & SEPARATOR) > 0)) | (a == 32))
    found = []
    at = np.unique(np.concatenate(marks))
    left = np.searchsorted(blank, at)
    for p, i in zip(at, left):
        found.append((int(blank[i - 1]) + 1 if i else 0, int(blank[i]) if i < len(blank) else len(a)))
    found += set_apart
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(found)):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        elif lo < hi:
            out.append((lo, hi))
    return out


def skeleton(text: str) -> tuple[str, np.ndarray]:
    """The skeleton of a lower-case text, and where in the text each of its characters stands."""
    folded = FOLDED[codes(text)]
    at = np.flatnonzero(folded)
    folded = folded[at]
    if len(at):
        new = np.concatenate(([True], folded[1:] != folded[:-1]))
        at, folded = at[new], folded[new]
    return folded.astype("<u2").tobytes().decode("utf-16-le"), at


def restore_span(span: str, cost: np.ndarray, plain: bool = False) -> str:
    """Viterbi path through the lattice of one span; states are the last two symbols put out.

    In a ``plain`` span, which nothing but a known word makes suspicious, blanks and signs without a
    letter beside them are usual and cost nothing to keep.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for i, ch in enumerate(span):
        usual = plain and not ch.isalpha() and (ch == " " or not any(c.isalpha() for c in span[max(0, i - 1):i + 2]))
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options.append((ch, 0.0))
            if ch == before:
                options.append(("", REPEAT))
        else:
            options += [(c, SWAP) for c in LOOKALIKES.get(ch, "")]
            if ch in SEPARATORS:
                options.append(("", DROP))
                options.append((ch, 0.0 if usual else BREAK))
            else:
                options.append((ch, 0.0 if usual else KEEP_SIGN))
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (x, y), (c, path) in states.items():
            for out, extra in options:
                if out:
                    o = ord(out)
                    s = int(SYMBOL[o]) if o < 0x10000 else (OTHER if out.isalpha() else 0)
                    key, total, trail = (y, s), c + extra + float(cost[x, y, s]), (path, out)
                else:
                    key, total, trail = (x, y), c + extra, path
                if key not in new or total < new[key][0]:
                    new[key] = (total, trail)
        states, before = new, ch
    best = min(states.items(), key=lambda kv: (kv[1][0] + float(cost[kv[0][0], kv[0][1], 0]), kv[0]))[1][1]
    out = []
    while best:
        best, ch = best
        out.append(ch)
    return "".join(reversed(out))


class Scorer:
    """Restores and scores texts in one Python worker."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.base = logit(model.base)
        self.evidence = {key: logit(w) - self.base for key, w in model.weights.items()}
        self.strong = dict.fromkeys(model.weights, 0.0) if model.hidden is None else model.hidden
        self.words = ahocorasick.Automaton() if model.weights else None
        for key in model.weights:
            part = key.rstrip("*")
            _, whole, start = self.words.get(part, (len(part), False, False))
            self.words.add_word(part, (len(part), whole or key == part, start or key != part))
        self.skeletons, self.aliases = ahocorasick.Automaton() if self.strong else None, {}
        for key in self.strong:
            part = key.rstrip("*")
            bones = skeleton(part)[0]
            n, forms = self.skeletons.get(bones, (len(bones), set()))
            self.skeletons.add_word(bones, (n, forms | {part}))
            if key == part and (clear := restore_span(part, model.cost)) != part:  # its own double letters
                self.aliases.setdefault(clear, []).append(key)
        if self.words is not None:
            self.words.make_automaton()
        if self.skeletons is not None:
            self.skeletons.make_automaton()

    def clear(self, span: str, plain: bool = False) -> str:
        if (clear := self.seen.get((span, plain))) is None:
            clear = restore_span(span, self.model.cost, plain)
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            if len(span) <= REMEMBER_CHARS:
                self.seen[span, plain] = clear
        return clear

    def restore(self, text: str) -> tuple[str, int]:
        """The lower-case text with its suspicious spans decoded, and how many of them changed."""
        text = text.lower()
        out, last, changed = [], 0, 0
        for lo, hi in spans(text):
            span = text[lo:hi]
            clear = self.clear(span)
            out += [text[last:lo], clear]
            last, changed = hi, changed + (clear != span)
        return "".join([*out, text[last:]]), changed

    def hidden(self, text: str) -> list[str]:
        """Parts of a lower-case text that a path of the lattice may turn into a known word, those spelled plainly left out."""
        if self.skeletons is None:
            return []
        bones, at = skeleton(text)
        found = set()
        for end, (n, forms) in self.skeletons.iter(bones):
            lo, hi = int(at[end - n + 1]), int(at[end]) + 1
            if lo and text[lo - 1].isalpha():
                continue
            single = not text[lo + 1:lo + 2].isalpha()
            before = text[max(0, lo - 64):lo].rstrip(SEPARATORS) if single else ""
            if before and before[-1].isalpha() and not before[-2:-1].isalpha():
                continue  # inside a run of single letters, which has a lattice of its own
            while hi < len(text) and text[hi].isalpha():
                hi += 1
            span = text[lo:hi]
            if not any(span.startswith(f) for f in forms):
                found.add((lo, hi))
        return [text[lo:hi] for lo, hi in sorted(found)]

    def known(self, clear: str) -> Iterator[str]:
        """The words and beginnings of the classifier that stand in a clear text."""
        for end, (n, whole, start) in self.words.iter(clear) if self.words is not None and clear else ():
            lo = end - n + 1
            if lo and clear[lo - 1].isalpha():
                continue
            more = end + 1 < len(clear) and clear[end + 1].isalpha()
            if start if more else whole:
                yield clear[lo:end + 1] + "*" * more

    def decoded(self, text: str) -> list[tuple[str, list[str]]]:
        """The hidden parts of a lower-case text that decode to known words, with those words."""
        out = []
        for span in self.hidden(text):
            clear = self.clear(span, plain=True)
            if clear != span:
                keys = {*self.known(clear), *(k for w in WORD.findall(clear) for k in self.aliases.get(w, ()))}
                if keys:
                    out.append((span, sorted(keys)))
        return out

    def score(self, text: str | None) -> tuple[float, int]:
        text = (text or "").lower()
        clear, changed = self.restore(text)
        held = set(self.known(clear))
        least = max((self.model.rates.get(k, 0.0) for k in held), default=0.0)
        for span, keys in self.decoded(text):
            if strong := [self.strong[k] for k in keys if k in self.strong]:
                changed += not spans(span)
                held.update(keys)
                least = max(least, *strong)
        return max(least, probability(self.base + math.fsum(self.evidence[k] for k in held))), changed


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def wilson(k: float, n: float) -> float:
    """Lower end of the Wilson interval of a rate."""
    p = k / n
    return (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the ``sample`` labelled ids of smallest hash; the character model uses all texts.

    Labels that are not 0 or 1 and null ids are ignored; of contradicting labels of an id the larger
    counts. With rows of one label only the model knows no words and every text gets the same low score.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cost = log_model(trigram_counts(docs, text_col))
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    known = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
             .join(F.broadcast(chosen), "id").select(F.lower("text").alias("text"), F.col("y").cast("int"))  # at most ``sample`` ids
             .dropDuplicates(["text", "y"]))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(cost, {}, 0.0))
        for b in batches:
            clear = pa.array([scorer.restore(t.as_py())[0] for t in b.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), clear, b.column(1)], ["text", "clear", "y"])
        tidy()

    rows, path = stored(known.mapInArrow(restored, "text string, clear string, y int"), "toxicity-rows")
    number = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = number.get(1, 0), number.get(0, 0)
    nothing = 0.1 * (n1 + 0.5) / (n1 + n0 + 1)
    if not n1 or not n0:
        forget(spark, path)
        return Model(cost, {}, nothing)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def sums() -> pa.RecordBatch:
            keys = list(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()),
                 pa.array([n[0][k] for k in keys], pa.int64())], ["feature", "n1", "n0"])
            n[0].clear()
            n[1].clear()
            return out

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                n[y].update({f for w in set(WORD.findall(text.as_py())) for f in features(w)})
                if len(n[0]) + len(n[1]) > FLUSH:
                    yield sums()
        yield sums()
        tidy()

    sums = rows.select("clear", "y").mapInArrow(counted, "feature string, n1 long, n0 long").groupBy("feature").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    least = min(MIN_RATE, LIFT * n1 / (n1 + n0))
    often = sums.where((F.col("n1") >= MIN_SUPPORT) & (F.col("n1") >= least * (F.col("n1") + F.col("n0"))))
    got = {r.feature: (r.n1, r.n0) for r in often.collect()}  # bounded by the sample
    candidates = frozenset(got)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text in b.column(0):
                words = ["", *WORD.findall(text.as_py()), ""]
                for i in range(1, len(words) - 1):
                    for f in features(words[i]):
                        if f in candidates:
                            seen.add((f, xxhash.xxh64_intdigest(f"{words[i - 1]} {words[i + 1]}") >> 1))
            out = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()),
                                              pa.array([r[1] for r in out], pa.int64())], ["feature", "context"])

    vocabulary, support = [], {}
    if candidates:
        varied = (rows.where("y = 1").select("clear").mapInArrow(contexts, "feature string, context long").distinct()
                  .groupBy("feature").count().collect())
        for r in varied:
            k = min(r["count"], got[r.feature][0])
            if k >= MIN_SUPPORT and (w := wilson(k, k + got[r.feature][1])) >= least:
                vocabulary.append(r.feature)
                if w >= strong_rate(r.feature):
                    support[r.feature] = k
    if not vocabulary:
        forget(spark, path)
        return Model(cost, {}, nothing)
    base, weights = regression(rows, sorted(vocabulary), n1 + n0)

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, n = Scorer(Model(cost, dict.fromkeys(support, 1.0), 0.0)), Counter()
        for b in batches:
            for text in b.column(0):
                n.update({k for _, keys in scorer.decoded(text.as_py()) for k in keys})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])
        tidy()

    by_chance = {} if not support else {
        r.feature: r.n for r in rows.where("y = 0").select("text").mapInArrow(chances, "feature string, n long")
        .groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # bounded by the vocabulary
    forget(spark, path)
    rates = {f: wilson(k, k + got[f][1]) for f, k in support.items()}
    hidden = {f: w for f, k in support.items() if (w := wilson(k, k + got[f][1] + by_chance.get(f, 0))) >= strong_rate(f)}
    return Model(cost, weights, base, rates, hidden)


def strong_rate(feature: str) -> float:
    return BEGINNING_RATE if feature.endswith("*") else MIN_RATE


def regression(rows: DataFrame, vocabulary: list[str], n: int) -> tuple[float, dict[str, float]]:
    """Logistic regression of ``y`` on the entries that each of the ``n`` ``clear`` texts holds: the probability
    of a text without any, and of one with a single entry."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(None, dict.fromkeys(vocabulary, 1.0), 0.0, hidden={}))
        for b in batches:
            keys = [sorted(set(scorer.known(t.as_py()))) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.string())), b.column(1)], ["keys", "y"])

    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="keys", outputCol="x")
    data, path = stored(rows.select("clear", F.col("y").cast("double")).mapInArrow(held, "keys array<string>, y double"), "toxicity-keys")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", regParam=RIDGE / n, standardization=False).fit(counted.transform(data))
    forget(data.sparkSession, path)
    b = fitted.intercept
    return probability(b), {f: probability(b + w) for f, w in zip(vocabulary, fitted.coefficients.toArray().tolist())}


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
          keep: bool = False) -> DataFrame:
    """``(id, score, predicted, n_restored)``, one row per input row; a null text counts as empty.

    With ``keep`` the rows that are not predicted toxic come back whole, as the input's columns.
    Ids may be null or repeat; other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) if not keep else docs
    at = slim.columns.index(text_col if keep else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            got = [scorer.score(t.as_py()) for t in b.column(at)]
            if keep:
                yield b.filter(pa.array([s < threshold for s, _ in got], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([s for s, _ in got], pa.float64()),
                     pa.array([int(s >= threshold) for s, _ in got], pa.int32()),
                     pa.array([c for _, c in got], pa.int64())], ["id", "score", "predicted", "n_restored"])
        tidy()

    return slim.mapInArrow(run, slim.schema if keep else
                           f"id {slim.schema['id'].dataType.simpleString()}, score double, predicted int, n_restored long")
