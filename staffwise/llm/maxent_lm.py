"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

``p(word | history) = p(class | history) p(word | class, history)``. Both factors are softmaxes whose
weights are looked up by a hash of (feature, outcome). Features of the class: the previous word
(bigram), the previous word with the class before it (trigram), and skips over one or two words;
feature of the word within its class: the class of the previous word. Start values are the unigram
model's logarithms.

Words with a count of at least ``N / HOT`` (there can't be more than ``HOT`` of them, whatever the
corpus) are *hot*: they are the outcomes of the word softmax, fall into classes of equal mass by
falling count, and are broadcast. All other words, and words never seen, are one further class,
whose words share it by their counts, unseen ones with the mass of the words seen once. Their counts
are joined by Spark, so the vocabulary may be of any size.

Training reads every training text: a pass counts all (history, outcome) cells, of which there is a
bounded number, and each gradient update is a Spark job over these cells that sums the expected
feature counts under the present weights; the driver holds the weights (a fixed number) only. Texts are scored
in numpy batches; a history's class distribution is computed from its few hashed features when a
batch first holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored, tidy

HOT = 1 << 17            # bound of the words that have an outcome of their own
CLASSES = 32             # the last one: rare and unseen words
RARE, START = CLASSES - 1, CLASSES
PREVIOUS = 256           # buckets of the previous word: 0 start, 255 rare, the commonest words alone
ALONE = 192
SECOND, THIRD = 17, 5    # coarser classes of the two words before, and the start
HISTORIES = PREVIOUS * SECOND * THIRD
CLASS_BITS, WORD_BITS = 17, 19
FEATURES = 5
STEPS = 8                # gradient updates
PRIOR = 1.0              # pull of the weights towards 0
TASKS = 12               # tasks of an update: the cells are bounded, see above
KEY_BYTES = 48           # longer words go by a digest
SLICE = 1 << 14
PIECE_BYTES = 32 << 20
END = ""                 # key of the end token; no word is empty
LN10 = float(np.log(10))


# ---------------------------------------------------------------- tokens

def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about PIECE_BYTES (one text at least), so memory follows bytes and not rows."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, side="right")))
        yield at, texts.slice(at, to - at)
        at, done = to, int(sizes[to - 1])


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(keys, codes, starts)``: distinct token keys, each token's key, and where each text begins.

    A-Z is lower-cased, words are runs of anything but blanks (20, 09-0D), each text ends with END.
    """
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), sizes)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = coded.dictionary.cast(pa.large_string())
    long = np.flatnonzero(pc.greater(pc.binary_length(words), KEY_BYTES).to_numpy(zero_copy_only=False)) if len(words) else []
    if len(long):
        names = words.to_pylist()
        for i in long:
            names[i] = " " + hashlib.md5(names[i].encode()).hexdigest()
        words = pa.array(names, pa.large_string())
    keys = pa.concat_arrays([words, pa.array([END], pa.large_string())])
    codes = np.full(len(doc) + len(texts), len(words), dtype=np.int64)
    codes[np.arange(len(doc)) + doc] = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.searchsorted(doc, np.arange(len(texts))) + np.arange(len(texts))
    return keys, codes, starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _pieces(batch.column(0)):
            keys, codes, _ = tokens(texts)
            n = np.bincount(codes, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(n)], names=["key", "c"])
    tidy()


# ---------------------------------------------------------------- the model

def _hash(kind: int, feature: np.ndarray, outcome: np.ndarray, bits: int) -> np.ndarray:
    x = (feature.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (outcome.astype(np.uint64) + np.uint64(kind + 1)
                                                                       ) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(7) & np.uint64((1 << bits) - 1)).astype(np.int64)


def features(history: np.ndarray) -> list[np.ndarray]:
    """The class features of histories: bigram, trigram, skip, longer skip, and both skips together."""
    first, second, third = history // (SECOND * THIRD), history // THIRD % SECOND, history % THIRD
    return [first, first * SECOND + second, second, third, second * THIRD + third]


def class_cells(history: np.ndarray) -> np.ndarray:
    """Weight indices, ``FEATURES x histories x CLASSES``."""
    y = np.arange(CLASSES)
    return np.stack([_hash(k, f[:, None], y[None, :], CLASS_BITS) for k, f in enumerate(features(history))])


def word_cells(previous: int, first: int, last: int) -> np.ndarray:
    """Weight indices of the words ``first .. last - 1`` after a word of class ``previous``."""
    ranks = np.arange(first, last)
    return (1 << CLASS_BITS) + _hash(FEATURES, np.full(len(ranks), previous), ranks, WORD_BITS)


@dataclass
class Model:
    total: int                    # training tokens (N)
    distinct: int                 # distinct ones (V)
    once: int                     # those seen once
    least: int                    # count from which a word is hot
    keys: pa.Array                # hot words by falling count
    counts: np.ndarray
    bounds: np.ndarray = None     # class c is the ranks bounds[c] .. bounds[c + 1] - 1
    weights: np.ndarray = None
    class_bias: np.ndarray = None
    word_bias: np.ndarray = None
    norms: np.ndarray = None      # log normaliser of (previous class, class)
    _known: np.ndarray = field(default=None, repr=False)
    _table: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        mass = self.counts.sum()
        middle = np.cumsum(self.counts) - self.counts / 2
        cls = np.minimum((middle * RARE // max(mass, 1)).astype(int), RARE - 1)
        self.bounds = np.searchsorted(cls, np.arange(CLASSES))
        sizes = np.diff(self.bounds)
        per = np.array([self.counts[a:b].sum() for a, b in zip(self.bounds, self.bounds[1:])] + [self.total - mass], dtype=float)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log((per + 1) / (self.total + CLASSES))
            self.class_bias[:RARE][sizes == 0] = -np.inf
            self.word_bias = np.log(self.counts / np.repeat(per[:RARE], sizes)) if mass else np.zeros(0)
        # by rank; the last two entries: rare, start
        cls = np.concatenate([cls, [RARE, START]])
        ranks = np.arange(len(cls) - 2)
        first = np.where(ranks < ALONE, ranks + 1, ALONE + 1 + _hash(9, ranks, ranks, 30) % (PREVIOUS - ALONE - 2))
        self.cls, self.first = cls, np.concatenate([first, [PREVIOUS - 1, 0]])
        self.second = np.where(cls == START, SECOND - 1, cls // 2)
        self.third = np.where(cls == START, THIRD - 1, cls // 8)
        self.weights = np.zeros((1 << CLASS_BITS) + (1 << WORD_BITS))

    @property
    def rare_total(self) -> float:
        """Normaliser of the rare class: its tokens, and one for each word seen once and for the unseen."""
        return float(self.total - self.counts.sum() + self.once + 1)

    def class_log(self, history: np.ndarray) -> np.ndarray:
        x = self.class_bias + self.weights[class_cells(history)].sum(axis=0)
        top = x.max(axis=1, keepdims=True)
        return x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True))

    def word_log(self, previous: int, cls: int) -> tuple[np.ndarray, np.ndarray, float]:
        """``(indices, logits, log normaliser)`` of a class's words after a word of class ``previous``."""
        a, b = self.bounds[cls], self.bounds[cls + 1]
        at = word_cells(previous, a, b)
        x = self.word_bias[a:b] + self.weights[at]
        if a == b:
            return at, x, 0.0
        return at, x, float(x.max() + np.log(np.exp(x - x.max()).sum()))

    def finish(self) -> "Model":
        self.norms = np.array([[self.word_log(p, c)[2] for c in range(RARE)] for p in range(START + 1)])
        return self

    def known_classes(self, history: np.ndarray) -> np.ndarray:
        """Log class distributions of histories, each computed when it is first met in this process."""
        if self._table is None:
            self._known, self._table = np.zeros(HISTORIES, dtype=bool), np.zeros((HISTORIES, CLASSES), dtype=np.float32)
        new = np.unique(history[~self._known[history]])
        for part in np.array_split(new, len(new) // 4096 + 1):
            if len(part):
                self._table[part] = self.class_log(part)
                self._known[part] = True
        return self._table

    def read(self, keys: pa.Array, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(rank, history, class of the previous word)`` of each token; rank ``len(keys)`` is rare."""
        rare, start = len(self.keys), len(self.keys) + 1
        found = pc.fill_null(pc.index_in(keys, value_set=self.keys), rare).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = found[codes]
        before = [np.full(len(rank), start, dtype=np.int64) for _ in range(3)]
        place = np.arange(len(rank)) - np.repeat(starts, np.diff(np.append(starts, len(rank))))
        for k, w in enumerate(before, 1):
            w[k:][place[k:] >= k] = rank[:-k][place[k:] >= k] if len(rank) > k else []
        history = (self.first[before[0]] * SECOND + self.second[before[1]]) * THIRD + self.third[before[2]]
        return rank, history, self.cls[before[0]]


def _gather(shared):
    """Counts of all (history, class) and (previous class, class, word) cells of a task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hot = len(model.keys)
        by_class = np.zeros(HISTORIES * CLASSES, dtype=np.int64)
        by_word = np.zeros((START + 1) * max(hot, 1), dtype=np.int64)
        for batch in batches:
            for _, texts in _pieces(batch.column(0)):
                rank, history, previous = model.read(*tokens(texts))
                by_class += np.bincount(history * CLASSES + model.cls[rank], minlength=len(by_class))
                is_hot = rank < hot
                if is_hot.any():
                    by_word += np.bincount(previous[is_hot] * hot + rank[is_hot], minlength=len(by_word))
        for kind, cells in ((0, by_class), (1, by_word)):
            at = np.flatnonzero(cells)
            if kind == 0:
                x, y = at // CLASSES, at % CLASSES
            else:
                x, y = at // max(hot, 1) * CLASSES + model.cls[at % max(hot, 1)], at % max(hot, 1)
            for part in np.array_split(np.arange(len(at)), len(at) // 100_000 + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, dtype=np.int32)), pa.array(x[part].astype(np.int32)),
                     pa.array(y[part].astype(np.int32)), pa.array(cells[at[part]])], names=["kind", "x", "y", "n"])
        del by_class, by_word
        tidy()
    return run


def _sums(shared, observed: bool):
    """A task's feature counts, observed or expected under the weights, in slices; slice -1: the log likelihood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        out, likelihood = np.zeros(len(model.weights)), 0.0
        for batch in batches:
            kind, xs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.asarray(batch.column(2).offsets)
            cells = batch.column(2).values
            ys, ns = (cells.field(f).to_numpy(zero_copy_only=False) for f in ("y", "n"))
            rows = np.flatnonzero(kind == 0)
            if len(rows):
                dense = np.zeros((len(rows), CLASSES))
                for i, r in enumerate(rows):
                    dense[i, ys[ends[r]:ends[r + 1]]] = ns[ends[r]:ends[r + 1]]
                at, logs = class_cells(xs[rows].astype(np.int64)), model.class_log(xs[rows].astype(np.int64))
                seen = dense > 0
                likelihood += (dense[seen] * logs[seen]).sum()
                if not observed:
                    dense = dense.sum(axis=1, keepdims=True) * np.exp(logs)
                out += np.bincount(at.ravel(), weights=np.broadcast_to(dense, at.shape).ravel(), minlength=len(out))
            where, what = [], []
            for r in np.flatnonzero(kind == 1):
                previous, cls = divmod(int(xs[r]), CLASSES)
                at, logits, norm = model.word_log(previous, cls)
                y, n = ys[ends[r]:ends[r + 1]] - model.bounds[cls], ns[ends[r]:ends[r + 1]]
                likelihood += (n * (logits[y] - norm)).sum()
                where.append(at[y] if observed else at)
                what.append(n.astype(float) if observed else n.sum() * np.exp(logits - norm))
            if where:
                out += np.bincount(np.concatenate(where), weights=np.concatenate(what), minlength=len(out))
        slices = [out[i:i + SLICE].astype(np.float32).tobytes() for i in range(0, len(out), SLICE)]
        yield pa.RecordBatch.from_pydict({"slice": [-1, *range(len(slices))], "data": [np.float64(likelihood).tobytes(), *slices]},
                                         schema=pa.schema([("slice", pa.int32()), ("data", pa.binary())]))
    return run


def _add(table: pa.Table) -> pa.Table:
    kind = np.float64 if table["slice"][0].as_py() == -1 else np.float32
    total = sum(np.frombuffer(d, dtype=kind).astype(float) for d in table["data"].to_pylist())
    return pa.table({"slice": table["slice"][:1], "data": pa.array([total.tobytes()], pa.binary())})


def _collected(cells: DataFrame, model: Model, observed: bool) -> tuple[np.ndarray, float]:
    shared = cells.sparkSession.sparkContext.broadcast(model)  # HOT keys of KEY_BYTES and a fixed number of weights
    rows = {r["slice"]: np.frombuffer(bytes(r["data"])) for r in
            cells.mapInArrow(_sums(shared, observed), "slice int, data binary").groupBy("slice")
            .applyInArrow(_add, "slice int, data binary").collect()}
    shared.unpersist()
    return np.concatenate([rows[i] for i in range(len(rows) - 1)]), float(rows[-1][0])


def fit(texts: DataFrame, vocabulary: DataFrame, steps: int = STEPS, hot: int = HOT) -> Model | None:
    """A model of all ``texts`` (one column) whose token counts are ``vocabulary`` (key, c); None without texts."""
    n = vocabulary.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first()
    if not n[0]:
        return None
    least = max(2, -(-n[0] // hot))
    top = vocabulary.where(F.col("c") >= least).toArrow()  # at most `hot` rows, since their counts add up to N
    keys, counts = top["key"].combine_chunks().cast(pa.large_string()), top["c"].to_numpy()
    order = np.lexsort((np.array(keys.to_pylist(), dtype=object), -counts)) if len(counts) else np.zeros(0, dtype=int)
    model = Model(int(n[0]), int(n[1]), int(n[2]), int(least), keys.take(pa.array(order)), counts[order])
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cells, path = stored(
        texts.mapInArrow(_gather(shared), "kind int, x int, y int, n bigint").groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))
        .groupBy("kind", "x").agg(F.collect_list(F.struct("y", "n")).alias("cells"))  # outcomes of a history: CLASSES or `hot`
        .repartition(TASKS, "kind", "x"), "lm-cells")
    observed, _ = _collected(cells, model, True)
    share = np.where(np.arange(len(observed)) < 1 << CLASS_BITS, FEATURES, 1)
    start, move, rate, best = model.weights, None, 1.0, -np.inf
    for _ in range(steps):
        expected, likelihood = _collected(cells, model, False)
        if likelihood >= best:
            start, best = model.weights, likelihood
            # gradient over a bound of the curvature: each outcome carries `share` weights
            move = np.clip((observed - expected - PRIOR * start) / (share * expected + PRIOR), -0.7, 0.7)
        else:
            rate /= 2
        model.weights = start + rate * move
    if _collected(cells, model, False)[1] < best:
        model.weights = start
    forget(spark, path)
    return model.finish()


# ---------------------------------------------------------------- scores

def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hot = len(model.keys)
        for batch in batches:
            for at, texts in _pieces(batch.column(1)):
                keys, codes, starts = tokens(texts)
                rank, history, previous = model.read(keys, codes, starts)
                is_hot = rank < hot
                log = model.known_classes(history)[history, model.cls[rank]].astype(float)
                base = np.zeros(len(rank))
                if is_hot.any():
                    r, p = rank[is_hot], previous[is_hot]
                    cell = (1 << CLASS_BITS) + _hash(FEATURES, p, r, WORD_BITS)
                    log[is_hot] += model.word_bias[r] + model.weights[cell] - model.norms[p, model.cls[r]]
                    base[is_hot] = np.log10(model.counts[r] + 1)
                log[~is_hot] -= np.log(model.rare_total)
                base -= np.log10(model.total + model.distinct + 1)
                # rare tokens: (text, key) pairs with their number, their counts are joined later
                doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rank))))
                pairs, n = np.unique(doc[~is_hot] * len(keys) + codes[~is_hot], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(starts) + 1) * len(keys))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [keys.take(pa.array(pairs % len(keys))).cast(pa.string()), pa.array(n)], names=["key", "k"]))
                add = lambda v: pa.array(np.add.reduceat(v, starts))  # noqa: E731  each text has a token, its end
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), add(np.ones(len(rank), dtype=np.int64)), add(is_hot.astype(np.int64)),
                     add(base), add(log / LN10), rare], names=["_row", "n_tokens", "n_hot", "base", "log", "rare"])
        tidy()
    return run


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          steps: int = STEPS, hot: int = HOT) -> DataFrame:
    """``id, learnt, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The model and the counts come from the rows for which ``learn`` is true (null: not learnt). A null
    text is empty, an empty one has its end token; repeated rows and null or repeated ids are rows
    like any other, and other columns are ignored. If there is nothing to learn from, each token has
    probability 1 (there is one event, the unseen word): both scores are 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learnt"), F.col(text_col).alias("text"))
    texts = rows.where("learnt").select("text")
    vocabulary, _ = stored(texts.mapInArrow(_count, "key string, c bigint").groupBy("key").agg(F.sum("c").alias("c")), "lm-vocabulary")
    model = fit(texts, vocabulary, steps, hot) or Model(
        0, 0, 0, 2, pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64)).finish()
    shared = spark.sparkContext.broadcast(model)
    key = F.struct("id", "learnt", F.monotonically_increasing_id().alias("row"))
    kind = "struct<id:{},learnt:boolean,row:bigint>".format(docs.schema[id_col].dataType.simpleString())
    parts, _ = stored(rows.select(key.alias("_row"), "text").mapInArrow(
        _score(shared), f"_row {kind}, n_tokens bigint, n_hot bigint, base double, log double, "
        "rare array<struct<key:string,k:bigint>>").select("_row.*", "n_tokens", "n_hot", "base", "log", "rare"), "lm-parts")
    # no key here has more than a HOT-th of the training tokens; a word unseen in training may, AQE splits its join
    rare = (parts.select("row", F.explode("rare").alias("t")).select("row", "t.key", "t.k")
            .join(vocabulary.where(F.col("c") < model.least), "key", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"),
                                F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base_rare"),
                                F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(model.once + 1)))).alias("log_rare")))
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("rare").join(rare, "row", "left").select(
        "id", "learnt", "n_tokens", (F.col("n_hot") + some("known")).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + some("base_rare")).alias("base_score"), (F.col("log") + some("log_rare")).alias("score"))
