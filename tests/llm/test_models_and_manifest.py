"""Whitening, the Merkle manifest and the language model against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staffwise.llm import maxent_lm, merkle, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, n long, whitened string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 whitening

@pytest.mark.parametrize("name", ["random", "equal", "rank", "clusters", "zero", "blocks", "graded", "one"])
def test_principal_components(name):
    rng = np.random.default_rng(1)
    turned = lambda d: (lambda q: q @ np.diag(d) @ q.T)(np.linalg.qr(rng.normal(size=(len(d), len(d))))[0])
    z = rng.normal(size=(40, 40))
    a = {"random": z @ z.T, "equal": np.eye(20), "rank": z[:, :3] @ z[:, :3].T, "zero": np.zeros((5, 5)), "one": np.array([[3.0]]),
         "clusters": turned([5, 5, 5, 4, 4 - 1e-9, 4 - 1e-12, 1, 1, 1, 0.5]), "blocks": np.kron(np.eye(4), [[2.0, 1], [1, 2]]),
         "graded": turned(10.0 ** -np.arange(12))}[name]
    values, vectors = whitening.principal_components(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert len(values) == {"rank": 3, "zero": 0, "one": 1}.get(name, 8)
    top = max(want[0], 1e-300)
    assert np.abs(values - want[:len(values)]).max(initial=0) < 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-13
    assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-13 * top


def brute_whitening(vectors, k):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), z @ axes / np.sqrt(values), values / np.trace(z.T @ z / n)


def same_up_to_sign(got, want):
    return all(min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-6 for g, w in zip(got.T, want.T))


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 50
    data = [(i, list(map(float, v)), 7, "clash") for i, v in enumerate(good)]
    data[3] = (None, *data[3][1:])
    data[5] = (4, *data[5][1:])           # a repeated id
    data.append((6, *data[6][1:]))        # a repeated row
    bad = [(900, None, 1, ""), (901, [float("nan")] * 12, 1, ""), (902, [1.0] * 11 + [None], 1, ""),
           (903, [float("inf")] + [0.0] * 11, 1, ""), (904, [], 1, "")]
    got = whitening.whiten(spark.createDataFrame(data + bad, VECTORS).repartition(5)).toPandas()
    vectors = np.array([v for _, v, *_ in data])
    deviation, white, explained = brute_whitening(vectors, 8)
    assert sorted(str(i) for i in got["id"].fillna(-1).astype(int)) == sorted(str(-1 if i is None else i) for i, *_ in data)
    order = {int(d): j for j, d in enumerate(deviation)}
    at = [order[int(d)] for d in got["deviation"]]
    assert len(set(at)) == 300 and set(got["n"]) == {301}
    assert same_up_to_sign(np.array(list(got["whitened"])), white[at])
    assert np.allclose(got["explained"][0], explained, rtol=1e-9) and got["identity_error"].max() < 1e-9


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).collect() == [] and whitening.whiten(frame([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame([(1, [0.5, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"]) for r in one] == [(1, 0, [])]
    flat = whitening.whiten(frame([(k, [1.0, float(k % 2), 1.0]) for k in range(10)])).collect()
    assert all(len(r["whitened"]) == 1 and abs(abs(r["whitened"][0]) - 1) < 1e-12 for r in flat)  # two constant dimensions
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame([(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_deviation_beyond_64_bits():
    x = np.array([[100000 + 2 ** 40, 3], [5, 100000]])
    n, sums = 10 ** 9, [123456789012345678901, 99]
    assert whitening._deviation(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def test_whitening_query(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF).toPandas()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).toPandas()
    deviation, white, explained = brute_whitening(np.array(list(vectors["embedding"])), 8)
    got = got.sort_values(["vec_id", "component"])
    vectors = vectors.reset_index().sort_values("vec_id")
    at = vectors["index"].to_numpy()
    assert len(got) == 8 * len(vectors) and got["deviation_exact"].isna().all()
    assert got["deviation"].to_numpy().reshape(-1, 8)[:, 0].tolist() == deviation[at].tolist()
    assert same_up_to_sign(got["whitened"].to_numpy().reshape(-1, 8), white[at])
    assert np.allclose(got["explained"].to_numpy()[:8], explained, rtol=1e-4) and got["identity_error"].max() < 1e-4


# 12 Merkle manifest

def plain_tree(digests):
    """``(root, witnesses)``, all in one list."""
    level, witness = [(d, [i]) for i, d in enumerate(digests)], [[] for _ in digests]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 16):
            run = [d for d, _ in level[k:k + 16]]
            for i, (_, members) in enumerate(level[k:k + 16]):
                for m in members:
                    witness[m].append(("".join(run[:i]), "".join(run[i + 1:])))
            above.append((sha("".join(run)), [m for _, ms in level[k:k + 16] for m in ms]))
        level = above
    return level[0][0], witness


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 600])
def test_appender_is_a_tree(n):
    digests = [sha(str(i)) for i in range(n)]
    stream = merkle.Appender()
    for d in digests:
        stream.append(d)
    assert (stream.finish(), stream.witnesses) == plain_tree(digests)


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def test_manifest_against_plain_trees(spark):
    rows = [(i or None, s, f"Text {i % 7} é" if i % 11 else None, "x") for s, n in
            [(None, 3), ("", 2), ("a", 1), ("b", 17), ("hot", 5000), ("c", 256), ("d", 257), ("é", 16)] for i in range(n)]
    rows += [(1, "b", "again", "x")] * 40 + [(9, f"s{i}", "", "x") for i in range(300)]  # repeated rows, many groups
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, grp string").repartition(7)
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    out = merkle.manifest(df.withColumn("leaf", leaf), "source", "doc_id", "leaf")
    assert out.columns == ["doc_id", "source", "text", "grp", "leaf", "pos", "witness", "subroot", "root"]
    out = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("witness"))).withColumn("all", merkle.siblings(F.col("witness")))
    by = {}
    for d, s, t, _ in rows:
        by.setdefault(s, []).append((d is not None, d or 0, sha(value(d) + value(s) + value(t))))
    trees = {s: plain_tree([x[2] for x in sorted(v)]) for s, v in by.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = plain_tree([trees[s][0] for s in order])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = trees[r["source"]][1][r["pos"]] + above[order.index(r["source"])]
        assert [tuple(w) for w in r["witness"]] == want and r["all"] == "".join(a + b for a, b in want)
        assert r["leaf"] == sorted(by[r["source"]])[r["pos"]][2]
        assert (r["subroot"], r["root"], r["folded"]) == (trees[r["source"]][0], root, root)


def test_manifest_edges(spark):
    kind = "doc_id long, source string, leaf string"
    assert merkle.manifest(spark.createDataFrame([], kind), "source", "doc_id", "leaf").collect() == []
    one = merkle.manifest(spark.createDataFrame([(None, None, sha("x"))], kind), "source", "doc_id", "leaf").collect()
    assert [(r["witness"], r["subroot"], r["root"]) for r in one] == [([], sha("x"), sha("x"))]


def test_manifest_query_finds_tampering(spark):
    got = queries.QUERIES["op12_merkle_manifest"](spark, SF).collect()
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(text) and len({r["root"] for r in got}) == 1
    for r in got:
        t = text[r["doc_id"]]
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and t is not None and re.search("[A-Z]", t)
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])


# 13 language model

LM = "doc_id long, text string, id string, learnt boolean"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def test_tokens_of_odd_texts():
    texts = ["Hello  WORLD\tx\x0bÉé \x1c y　z", None, "", " ", "x" * 60 + " a", "\n lead trail \r", "\x00 é" * 3]
    keys, codes, starts = maxent_lm.tokens(pa.array(texts))
    for text, a, b in zip(texts, starts, [*starts[1:], len(codes)]):
        assert [keys[int(i)].as_py() for i in codes[a:b]] == [
            w if len(w.encode()) <= maxent_lm.KEY_BYTES else " " + hashlib.md5(w.encode()).hexdigest() for w in words(text)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = [" ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} rare{rng.randrange(3000)}" for _ in range(rng.randrange(1, 20)))
             for _ in range(400)]
    texts += [None, "", "  ", "word " * 30_000, "y" * 100_000, "unseen only here", texts[0], texts[0]]
    return [(i if i % 50 else None, t, "x", None) for i, t in enumerate(texts)]


def test_base_score_and_counts(spark, corpus):
    df = spark.createDataFrame(corpus, LM).repartition(3)
    got = maxent_lm.score(df.withColumn("n", F.lit(1)), F.col("doc_id") % 7 != 2, steps=2, hot=200).toPandas()
    train = [w for d, t, *_ in corpus if d is not None and d % 7 != 2 for w in words(t)]
    c, n = {w: 0 for w in train}, len(train)
    for w in train:
        c[w] += 1
    want = sorted((-1 if d is None else d, len(words(t)), sum(w in c for w in words(t)),
                   round(sum(math.log10((c.get(w, 0) + 1) / (n + len(c) + 1)) for w in words(t)), 4)) for d, t, *_ in corpus)
    rows = sorted((-1 if math.isnan(r.id) else int(r.id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got.itertuples())
    assert rows == want and set(got["train_tokens"]) == {n}


def test_model_is_normalised_and_scores_by_its_formula(spark, corpus):
    df = spark.createDataFrame(corpus, LM)
    texts = df.where("doc_id % 7 <> 2").select("text")
    counts = {}
    for (t,) in texts.collect():
        for w in words(t):
            w = w if len(w) <= maxent_lm.KEY_BYTES else " " + hashlib.md5(w.encode()).hexdigest()
            counts[w] = counts.get(w, 0) + 1
    vocabulary = spark.createDataFrame(list(counts.items()), "key string, c long")
    model = maxent_lm.fit(texts, vocabulary, steps=3, hot=400)
    hot = model.keys.to_pylist()
    assert set(hot) == {w for w, n in counts.items() if n >= model.least} and 0 < len(hot) <= 400 < len(counts)

    def prob(word, before):
        """log10 p(word | the three words before), feature by feature."""
        ids = [len(hot) + 1 if w is None else hot.index(w) if w in hot else len(hot) for w in before]
        history = np.array([(model.first[ids[0]] * maxent_lm.SECOND + model.second[ids[1]]) * maxent_lm.THIRD + model.third[ids[2]]])
        rank = hot.index(word) if word in hot else len(hot)
        logits = [model.class_bias[y] + sum(model.weights[maxent_lm._hash(k, f, np.array([y]), maxent_lm.CLASS_BITS)[0]]
                                            for k, f in enumerate(maxent_lm.features(history))) for y in range(maxent_lm.CLASSES)]
        out = logits[model.cls[rank]] - math.log(sum(math.exp(x) for x in logits))
        if rank == len(hot):
            rare = sum(n for n in counts.values() if n < model.least)
            return (out + math.log(counts.get(word, model.once + 1) / (rare + model.once + 1))) / math.log(10)
        previous, cls = int(model.cls[ids[0]]), int(model.cls[rank])
        inner = [model.word_bias[r] + model.weights[maxent_lm.word_cells(previous, r, r + 1)[0]]
                 for r in range(model.bounds[cls], model.bounds[cls + 1])]
        return (out + inner[rank - model.bounds[cls]] - math.log(sum(math.exp(x) for x in inner))) / math.log(10)

    every = [*counts, "never seen"]
    for before in [(None, None, None), ("the", "rare7", "v3"), ("never seen", "the", None)]:
        assert abs(sum(10 ** prob(w, before) for w in every) - 1) < 1e-6
    got = maxent_lm.score(df, F.col("doc_id") % 7 != 2, steps=3, hot=400).toPandas()
    scores = {int(r.id): r.score for r in got.itertuples() if not math.isnan(r.id)}
    for d, t, *_ in corpus:
        if d in (1, 2, 9, 30, 401, 404, 405):
            w = words(t)
            w = [x if len(x) <= maxent_lm.KEY_BYTES else " " + hashlib.md5(x.encode()).hexdigest() for x in w]
            want = sum(prob(x, [w[i - k] if i >= k else None for k in (1, 2, 3)]) for i, x in enumerate(w))
            assert scores[d] == pytest.approx(want, abs=1e-3), d


def test_training_learns_and_edges(spark, corpus):
    df = spark.createDataFrame(corpus, LM)
    got = maxent_lm.score(df, F.col("doc_id") % 7 != 2).toPandas()
    fresh = got[~got["learnt"]]
    assert fresh["score"].sum() > fresh["base_score"].sum() + 0.3 * fresh["n_tokens"].sum()  # word order is worth much here
    nothing = maxent_lm.score(spark.createDataFrame([], LM), F.lit(True)).collect()
    assert nothing == []
    none = maxent_lm.score(df, F.lit(False)).toPandas()
    assert set(none["train_tokens"]) == {0} and none["score"].abs().max() < 1e-9 and none["base_score"].abs().max() < 1e-9


def test_lm_query(spark):
    got = queries.QUERIES["op13_lm_score"](spark, SF).toPandas()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in got["doc_id"]}
    assert (got["held_out"] == got["doc_id"].map(held)).all() and len(got) == len(held)
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()
