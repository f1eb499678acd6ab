"""Forest, stored models, quantile buckets and the classifier against planted signals and brute force."""

import collections
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffwise.operators import classifier as cf
from staffwise.operators import forest as fo
from staffwise.operators import models as mo
from staffwise.operators import quantiles as qb
from staffwise.session import scratch_path
from staffwise.sources.artefacts import Artefacts


def planted(spark, n=400):
    """y follows a strongly, b weakly; c is noise, d constant."""
    rng = np.random.default_rng(3)
    a, b, c = rng.uniform(0, 10, n), rng.uniform(0, 10, n), rng.uniform(0, 10, n)
    y = 50 + 9 * a + 4 * b + rng.normal(0, 0.3, n)
    rows = [("g", "train" if i % 4 else "test", *map(float, r)) for i, r in enumerate(zip(a, b, c, np.full(n, 2.0), y))]
    return spark.createDataFrame(rows, "g string, part string, a double, b double, c double, d double, y double")


def test_forest_finds_the_planted_features(spark):
    rows = planted(spark)
    got = fo.fit_forest(rows.where("part = 'train'"), ["a", "b", "c", "d"], "y", trees=20, depth=8)
    assert sum(got.importances.values()) == pytest.approx(1) and got.importances["d"] == 0
    assert got.features == ["a", "b"] and got.importances["a"] > got.importances["b"] > 0.05 > got.importances["c"]
    r2 = fo.scores(got, rows, "y")
    assert r2["train"][0] == 300 and r2["test"][0] == 100 and r2["train"][1] > r2["test"][1] > 0.9
    scored = got.model.transform(rows.where("part = 'test'")).select("y", "prediction").toPandas()
    e = scored["y"] - scored["prediction"]
    assert r2["test"][1] == pytest.approx(1 - (e * e).sum() / ((scored["y"] - scored["y"].mean()) ** 2).sum())


def test_forest_without_signal_or_rows(spark):
    rows = planted(spark).withColumn("y", F.lit(3.0))
    assert fo.fit_forest(rows, ["a", "b"], "y", trees=3, depth=3) is None
    assert fo.fit_forest(rows.limit(0), ["a", "b"], "y", trees=3, depth=3) is None


def test_stored_forest_predicts_the_same_and_effect_by_brute_force(spark):
    rows = planted(spark)
    got = fo.fit_forest(rows.where("part = 'train'"), ["a", "b", "c"], "y", trees=10, depth=6)
    store = Artefacts(spark, scratch_path(spark, "artefacts"))
    assert [store.save_model("forest/x", got.model), store.save_model("forest/x", got.model)] == [1, 2]
    assert store.versions("forest/x") == [1, 2] and store.versions("other") == []
    loaded = store.load_model("forest/x", 1)
    both = [sorted(map(tuple, m.transform(rows).select("y", "prediction").collect())) for m in (got.model, loaded)]
    assert both[0] == both[1]
    with pytest.raises(FileNotFoundError):
        store.load_model("forest/x", 3)

    week = rows.limit(7)
    effect = fo.staffing_effect(loaded, got.features, week, ["g"], [-50, 0, 30]).collect()
    assert len(effect) == 3 * len(got.features)
    mean = {f: week.agg(F.avg(f)).first()[0] for f in got.features}

    def one(values):
        return loaded.transform(spark.createDataFrame([values])).first()["prediction"]

    base = one(mean)
    for r in effect:
        want = one({**mean, r["feature"]: mean[r["feature"]] * (1 + r["change"] / 100)})
        assert r["base_staffing"] == pytest.approx(base) and r["new_staffing"] == pytest.approx(want)
        assert r["difference"] == pytest.approx(want - base) and (r["change"] != 0 or r["difference"] == 0)
        assert r["difference_pct"] == pytest.approx((want - base) / base * 100)
    assert fo.staffing_effect(loaded, got.features, week.limit(0), ["g"], [5]).collect() == []


def test_unpublished_artefacts_are_not_seen(spark):
    store = Artefacts(spark, scratch_path(spark, "artefacts"))
    with pytest.raises(ZeroDivisionError):
        store._save("t", lambda path: 1 / 0)  # a job that is lost while it writes
    assert store.versions("t") == []
    assert store.save_table("t", spark.range(3)) == 2 and store.load_table("t").count() == 3


def test_scaled_model_predicts_as_plain_least_squares(spark):
    rows = planted(spark)
    f = ["a", "b", "c", "d"]
    fitted = mo.Scaled.fit(rows, ["g"], f, "y")
    plain = rows.join(mo.fit_ols(rows, ["g"], f, "y"), ["g"]).withColumn("pred", mo.predict(f))
    got = sorted((r["y"], r["pred"]) for r in fitted.predict(rows, ["g"], f).collect())
    want = sorted((r["y"], r["pred"]) for r in plain.collect())
    assert np.allclose(got, want)
    z = mo.scale(rows, fitted.scaler, ["g"], f).toPandas()
    assert np.allclose(z[["a", "b", "c"]].mean(), 0) and np.allclose(z[["a", "b", "c"]].std(ddof=0), 1) and set(z["d"]) == {0.0}


# quantile buckets

def brute_buckets(values):
    """Edges, labels and bucket of each value, as written for one list."""
    k = min(5, len(set(values)))
    edges = sorted(set(round(float(q), 4) for q in np.quantile(values, [i / k for i in range(k + 1)])))
    labels = [f"{a:.2f}%+" if i == len(edges) - 2 else f"{a:.2f}%-{b:.2f}%" for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    if not labels:
        return [(None, None)] * len(values)
    return [next(((i, labels[i]) for i in range(len(labels)) if v < edges[i + 1]), (len(labels) - 1, labels[-1])) for v in values]


def test_quantile_buckets_by_brute_force(spark):
    rng = np.random.default_rng(2)
    groups = {"many": rng.gamma(2, 3, 200).round(3).tolist(), "few": [1.0, 2.0, 2.0, 3.0], "ties": [0.0] * 50 + [5.0, 6.0],
              "one": [4.0] * 5, "single": [1.5], None: [1.0, 9.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = collections.defaultdict(list)
    for r in qb.quantile_buckets(df, ["g"], "v").collect():
        if r["v"] is not None:
            got[r["g"]].append((r["v"], r["bucket"], r["label"], r["code"]))
        else:
            assert r["bucket"] is None and r["label"] is None and r["code"] is None
    for g, vs in groups.items():
        want = brute_buckets(vs)
        codes = {x: i for i, x in enumerate(sorted({lab for _, lab in want if lab}))}
        assert sorted(got[g], key=str) == sorted([(v, b, lab, codes.get(lab)) for v, (b, lab) in zip(vs, want)], key=str), g
    assert qb.quantile_buckets(df.limit(0), ["g"], "v").collect() == []
    assert len(qb.quantile_buckets(df, [], "v").collect()) == len(rows)  # one group of all rows


def test_sketch_edges_are_near_in_rank(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("v"))
    values = np.sort(np.array([r["v"] for r in df.collect()]))
    edges = qb.quantile_edges(df.repartition(7), ["g"], "v", sketch=True).first()["edges"]
    for i, e in enumerate(edges):
        rank = np.searchsorted(values, e) / len(values)
        assert abs(rank - i / 5) <= 2 / qb.ACCURACY


# classifier

@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        q2 = float(rng.uniform(0, 50))
        rows.append(("x", dt.date(2024, 1, 1) + dt.timedelta(i), q2, *map(float, rng.uniform(1, 9, 4)), q2 / 10 + float(rng.normal(0, 0.05))))
    df = spark.createDataFrame(rows, "g string, date date, q2 double, demand double, staffing double, requirement double, "
                                     "occ_assumption double, abn_pct double")
    rows = cf.classifier_rows(df, ["g"]).cache()
    return rows, cf.fit_classifier(rows, {"maxDepth": [1, 5], "numTrees": [10]})


def test_stratified_parts_and_folds(spark, fitted):
    rows = fitted[0].toPandas()
    assert len(rows) == 600 and rows["label"].nunique() == 5
    for _, c in rows.groupby("code"):
        assert (c["part"] == "test").sum() == round(0.2 * len(c))
        folds = c.loc[c["part"] == "train", "fold"].value_counts()
        assert sorted(folds.index) == [0, 1, 2] and folds.max() - folds.min() <= 1 and set(c.loc[c["part"] == "test", "fold"]) == {-1}
    small = spark.createDataFrame([(0.0, i) for i in range(3)] + [(1.0, 9)], "code double, id long")
    ranked = cf.class_rank(small, "code", ["id"]).collect()
    assert sorted((r["code"], r["rank"], r["n"]) for r in ranked) == [(0.0, 0, 3), (0.0, 1, 3), (0.0, 2, 3), (1.0, 0, 1)]


def test_class_report_by_brute_force(fitted):
    rows, model = fitted
    assert model.folds == 3 and model.params["maxDepth"] == 5
    pairs = [(r["code"], r["prediction"]) for r in model.scored.collect()]
    report = {r["class"]: r for r in cf.class_report(model).collect()}
    for code, label in model.labels.items():
        tp = sum(a == b == code for a, b in pairs)
        called, support = sum(b == code for _, b in pairs), sum(a == code for a, _ in pairs)
        p, rec = tp / called if called else 0.0, tp / support
        r = report[label]
        assert (r["precision"], r["recall"], r["support"]) == (pytest.approx(p), pytest.approx(rec), support)
        assert r["f1"] == pytest.approx(2 * p * rec / (p + rec) if p + rec else 0.0)
    hits = sum(a == b for a, b in pairs) / len(pairs)
    assert report["accuracy"]["f1"] == pytest.approx(hits) and hits > 0.8
    assert report["weighted avg"]["recall"] == pytest.approx(hits) and report["macro avg"]["support"] == len(pairs)
    means = [report[x]["f1"] for x in model.labels.values()]
    assert math.isclose(report["macro avg"]["f1"], sum(means) / 5)


def test_transitions_add_up(fitted):
    rows, model = fitted
    got = cf.transitions(model, [0, 50]).collect()
    n = rows.where("part = 'test'").count()
    sums = collections.Counter()
    for r in got:
        sums[r["feature"], r["change"]] += r["n"]
        assert r["change"] != 0 or r["before"] == r["after"]
    assert set(sums.values()) == {n} and len(sums) == 2 * len(cf.FEATURES)
    assert any(r["before"] != r["after"] for r in got if r["feature"] == "q2" and r["change"] == 50)


def test_a_classifier_needs_two_classes(spark):
    rows = spark.createDataFrame([("x", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 2.0)] * 3,
                                 "g string, date date, q2 double, demand double, staffing double, requirement double, "
                                 "occ_assumption double, abn_pct double")
    with pytest.raises(ValueError):
        cf.fit_classifier(cf.classifier_rows(rows, ["g"]))


def test_classes_too_small_for_folds(spark):
    rows = [("x", dt.date(2024, 1, 1) + dt.timedelta(i), float(i), 1.0, 1.0, 1.0, 1.0, float(i > 0)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, date date, q2 double, demand double, staffing double, requirement double, "
                                     "occ_assumption double, abn_pct double")
    parts = cf.classifier_rows(df, ["g"])
    got = cf.fit_classifier(parts, {"maxDepth": [2], "numTrees": [3]}) if parts.select("code").distinct().count() > 1 else None
    assert got is None or got.folds == 0
