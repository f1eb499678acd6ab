"""Classifier of the abandon-rate bucket: grid search with stratified folds, class report, transitions
(ML12, ML13, SCN18).

The rows of the chosen groups, of all languages together, are the classifier's table. Shares of a class
(held-out part, folds) are dealt by a rank within the class in the order of a hash; the rank comes from counts per hash range, so
that no task sorts a whole class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffwise.constants import FOREST_SEED
from staffwise.operators import quantiles as qb

FEATURES = ["q2", "demand", "staffing", "requirement", "occ_assumption"]
TARGET = "abn_pct"
TEST_SHARE, MAX_FOLDS = 0.2, 3
GRID = {"maxDepth": [3, 5], "numTrees": [100, 200], "subsamplingRate": [0.8, 1.0]}
CHANGES = [-50, -20, -10, 0, 10, 20, 50]
RANGES = 64  # hash ranges of a class


def model_rows(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all features and the target."""
    return hist.select(*keys, "date", *FEATURES, TARGET).na.drop(subset=[*FEATURES, TARGET])


def class_rank(df: DataFrame, cls: str, row_keys: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``n`` of its rows within their class, in the order of a hash of ``row_keys``."""
    h = F.xxhash64(*row_keys)
    rows = df.withColumns({"_h": h, "_range": F.pmod(F.shiftrightunsigned(h, 32), F.lit(RANGES))})
    counts = rows.groupBy(cls, "_range").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(cls)  # at most RANGES rows a class
    counts = counts.select(F.col(cls).alias("_cls"), F.col("_range").alias("_r"), F.sum("_c").over(w).alias("n"), (
        F.sum("_c").over(w.orderBy("_range")) - F.col("_c")).alias("_before"))
    inner = Window.partitionBy(cls, "_range").orderBy("_h", *row_keys)
    return (rows.withColumn("_i", F.row_number().over(inner) - 1)
            .join(counts, F.col(cls).eqNullSafe(F.col("_cls")) & (F.col("_range") == F.col("_r")))
            .withColumn("rank", F.col("_i") + F.col("_before")).select(*df.columns, "rank", "n"))


def classifier_rows(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The table of the classifier: features, bucket label and code over all rows, ``part`` and ``fold``.

    A fifth of every class is held out (at least one row if a class has two); a class of one row is all
    training. The training rows of a class are dealt evenly to up to three folds, as many as the smallest
    class has rows; with fewer than two there are no folds (-1).
    """
    rows = qb.quantile_buckets(model_rows(hist, keys), [], TARGET).where("code IS NOT NULL")
    ranked = class_rank(rows.select(*keys, "date", *FEATURES, TARGET, "label", F.col("code").cast("double").alias("code")), "code",
                        [*keys, "date"])
    held = F.when(F.col("n") < 2, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("n") * TEST_SHARE))).cast("long")
    ranked = ranked.withColumn("_held", held).withColumn("part", F.when(F.col("rank") < F.col("_held"), "test").otherwise("train"))
    least = ranked.groupBy().agg(F.min(F.col("n") - F.col("_held")).alias("_least"))  # one row
    k = F.least(F.lit(MAX_FOLDS), F.col("_least"))
    fold = F.when((F.col("part") == "train") & (k >= 2),
                  F.floor((F.col("rank") - F.col("_held")) * k / (F.col("n") - F.col("_held")))).otherwise(-1).cast("int")
    return ranked.crossJoin(F.broadcast(least)).withColumn("fold", fold).select(
        *keys, "date", *FEATURES, TARGET, "label", "code", "part", "fold")


@dataclass
class Fitted:
    model: PipelineModel
    params: dict[str, float]
    folds: int
    scored: DataFrame          # the held-out rows with ``prediction``
    labels: dict[float, str]   # code -> label, at most one per bucket


def fit_classifier(rows: DataFrame, grid: dict[str, list] = GRID) -> Fitted:
    """ML13: the grid's best parameters by mean accuracy over the folds, fitted on all training rows.
    Without folds, the grid's first parameters are used."""
    labels = {r["code"]: r["label"] for r in rows.select("code", "label").distinct().collect()}  # one per bucket
    if len(labels) < 2:
        raise ValueError("a classifier needs two classes")
    tree = RandomForestClassifier(featuresCol="x", labelCol="code", seed=FOREST_SEED)
    flow = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), tree])
    train = rows.where("part = 'train'").cache()
    folds = train.agg(F.max("fold")).first()[0] + 1
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(getattr(tree, name), values)
    settings = build.build()
    best = settings[0]
    if folds >= 2:
        search = CrossValidator(estimator=flow, estimatorParamMaps=settings, numFolds=folds, foldCol="fold", parallelism=4,
                                evaluator=MulticlassClassificationEvaluator(labelCol="code", metricName="accuracy"))
        found = search.fit(train)
        best, model = settings[max(range(len(settings)), key=lambda i: (found.avgMetrics[i], -i))], found.bestModel
    else:
        model = flow.fit(train, best)
    train.unpersist()
    return Fitted(model, {p.name: v for p, v in best.items()}, max(folds, 0), model.transform(rows.where("part = 'test'")), labels)


def class_report(fitted: Fitted) -> DataFrame:
    """Precision, recall, F1 and support per class of the held-out rows, and their plain and weighted means and the accuracy."""
    spark = fitted.scored.sparkSession
    pairs = fitted.scored.groupBy("code", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()  # classes squared
    total = sum(r["n"] for r in pairs)
    rows = []
    for code in sorted({r["code"] for r in pairs}):
        hit = sum(r["n"] for r in pairs if r["code"] == r["prediction"] == code)
        support = sum(r["n"] for r in pairs if r["code"] == code)
        called = sum(r["n"] for r in pairs if r["prediction"] == code)
        precision, recall = hit / called if called else 0.0, hit / support
        rows.append((fitted.labels[code], precision, recall, 2 * hit / (support + called), support))
    if rows:
        means = [[sum(r[i] * w for r, w in zip(rows, ws)) / sum(ws) for i in (1, 2, 3)]
                 for ws in ([1] * len(rows), [r[4] for r in rows])]
        rows += [("macro avg", *means[0], total), ("weighted avg", *means[1], total)]
        accuracy = sum(r["n"] for r in pairs if r["code"] == r["prediction"]) / total
        rows.append(("accuracy", accuracy, accuracy, accuracy, total))
    settings = ", ".join(f"{k}={v}" for k, v in sorted(fitted.params.items()))
    return spark.createDataFrame([(*r, settings, fitted.folds) for r in rows],
                                 "class string, precision double, recall double, f1 double, support long, params string, folds int")


def transitions(fitted: Fitted, changes: list[int] = CHANGES) -> DataFrame:
    """SCN18: ``feature, change, before, after, n``: every held-out row predicted with one feature changed by a percentage.
    The counts of a feature and change add up to the held-out rows."""
    test = fitted.scored.select(*FEATURES, F.col("prediction").alias("_before"))
    moved = test.select("*", F.explode(F.array(*map(F.lit, FEATURES))).alias("feature")).select(
        "*", F.explode(F.array(*(F.lit(float(c)) for c in changes))).alias("change")).withColumns(
        {f: F.when(F.col("feature") == f, F.col(f) * (1 + F.col("change") / 100.0)).otherwise(F.col(f)) for f in FEATURES})
    name = F.create_map(*(F.lit(x) for pair in fitted.labels.items() for x in pair))
    return fitted.model.transform(moved).groupBy("feature", "change", name[F.col("_before")].alias("before"),
                                                 name[F.col("prediction")].alias("after")).agg(F.count(F.lit(1)).alias("n"))
