"""Joint and grouped logistic fits against Spark's own, one at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from scorelens.functions.vectors import nonzero_slots
from scorelens.operators import logistic
from scorelens.operators.minimise import Minimiser
from scorelens.plans import models

WIDTH = 6


def rows_of(count, seed, groups=("a",)):
    """(id, group, bucket, vector): slot 4 is constant, slot 5 always zero; sparse and dense vectors."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        bucket = float(rng.randrange(3))
        values = [float(rng.randint(0, 3)), rng.gauss(bucket, 1), float(rng.random() < 0.1), rng.expovariate(1), 2.5, 0.0]
        vector = Vectors.dense(values) if i % 2 else Vectors.sparse(WIDTH, [(j, v) for j, v in enumerate(values) if v])
        out.append((i, groups[min(int(rng.expovariate(0.8)), len(groups) - 1)], bucket, vector))
    return out


def frame(spark, rows):
    schema = StructType([
        StructField("id", LongType()), StructField("grp", StringType()),
        StructField("score_bucket", DoubleType()), StructField("features", VectorUDT()),
    ])
    return spark.createDataFrame(rows, schema).repartition(3)


def single(df, target, reg):
    binary = df.withColumn("y", (F.col("score_bucket") == target).cast("double"))
    return LogisticRegression(labelCol="y", regParam=reg, tol=1e-13, maxIter=500).fit(binary)


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark, rows_of(300, 1)).cache()


def test_columns_equal_single_fits(df):
    fits = [(t, r) for r in (0.05, 0.5, 4.0) for t in (0.0, 1.0, 2.0)]
    found = logistic.fit_columns(df, "score_bucket", "features", WIDTH, fits, tolerance=1e-9)
    for j, (target, reg) in enumerate(fits):
        model = single(df, target, reg)
        assert np.allclose(found.weights[:, j], model.coefficients.toArray(), atol=1e-6)
        assert math.isclose(found.intercepts[j], model.intercept, abs_tol=1e-6)
    assert (found.worst <= 1e-9).all() and (found.weights[4:] == 0).all()


def test_few_columns_at_once_give_the_same(df, monkeypatch):
    fits = [(0.0, 0.5), (1.0, 0.5), (2.0, 2.0)]
    whole = logistic.fit_columns(df, "score_bucket", "features", WIDTH, fits)
    monkeypatch.setattr(logistic, "LARGEST", 1)
    assert np.allclose(whole.weights, logistic.fit_columns(df, "score_bucket", "features", WIDTH, fits).weights, atol=1e-9)


def test_groups_equal_single_fits(spark, monkeypatch):
    """One group holds most rows; cells and blocks are small, so it is spread over several."""
    monkeypatch.setattr(logistic, "CELL_ROWS", 16)
    monkeypatch.setattr(logistic, "BLOCK", 2)
    df = frame(spark, rows_of(400, 2, ("big", "b", "c", "d"))).cache()
    rows = df.select("grp", (F.col("score_bucket") == 1.0).cast("double").alias("y"), nonzero_slots("features").alias("entries"))
    found = {r.grp: r for r in logistic.fit_groups(rows, ["grp"], 0.2, tolerance=1e-9).collect()}
    assert len(found) == df.select("grp").distinct().count()
    for grp, r in found.items():
        model = single(df.where(F.col("grp") == grp), 1.0, 0.2)
        weights = np.zeros(WIDTH)
        weights[r.known] = r.weights
        assert np.allclose(weights, model.coefficients.toArray(), atol=1e-6)
        assert math.isclose(r.intercept, model.intercept, abs_tol=1e-6)
    models_of = logistic.fit_groups(rows, ["grp"], 0.2)
    margins = logistic.margins_by_group(df.select("grp", "id", nonzero_slots("features").alias("entries")), models_of, ["grp"], ["id"])
    vectors = {r.id: r.features.toArray() for r in df.collect()}
    for r in margins.collect():
        model = found[r.grp]
        assert math.isclose(r.margin, model.intercept + vectors[r.id][model.known] @ np.array(model.weights), abs_tol=1e-4)


def test_groups_of_one_class_one_row_or_no_values(spark):
    rows = [("one", 1.0, [(0, 1.0)]), ("same", 0.0, [(0, 1.0)]), ("same", 0.0, [(0, 2.0)]), ("none", 1.0, []), ("none", 0.0, [])]
    df = spark.createDataFrame(rows, "grp string, y double, entries array<struct<slot:int,value:double>>")
    found = {r.grp: r for r in logistic.fit_groups(df, ["grp"], 0.5).collect()}
    assert found["one"].intercept > 5 and found["same"].intercept < -5
    assert list(found["none"].weights) == [] and abs(found["none"].intercept) < 1e-6
    assert logistic.fit_groups(df.where("false"), ["grp"], 0.5).count() == 0


def test_groups_fitted_whole_or_step_by_step(spark, monkeypatch):
    """Groups that a task can hold need no job per step; the answers are those of the steps that jobs take."""
    rows = [(g, float((i * 7 + len(g)) % 3 == 0), [(i % 4, 1.0 + i % 2), (5, float(i))]) for g in ("a", "bb") for i in range(30)]
    rows += [(None, 1.0, [(0, 1.0)]), ("empty", 1.0, []), ("empty", 0.0, [])]
    df = spark.createDataFrame(rows, "grp string, y double, entries array<struct<slot:int,value:double>>")
    found = {}
    for held in (0, 65, 2**24):  # none, one of the groups, all
        if held == 2**24:
            monkeypatch.setattr(logistic, "_sums", None)
        found[held] = {r.grp: r for r in logistic.fit_groups(df, ["grp"], 0.2, tolerance=1e-9, held=held).collect()}
        assert set(found[held]) == {"a", "bb", "empty"}
    for grp, r in found[0].items():
        for held in (65, 2**24):
            assert list(found[held][grp].known) == list(r.known)
            assert np.allclose([found[held][grp].intercept, *found[held][grp].weights], [r.intercept, *r.weights], atol=1e-6)


def test_bucket_model_keeps_its_buckets_when_saved(df, tmp_path):
    """A bucket without rows does not shift the others."""
    model = models.fit_logistic(df.where("score_bucket != 1.0"), 0.1)
    assert model.classes == (0.0, 2.0)
    answers = model.transform(df)
    assert {r.prediction for r in answers.select("prediction").distinct().collect()} <= {0.0, 2.0}
    assert "rawPrediction" not in answers.columns
    model.model.write().overwrite().save(str(tmp_path / "m"))
    again = models.BucketLogistic(LogisticRegressionModel.load(str(tmp_path / "m")), model.classes)
    assert again.transform(df).select("id", "prediction").exceptAll(answers.select("id", "prediction")).count() == 0


def test_one_bucket_alone(df):
    model = models.fit_logistic(df.where("score_bucket = 2.0"), 0.1)
    assert {r.prediction for r in model.transform(df).collect()} == {2.0}


def test_f1_is_that_of_spark(df):
    model = models.fit_logistic(df, 0.1)
    answers = model.transform(df)
    counts = {(r.score_bucket, r.prediction): r["count"] for r in answers.groupBy("score_bucket", "prediction").count().collect()}
    judge = MulticlassClassificationEvaluator(labelCol="score_bucket", predictionCol="prediction", metricName="f1")
    assert math.isclose(models.f1_of_counts(counts), judge.evaluate(answers))


def test_steps_survive_being_written():
    centre = np.array([3.0, -1.0, 0.5])
    scale = np.array([1.0, 100.0, 0.01])
    steps, written = (Minimiser(np.zeros(3), 1e-9) for _ in range(2))
    while not steps.done:
        for m in (steps, written):
            gap = m.trial - centre
            m.feed(float(scale @ gap**2), 2 * scale * gap)
        written = Minimiser.loads(written.dumps())
        assert np.array_equal(written.trial, steps.trial)
    assert written.done and np.allclose(steps.x, centre, atol=1e-6)
