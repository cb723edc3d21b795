"""Fits over a feature frame: `score_double` or `score_bucket` from `features`.

Every function takes and returns Spark ML objects; the numbers it reports are
computed by Spark over the whole frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    LogisticRegressionModel,
    NaiveBayes,
    NaiveBayesModel,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.scores import squared_error
from scorelens.operators import blocked, least_squares, logistic
from scorelens.operators.evaluate import accuracy, regression_errors
from scorelens.operators.splits import RANDOM_SEED, TEST, TRAIN, TUNING_PERCENT, hash_split, test_part, train_part
from scorelens.plans.stages import HELD_TERMS, classifier_model, linear_model

SCORE, BUCKET = "score_double", "score_bucket"

# What the stochastic mode does unless told otherwise.
SGD_STEPS, SGD_STEP_SIZE, SGD_BATCH_PERCENT = 100, 1.0, 100

# The regularisation grid, none and 2^-3 ... 2^3.
REG_GRID = (0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)

# Fits that run side by side: each is a sequence of whole-table passes, so a
# few of them keep the executors busy between passes.
PARALLEL_FITS = 4


def _linear(reg: float = 0.0, **params) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=SCORE, regParam=reg, **params)


def fit_linear(train: DataFrame, reg: float = 0.0) -> LinearRegressionModel | blocked.WrittenLinearModel:
    """Spark's own fit, which holds a few dozen numbers per slot on the driver; above HELD_TERMS slots the weights stay a table."""
    width = vector_width(train)
    if width > HELD_TERMS:
        return blocked.fit_linear(train, SCORE, "features", width, reg)
    return _linear(reg).fit(train)


def fit_sgd(
    train: DataFrame, steps: int = SGD_STEPS, step_size: float = SGD_STEP_SIZE, batch_percent: int = SGD_BATCH_PERCENT
) -> LinearRegressionModel:
    """Unregularised least squares by seeded stochastic gradient steps with a decaying length.

    Features are standardised for the steps; over raw counts of hundreds of
    characters a first step of this size would overflow.
    """
    found = least_squares.stochastic_steps(train, SCORE, "features", vector_width(train), steps, step_size, batch_percent)
    return linear_model(*found)


def fit_linear_path(train: DataFrame, regs: Sequence[float]) -> list[LinearRegressionModel]:
    """A model for every penalty, from the passes of one fit."""
    return [linear_model(*f) for f in least_squares.solve_path(train, SCORE, "features", vector_width(train), regs)]


def rmse(model, test: DataFrame) -> float:
    return regression_errors(model.transform(test)).first()["rmse"]


def bucket_accuracy(model, test: DataFrame) -> float:
    return accuracy(model.transform(test)).first()["accuracy"]


@dataclass(frozen=True)
class Tuned:
    model: object
    reg_param: float
    metrics: tuple[float, ...]


def tuning_split(train: DataFrame, key: str = "id") -> DataFrame:
    """Which training rows a penalty is fitted on and which it is judged on; follows from the key alone."""
    return hash_split(train, TUNING_PERCENT, key, salt="tuning-")


def _errors_of_path(path: Sequence[LinearRegressionModel], rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, errors): the root mean squared error of every model, from one pass."""
    scored = rows.select(*by, SCORE, "features")
    for i, model in enumerate(path):
        scored = model.setPredictionCol(f"p{i}").transform(scored)
    errors = [F.sqrt(F.avg(squared_error(F.col(SCORE), F.col(f"p{i}")))) for i in range(len(path))]
    return scored.groupBy(*by).agg(F.array(*errors).alias("errors"))


def fit_ridge(train: DataFrame, regs: Sequence[float] = REG_GRID) -> Tuned:
    """Linear regression, the penalty chosen by validation RMSE.

    All penalties are fitted on the tuning part in the passes of one fit and
    judged on the rest in one more; the best is fitted on all training rows.
    """
    parts = tuning_split(train)
    path = fit_linear_path(train_part(parts), regs)
    found = _errors_of_path(path, test_part(parts)).first()["errors"]
    metrics = tuple(math.nan if e is None else e for e in found)
    best = min(range(len(metrics)), key=lambda i: (math.isnan(metrics[i]), metrics[i]))
    return Tuned(fit_linear_path(train, [regs[best]])[0], float(regs[best]), metrics)


def regularisation_path(
    parts: DataFrame, regs: Sequence[float] = REG_GRID
) -> list[tuple[float, float, float]]:
    """(reg_param, train_rmse, test_rmse) of every penalty.

    `parts` has a `part` column. One fit's passes give all models, and one pass
    over all rows measures them on both parts.
    """
    path = fit_linear_path(train_part(parts), regs)
    by_part = {row["part"]: row["errors"] for row in _errors_of_path(path, parts, ["part"]).collect()}
    nothing = [math.nan] * len(path)
    return list(
        zip(map(float, regs), by_part.get(TRAIN, nothing), by_part.get(TEST, nothing), strict=True)
    )


def fit_forest(train: DataFrame, seed: int = RANDOM_SEED, **params):
    return RandomForestRegressor(featuresCol="features", labelCol=SCORE, seed=seed, **params).fit(train)


def one_vs_rest(classifier) -> OneVsRest:
    return OneVsRest(
        classifier=classifier, featuresCol="features", labelCol=BUCKET, parallelism=PARALLEL_FITS
    )


def fit_one_vs_rest(train: DataFrame, classifier) -> OneVsRestModel:
    """One binary fit per bucket, for any classifier."""
    return one_vs_rest(classifier).fit(train.select(BUCKET, "features"))


@dataclass(frozen=True)
class BucketLogistic:
    """One logistic fit per bucket; a row goes to the bucket with the largest margin.

    `model` is Spark's own classifier with a row of weights per bucket, so
    scoring stays in the JVM; `classes` are the buckets that its classes stand for.
    """

    model: LogisticRegressionModel
    classes: tuple[float, ...]

    @property
    def weights(self) -> dict[float, np.ndarray]:
        return dict(zip(self.classes, self.model.coefficientMatrix.toArray()))

    @property
    def intercepts(self) -> dict[float, float]:
        return dict(zip(self.classes, self.model.interceptVector.toArray().tolist()))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        labels = F.array(*map(F.lit, self.classes))
        number = f"{output}_number"
        numbered = self.model.copy().setPredictionCol(number).setRawPredictionCol("").setProbabilityCol("").transform(df)
        return numbered.withColumn(output, F.get(labels, F.col(number).cast("int"))).drop(number)


def vector_width(df: DataFrame, vector: str = "features") -> int:
    parts = F.unwrap_udt(vector)
    row = df.select(F.coalesce(parts["size"], F.size(parts["values"]))).first()
    if row is None:
        raise ValueError("no row to fit on")
    return row[0]


def fit_logistic_path(train: DataFrame, regs: Sequence[float]) -> list[BucketLogistic]:
    """One-vs-rest logistic regression for every penalty: all buckets and penalties take their steps in the same passes."""
    classes = tuple(sorted(row[0] for row in train.select(BUCKET).distinct().collect()))
    fits = [(target, float(reg)) for reg in regs for target in classes]
    found = logistic.fit_columns(train, BUCKET, "features", vector_width(train), fits)
    models = []
    for i in range(len(regs)):
        mine = slice(i * len(classes), (i + 1) * len(classes))
        models.append(BucketLogistic(classifier_model(found.weights[:, mine].T, found.intercepts[mine]), classes))
    return models


def fit_logistic(train: DataFrame, reg: float = 0.0) -> BucketLogistic:
    return fit_logistic_path(train, [reg])[0]


def f1_of_counts(counts: dict[tuple[float, float], int]) -> float:
    """F1 of every label, weighted by its rows, from counts of (label, prediction)."""
    total = sum(counts.values())
    share = 0.0
    for label in {a for a, _ in counts}:
        rows = sum(n for (a, _), n in counts.items() if a == label)
        told = sum(n for (_, b), n in counts.items() if b == label)
        share += rows * 2 * counts.get((label, label), 0) / (rows + told)
    return share / total if total else math.nan


def tune_logistic(train: DataFrame, regs: Sequence[float] = REG_GRID) -> Tuned:
    """One-vs-rest logistic regression, the penalty chosen by validation F1.

    All penalties are fitted on the tuning part together, and one pass over the
    rest counts what each of them answers.
    """
    parts = tuning_split(train)
    judged = test_part(parts).select(BUCKET, "features")
    for i, model in enumerate(fit_logistic_path(train_part(parts), regs)):
        judged = model.transform(judged, f"p{i}")
    answers = F.array(*(F.struct(F.lit(i).alias("fit"), F.col(f"p{i}").alias("prediction")) for i in range(len(regs))))
    counts = judged.select(BUCKET, F.inline(answers)).groupBy("fit", BUCKET, "prediction").agg(F.count("*").alias("n")).collect()
    metrics = tuple(f1_of_counts({(r[BUCKET], r["prediction"]): r["n"] for r in counts if r["fit"] == i}) for i in range(len(regs)))
    best = max(range(len(metrics)), key=lambda i: (not math.isnan(metrics[i]), metrics[i], -i))
    return Tuned(fit_logistic(train, regs[best]), float(regs[best]), metrics)


@dataclass(frozen=True)
class ClassBayes:
    """A naive Bayes model and the label that each of its classes stands for."""

    model: NaiveBayesModel
    classes: tuple[float, ...]

    @property
    def theta(self):
        return self.model.theta

    @property
    def pi(self):
        return self.model.pi

    def transform(self, df: DataFrame) -> DataFrame:
        labels = F.array(*map(F.lit, self.classes))
        return self.model.transform(df).withColumn("prediction", F.get(labels, F.col("prediction").cast("int")))


def fit_naive_bayes(train: DataFrame) -> ClassBayes:
    """Multinomial naive Bayes. The library numbers the classes it sees, so a bucket
    without training rows would shift the predictions; labels are numbered here.
    """
    classes = tuple(sorted(row[0] for row in train.select(BUCKET).distinct().collect()))
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(BUCKET)) - 1
    numbered = train.withColumn(BUCKET, number.cast("double"))
    model = NaiveBayes(featuresCol="features", labelCol=BUCKET, modelType="multinomial").fit(numbered)
    return ClassBayes(model, classes)
