"""Errors, accuracy and views of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.scores import squared_error

SAMPLE_ROWS = 10
LAST_ROWS = 5


def with_squared_error(predictions: DataFrame, label: str = "score_double") -> DataFrame:
    return predictions.withColumn("sq_err", squared_error(F.col(label), F.col("prediction")))


def regression_errors(predictions: DataFrame, label: str = "score_double") -> DataFrame:
    """Rows, mean squared error and its root."""
    mse = F.avg(squared_error(F.col(label), F.col("prediction")))
    return predictions.agg(F.count("*").alias("rows"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def accuracy(predictions: DataFrame, label: str = "score_bucket", by: Sequence[str] = ()) -> DataFrame:
    """Rows, rows predicted right, and their share (per group)."""
    right = F.count_if(F.col(label) == F.col("prediction"))
    return predictions.groupBy(*by).agg(
        F.count("*").alias("rows"),
        right.alias("right"),
        F.try_divide(right.cast("double"), F.count("*")).alias("accuracy"),
    )


def prediction_sample(predictions: DataFrame, k: int = SAMPLE_ROWS, key: str = "id") -> DataFrame:
    """The first k scored rows in key order, with body, words and error."""
    # The column names.
    return (
        with_squared_error(predictions)
        .select(key, "body", "words", "score_double", "prediction", "sq_err")
        .orderBy(key)
        .limit(k)
    )


def last_predictions(predictions: DataFrame, k: int = LAST_ROWS, key: str = "id") -> DataFrame:
    """Real and predicted score of the last k rows in key order."""
    return predictions.select(key, "score_double", "prediction").orderBy(F.desc(key)).limit(k)
