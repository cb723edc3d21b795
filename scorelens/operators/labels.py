"""Score labels: above the upper quartile, or the log-scale bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions import scores
from scorelens.operators.quantile import upper_quartile
from scorelens.session import settle


def with_score(comments: DataFrame) -> DataFrame:
    """Add `score_double` and drop rows whose score is no number."""
    scored = comments.withColumn("score_double", scores.score_double(F.col("score")))
    return scored.where(F.col("score_double").isNotNull())


def with_binary_label(
    scored: DataFrame, by: Sequence[str] = (), output: str = "score_bucket"
) -> DataFrame:
    """1.0 above the upper quartile (of the row's group), else 0.0.

    Thresholds of groups, one row each, are settled first: Spark then knows
    their size when it plans the join and moves no comment if they are few.
    """
    if by:
        limits = settle(upper_quartile(scored, by=by).select(*by, "threshold"), "thresholds")
        labelled = scored.join(limits, list(by))
    else:
        limit = upper_quartile(scored).select("threshold").scalar()
        labelled = scored.withColumn("threshold", limit)
    label = scores.binary_label(F.col("score_double"), F.col("threshold"))
    return labelled.withColumn(output, label)


def with_log_bucket(scored: DataFrame, output: str = "score_bucket") -> DataFrame:
    return scored.withColumn(output, scores.log_bucket(F.col("score_double")))
