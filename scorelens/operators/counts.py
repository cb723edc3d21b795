"""Counts, class shares and ordered views of the comment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions import scores
from scorelens.operators.filters import GONE_AUTHOR, GONE_BODIES, first_rows, keep_real_comments
from scorelens.operators.splits import hash_percent


def stage_counts(comments: DataFrame, limit: int = -1, train_percent: int = 70) -> DataFrame:
    """Rows loaded, left after the placeholder filter, after the row cap, and in each split part."""
    real = F.coalesce((F.col("author") != GONE_AUTHOR) & ~F.col("body").isin(*GONE_BODIES), F.lit(False))
    in_train = hash_percent("id") < train_percent
    capped = first_rows(keep_real_comments(comments), limit).agg(
        F.struct(
            F.count("*").alias("limited"), F.count_if(in_train).alias("train"), F.count_if(~in_train).alias("test")
        ).alias("counts")
    )
    return comments.agg(F.count("*").alias("loaded"), F.count_if(real).alias("filtered")).select(
        "*", capped.scalar().alias("counts")
    ).select("loaded", "filtered", "counts.*")


def community_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("subreddit").agg(F.count("*").alias("comments"))


def top_scores(comments: DataFrame, k: int) -> DataFrame:
    score = scores.score_double(F.col("score"))
    return (
        comments.select("id", "subreddit", score.alias("score_double"))
        .orderBy(F.desc("score_double"), "id")
        .limit(k)
    )


def score_summary(comments: DataFrame) -> DataFrame:
    score = scores.score_double(F.col("score"))
    return comments.agg(F.count("*").alias("comments"), F.max(score).alias("highest_score"))


def _share(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") / total)


def binary_distribution(scored: DataFrame, threshold) -> DataFrame:
    """Rows at or below the threshold and above it, with shares."""
    score = F.col("score_double")
    limit = F.lit(threshold)
    below, above = F.count_if(score <= limit), F.count_if(score > limit)
    return scored.agg(
        limit.cast("double").alias("threshold"),
        below.alias("below"),
        _share(below, F.count("*")).alias("below_share"),
        above.alias("above"),
        _share(above, F.count("*")).alias("above_share"),
    )


def class_distribution(labelled: DataFrame, label: str = "score_bucket") -> DataFrame:
    """Rows and share of each class, in class order, with its score range.

    The total is a sum over the class counts, a handful of rows, not a second
    pass over the table.
    """
    classes = labelled.groupBy(label).agg(F.count("*").alias("comments"))
    total = classes.agg(F.sum("comments")).scalar()
    return classes.select(
        F.col(label).alias("bucket"),
        scores.bucket_low(F.col(label)).alias("low"),
        scores.bucket_high(F.col(label)).alias("high"),
        "comments",
        _share(F.col("comments"), total).alias("share"),
    ).orderBy("bucket")


def majority_baseline(labelled: DataFrame, label: str = "score_bucket") -> DataFrame:
    """Accuracy of always answering the largest class."""
    classes = labelled.groupBy(label).agg(F.count("*").alias("comments"))
    return classes.agg(
        F.sum("comments").alias("comments"),
        _share(F.max("comments"), F.sum("comments")).alias("baseline"),
    )
