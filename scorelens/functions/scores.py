"""Score expressions: casts, labels, bucket ranges and errors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_double(score: Column) -> Column:
    """Score text as a number; null for text that is none, and for NaN and the infinities."""
    number = score.try_cast("double")
    return F.when(F.abs(number) < math.inf, number)


def binary_label(score: Column, threshold) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score > limit, 1.0).when(score.isNotNull(), 0.0)


def log_bucket(score: Column) -> Column:
    """0 for scores up to zero, else one more than the whole part of log2."""
    doublings = (F.ln(score) / F.lit(math.log(2))).cast("int") + 1
    return F.when(score <= 0, 0.0).when(F.abs(score) < math.inf, doublings.cast("double"))


def _power_of_two(exponent: Column) -> Column:
    """As a bigint; what would be larger is the largest bigint."""
    return F.when(exponent >= 63, F.lit((1 << 63) - 1)).otherwise(F.pow(F.lit(2.0), exponent).cast("bigint"))


def bucket_low(bucket: Column) -> Column:
    return F.when(bucket <= 0, F.lit(-1).cast("bigint")).otherwise(_power_of_two(bucket - 1))


def bucket_high(bucket: Column) -> Column:
    return F.when(bucket <= 0, F.lit(-1).cast("bigint")).otherwise(_power_of_two(bucket))


def squared_error(label: Column, prediction: Column) -> Column:
    return F.pow(label - prediction, 2)
