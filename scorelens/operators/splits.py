"""Train/test splits. A split adds a `part` column; callers filter by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.operators.quantile import value_at_rank
from scorelens.session import settle

TRAIN, TEST = "train", "test"

# The share of rows trained on, the seed of the random split,
# the share of the training rows kept for tuning, and the positional share.
TRAIN_PERCENT = 70
RANDOM_SEED = 11
TUNING_PERCENT = 80
ORDERED_PERCENT = 60


def hash_percent(key: str, salt: str = "") -> Column:
    """A number 0..99 that depends on the key alone, from its MD5 digest."""
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def _parts(in_train: Column) -> Column:
    return F.when(in_train, TRAIN).otherwise(TEST)


def hash_split(df: DataFrame, percent: int = TRAIN_PERCENT, key: str = "id", salt: str = "") -> DataFrame:
    """A row's part follows from its key: the same on any cluster and layout."""
    return df.withColumn("part", _parts(hash_percent(key, salt) < percent))


def random_split(df: DataFrame, percent: int = TRAIN_PERCENT, seed: int = RANDOM_SEED) -> DataFrame:
    """A seeded random split: one draw per row, written with the row, so both parts see the same draw.

    It depends on how the rows lie in partitions; prefer `hash_split`.
    """
    return settle(df.withColumn("part", _parts(F.rand(seed) < percent / 100)), "random-split")


def ordered_split(df: DataFrame, percent: int = ORDERED_PERCENT, key: str = "id") -> DataFrame:
    """The first floor(percent * n / 100) rows in key order train, the rest test; text keys by their UTF-8 bytes.

    Rows that share the last key of the training part train as well; rows
    without a key test.
    """
    last = value_at_rank(df, key, lambda rows: rows * percent // 100)
    in_train = F.lit(False) if last is None else F.coalesce(F.col(key) <= F.lit(last), F.lit(False))
    return df.withColumn("part", _parts(in_train))


def train_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("part") == TRAIN).drop("part")


def test_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("part") == TEST).drop("part")
