"""Writers: per-community tables and the regularisation curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The communities that get a table of their own.
COMMUNITIES = (
    "hiphopheads",
    "videos",
    "programming",
    "television",
    "movies",
    "compsci",
    "AskReddit",
    "askscience",
    "nosleep",
    "music",
)


def write_community_tables(
    comments: DataFrame, path: str, communities: Sequence[str] = COMMUNITIES
) -> None:
    """One pass into `month=/subreddit=` folders.

    The rebalance hint gathers each community's rows so that tasks do not each
    write a sliver of every folder, and lets adaptive execution split the
    community that holds most of the rows over several tasks.
    """
    day = F.floor(F.col("created_utc").try_cast("bigint") / 86400).cast("int")
    month = F.date_format(F.date_from_unix_date(day), "yyyy-MM")
    (
        comments.where(F.col("subreddit").isin(*communities))
        .withColumn("month", month)
        .hint("rebalance", "month", "subreddit")
        .write.partitionBy("month", "subreddit")
        .parquet(path)
    )


def write_curve(curve: DataFrame, path: str) -> None:
    """`reg_param,train_rmse,test_rmse` lines without a header."""
    curve.select("reg_param", "train_rmse", "test_rmse").write.csv(path)
