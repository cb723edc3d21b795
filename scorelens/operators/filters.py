"""Row filters and the row cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.operators.quantile import place_of_rank
from scorelens.session import settle

# What the board leaves in place of a withdrawn author or body.
GONE_AUTHOR = "[deleted]"
GONE_BODIES = ("[removed]", "[deleted]")


def keep_real_comments(comments: DataFrame) -> DataFrame:
    """Drop placeholder rows; a null author or body is dropped as well."""
    return comments.where((F.col("author") != GONE_AUTHOR) & ~F.col("body").isin(*GONE_BODIES))


def one_community(comments: DataFrame, subreddit: str) -> DataFrame:
    return comments.where(F.col("subreddit") == subreddit)


def row_order(df: DataFrame, key: str = "id") -> Column:
    """A numeric order of the rows: the key itself, or 60 bits of a text key's digest."""
    if dict(df.dtypes)[key] == "string":
        return F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.col(key)


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """n rows, always the same ones; all rows if n is not positive, and never a row without a key.

    Finds the n-th place in the key's order and filters by it, so the kept rows
    stay where they are: a plain sort-and-limit of a million rows would pull
    them all through one task. Where the last key kept is repeated, the place is
    looked for among a digest of its rows, and among equal rows by their number
    in a written copy of them.
    """
    if n <= 0:
        return df
    order = row_order(df, key)
    place = place_of_rank(df.select(order.alias("row_order")), "row_order", n)
    if place is None:
        return df.where(F.col(key).isNotNull())
    if place.rank == place.equal:
        return df.where(order <= F.lit(place.key))
    parts = [df.where(order < F.lit(place.key))]
    same = settle(df.where(order == F.lit(place.key)), "rows-of-last-key")
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    inner = place_of_rank(same.select(digest.alias("digest")), "digest", place.rank)
    parts.append(same.where(digest < F.lit(inner.key)))
    number = "row_number_in_copy"
    equal = settle(same.where(digest == F.lit(inner.key)).withColumn(number, F.monotonically_increasing_id()), "equal-rows")
    last = place_of_rank(equal, number, inner.rank)
    parts.append(equal.where(F.col(number) <= F.lit(last.key)).drop(number))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
