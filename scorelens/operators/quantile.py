"""Exact order statistics without a global sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.session import settle

CELLS = 4096
LETTERS = 2


def _cell(key: Column, low, high) -> Column:
    """Number of the equal-width cell of [low, high] that holds the key."""
    if isinstance(low, int):
        width = (high - low) // CELLS + 1
        # Decimal, as the distance between two bigints may not fit a bigint.
        offset = key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        return F.floor(offset / F.lit(width).cast("decimal(20,0)")).cast("int")
    # Halves, as the distance between two doubles may not fit a double.
    share = (key / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")


@dataclass(frozen=True)
class Place:
    """Where a rank falls: the key there, the rank among the rows of that key (from 1), and how many have it."""

    key: object
    rank: int
    equal: int


def value_at_rank(df: DataFrame, key: str, rank: int | Callable[[int], int]):
    """The rank-th smallest non-null key (from 1); None if there is no such rank.

    `rank` may be a function of the number of keys. The table is read once, to
    write out its key column. Keys are numbers or texts, these in the order of
    their UTF-8 bytes.
    """
    place = place_of_rank(df, key, rank)
    return None if place is None else place.key


def place_of_rank(df: DataFrame, key: str, rank: int | Callable[[int], int]) -> Place | None:
    return _place(settle(df.select(key), "keys"), key, rank)


def value_at_rank_of_settled(
    df: DataFrame, key: str, rank: int | Callable[[int], int], weight: str | None = None
):
    """The same over a frame that is cheap to read again; a row counts `weight` times."""
    place = _place(df, key, rank, weight)
    return None if place is None else place.key


def _place(df: DataFrame, key: str, rank: int | Callable[[int], int], weight: str | None = None) -> Place | None:
    """Each pass counts the keys in a few thousand cells and then looks only
    into the cell that holds the rank, until it holds one value; the driver
    sees cell counts, and no task sees many keys.
    """
    kind = dict(df.dtypes)[key]
    if kind in ("binary", "boolean"):
        raise ValueError(f"{key} is neither number nor text")
    column = F.col(key)
    keys = df.where(column.isNotNull())
    size = F.sum(weight) if weight else F.count("*")
    count, low, high = keys.agg(size, F.min(key), F.max(key)).first()
    count = count or 0
    rank = rank(count) if callable(rank) else rank
    if not 1 <= rank <= count:
        return None
    while low < high:
        cells = (
            keys.where(column.between(F.lit(low), F.lit(high)))
            .groupBy((_prefix(column, low, high) if kind == "string" else _cell(column, low, high)).alias("cell"))
            .agg(size.alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
            .collect()
        )
        for cell in sorted(cells, key=lambda row: row["cell"]):
            if rank <= cell["n"]:
                low, high, count = cell["low"], cell["high"], cell["n"]
                break
            rank -= cell["n"]
    return Place(low, rank, count)


def _prefix(key: Column, low: str, high: str) -> Column:
    """The bytes behind what the two ends of a range share, LETTERS of them at most."""
    ends = low.encode(), high.encode()
    shared = next((i for i, (a, b) in enumerate(zip(*ends)) if a != b), min(map(len, ends)))
    return F.substring(key.cast("binary"), shared + 1, LETTERS)


def upper_quartile(df: DataFrame, score: str = "score_double", by: Sequence[str] = ()) -> DataFrame:
    """Per group: row count, highest score and the exact upper quartile.

    The quartile is the score of ascending rank n - floor(n/4), from 1. Equal
    scores are counted before the shuffle, and the counts are written out, so
    the table itself is read once. The rank is searched for by cells, in all
    groups together, so that no task has to see all scores of a group.
    """
    by = list(by)
    value = F.col(score)
    if not by:
        counts = settle(
            df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n")), "score-counts"
        )
        threshold = value_at_rank_of_settled(counts, "value", lambda rows: rows - rows // 4, "n")
        return (
            counts.agg(F.sum("n").alias("rows"), F.max("value").alias("max_score"))
            .withColumn("threshold", F.lit(threshold).cast("double"))
            .where(F.col("threshold").isNotNull())
        )
    counts = settle(
        df.where(value.isNotNull()).groupBy(*by, value.alias("value")).agg(F.count("*").alias("n")), "score-counts"
    )
    return _quartiles(counts, by)


def _quartiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """The search for all groups at once: each pass counts the scores of every open group in CELLS equal cells
    between its ends and goes on in the cell that holds its rank; groups that are down to one score leave.
    """
    whole = counts.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("value").alias("max_score")
    )
    open_groups = settle(whole.withColumn("rank", F.col("rows") - F.floor(F.col("rows") / 4)), "quartile-search")
    same = [F.col(f"c.`{b}`").eqNullSafe(F.col(f"g.`{b}`")) for b in by]
    # Halves, as the distance between two doubles may not fit a double.
    share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int").alias("cell")
    reached = F.sum("n").over(Window.partitionBy(*by).orderBy("cell"))  # CELLS rows of a group at most
    found: list[DataFrame] = []
    while True:
        found.append(open_groups.where("low = high").select(*by, "rows", "max_score", F.col("low").alias("threshold")))
        open_groups = open_groups.where("low < high")
        if open_groups.isEmpty():
            return reduce(DataFrame.unionByName, found)
        met = counts.alias("c").join(open_groups.alias("g"), reduce(Column.__and__, same)).where(F.col("value").between(F.col("low"), F.col("high")))
        cells = met.select(*(F.col(f"g.`{b}`") for b in by), "rows", "max_score", "rank", "value", "n", cell)
        cells = cells.groupBy(*by, "cell").agg(
            F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.max("rank").alias("rank"), F.max("rows").alias("rows"), F.max("max_score").alias("max_score"),
        )
        stepped = cells.withColumn("reached", reached).withColumn("before", F.col("reached") - F.col("n"))
        stepped = stepped.where((F.col("before") < F.col("rank")) & (F.col("reached") >= F.col("rank")))
        stepped = stepped.withColumn("rank", F.col("rank") - F.col("before"))
        open_groups = settle(stepped.select(*by, "rows", "low", "high", "max_score", "rank"), "quartile-search")
