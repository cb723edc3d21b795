"""The comment view over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lexicon for the invented prose: words that occur in it, valences ours.
SMALL_LEXICON = {
    "die": -3, "ha": 2, "no": -1, "anti": -1, "haha": 3, "idiot": -3, "worthless": -2, "moron": -3,
    "pathetic": -2, "stupid": -2, "loser": -3, "disgusting": -3, "best": 3, "threat": -2, "vile": -3,
    "hahaha": 3,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch_seconds(ts: Column, dtype: str) -> Column:
    """Whole seconds since 1970 of a UTC time, whatever the session's zone."""
    if dtype == "timestamp":
        return F.unix_seconds(ts)
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body, author, subreddit, created_utc, score: one row per document.

    A document without an event has no author, so it counts as loaded and goes
    with the placeholders.

    Events are as many as documents, so the two meet in a shuffle; the hint asks
    for that on small tables too, which then use every core for the text work.
    The join with the pages is left to Spark.
    """
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    seconds = _epoch_seconds(F.col("ts"), dict(events.dtypes)["ts"])
    return (
        documents.join(events.hint("merge"), documents["doc_id"] == events["event_id"], "left")
        .join(pages, documents["doc_id"] == pages["page_id"], "left")
        .select(
            F.col("doc_id").alias("id"),
            F.concat("text", F.coalesce(F.concat(F.lit(" "), "url"), F.lit(""))).alias("body"),
            F.when(F.col("event_type") == "error", "[deleted]")
            .otherwise(F.col("user_id").cast("string"))
            .alias("author"),
            F.col("source").alias("subreddit"),
            seconds.cast("string").alias("created_utc"),
            (F.floor("value") - 5).cast("string").alias("score"),
        )
    )
