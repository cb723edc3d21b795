"""Lexicon filter and sentiment, for lexicons of any size.

A lexicon is a frame `(word string, valence int)`; a repeated word counts with
its largest valence. Tokens meet the lexicon before anything is grouped, and
only lexicon words are; Spark picks the join by the lexicon's size. Rows are told
apart by their key, which must be unique. A null token array has no lexicon words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.session import settle

SALTS = 16


def unique_entries(lexicon: DataFrame) -> DataFrame:
    entries = lexicon.where(F.col("word").isNotNull() & F.col("valence").isNotNull())
    return entries.groupBy("word").agg(F.max("valence").alias("valence"))


def _hits(df: DataFrame, entries: DataFrame, words: str, key: str) -> DataFrame:
    """(key, position, word, valence) of the tokens that are lexicon words.

    Each entry stands SALTS times in the join and a token asks one of them by
    its position: where the lexicon is too large to be broadcast, a frequent
    word is then spread over as many tasks. Where it is broadcast, no token moves.
    """
    # Written, so that its size is known before the tokens are dealt out for a join that needs no dealing.
    salted = settle(entries, "lexicon-entries").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tokens = df.select(key, F.posexplode(words).alias("position", "word"))
    return tokens.withColumn("salt", F.col("position") % SALTS).join(salted, ["word", "salt"]).drop("salt")


def with_lexicon_words(
    df: DataFrame, lexicon: DataFrame, words: str = "words", output: str = "filtered", key: str = "id"
) -> DataFrame:
    """Keep the lexicon words of each row, in order; drop rows that have none.

    `df` is read twice, for the tokens and for the rows: let it be a written one.
    """
    hits = (
        _hits(df, unique_entries(lexicon), words, key)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("position", "word"))).alias("hits"))
        .select(key, F.col("hits.word").alias(output))
    )
    return df.join(hits, key)


def with_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    words: str = "words",
    output: str = "sentiment",
    skip_zero: bool = False,
    key: str = "id",
) -> DataFrame:
    """Add the mean valence of each row's lexicon words, 0 where it has none.

    With `skip_zero`, entries of valence 0 do not count as lexicon words. `df`
    is read twice, for the tokens and for the rows: let it be a written one.
    """
    entries = unique_entries(lexicon)
    if skip_zero:
        entries = entries.where(F.col("valence") != 0)
    means = (
        _hits(df, entries, words, key)
        .groupBy(key)
        .agg((F.sum("valence").cast("double") / F.count("*")).alias(output))
    )
    return df.join(means, key, "left").withColumn(output, F.coalesce(output, F.lit(0.0)))


def lexicon_hits(df: DataFrame, lexicon: DataFrame, words: str = "words") -> DataFrame:
    """Occurrences of every lexicon word, zero included.

    Tokens are counted per word before they meet the lexicon.
    """
    uses = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    return (
        unique_entries(lexicon)
        .join(uses, "word", "left")
        .select("word", "valence", F.coalesce("uses", F.lit(0)).alias("uses"))
    )


def last_of_each_word(entries: DataFrame, order: str) -> DataFrame:
    """One row per word: the valence that comes last in the given order."""
    return entries.groupBy("word").agg(F.max_by("valence", order).alias("valence"))
