"""Text, punctuation, link and time expressions over a comment body.

Everything here is a built-in Spark expression, so a projection made of these
stays inside the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Java's \s, the token class that cleaning
# deletes (everything but ASCII letters, digits and blanks), and the URL pattern
# that a link must match. The token class is written as an intersection because
# the JVM matches that about four times faster than the plain negated class.
BLANKS = " \t\n\x0b\f\r"
NOT_ALPHANUMERIC = r"[\W_&&\S]+"
LINK = r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)"

# A run of two or more word characters, the usual bag-of-words token. The
# explicit classes make it mean the same in every regex dialect.
WORD_RUN = r"[\p{L}\p{N}_]{2,}"

SECONDS_PER_HOUR = 3600


def _split_lowered(body: Column, rewrite) -> Column:
    """Split on single blanks; interior empties stay, trailing ones go.

    Cutting the trailing blanks first is what drops trailing empty tokens. A
    body of blanks only has no token at all, an empty body has one empty token.
    """
    trimmed = F.rtrim(body, F.lit(BLANKS))
    pieces = F.split(rewrite(F.lower(trimmed)), r"\s")
    only_blanks = (trimmed == "") & (body != "")
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(pieces)


def raw_tokens(body: Column) -> Column:
    """Lower-cased tokens, punctuation still attached."""
    return _split_lowered(body, lambda text: text)


def clean_tokens(body: Column) -> Column:
    """Lower-cased tokens with everything but ASCII letters and digits deleted.

    A token of punctuation only becomes '' and keeps its place. Deleting from
    the whole body before the split gives the same tokens as cleaning them one
    by one, at the price of one regex pass per body.
    """
    return _split_lowered(body, lambda text: F.regexp_replace(text, NOT_ALPHANUMERIC, ""))


def word_runs(body: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(body), F.lit(WORD_RUN), 0)


def words_count(words: Column) -> Column:
    return F.array_size(words)


def chars_count(words: Column) -> Column:
    """Total length of the tokens, which is not the length of the body."""
    return F.length(F.array_join(words, ""))


def mean_or_zero(total: Column, count: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count).otherwise(F.lit(0.0))


def link_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(LINK))


def char_count(body: Column, char: str) -> Column:
    return F.length(body) - F.length(F.replace(body, F.lit(char), F.lit("")))


def space_words_count(body: Column) -> Column:
    """Pieces of a split on single spaces, empties included."""
    return char_count(body, " ") + 1


def space_word_length(body: Column) -> Column:
    """Mean length of those pieces."""
    spaces = char_count(body, " ")
    return (F.length(body) - spaces).cast("double") / (spaces + 1)


def hour_of_day(created_utc: Column) -> Column:
    """UTC hour as double, from epoch seconds held as text.

    Plain arithmetic, so the session's time zone cannot change it.
    """
    seconds = created_utc.try_cast("bigint")
    return F.floor(F.pmod(seconds, F.lit(24 * SECONDS_PER_HOUR)) / SECONDS_PER_HOUR).cast("double")
