"""Term statistics over token arrays: counts, document frequency, IDF, TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.operators.packed import numbered
from scorelens.operators.quantile import value_at_rank_of_settled
from scorelens.session import settle

# A term with more than one in HOT_SHARE of all uses is joined by broadcast.
# By that definition fewer than HOT_SHARE terms can be hot.
HOT_SHARE = 65_536
SALTS = 64


def term_uses(df: DataFrame, words: str = "words", by: Sequence[str] = ()) -> DataFrame:
    """How often each term occurs; counted before the shuffle, so no term is hot."""
    terms = df.select(*by, F.explode(words).alias("term"))
    return terms.groupBy(*by, "term").agg(F.count("*").alias("uses"))


def term_digest(term: Column) -> Column:
    """60 bits of the term's MD5 digest: an order that no task has to sort."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("bigint")


def top_terms(uses: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """The `size` most used terms; of terms used equally often, those of the smallest digest.

    `uses` should be settled, as it is read several times. The use count of
    the last term kept is found first, then the digest of the last one kept
    among those of that count; the rest is a plain filter. A sort-and-limit of
    all terms would take `size` terms of every partition through one task.

    Within groups the ranking runs twice, first inside hashed slices of the
    group's terms, so no task sees more than `size` terms of every slice.
    """
    order = [F.desc("uses"), term_digest(F.col("term"))]
    if by:
        slice_of_term = F.pmod(F.hash("term"), F.lit(SALTS))
        for keys in ([*by, slice_of_term], list(by)):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            uses = uses.withColumn("place", place).where(F.col("place") <= size).drop("place")
        return uses
    last = value_at_rank_of_settled(uses, "uses", lambda terms: terms - size + 1)
    if last is None:
        return uses
    left = size - uses.where(F.col("uses") > last).count()
    digest = term_digest(F.col("term"))
    cut = value_at_rank_of_settled(uses.where(F.col("uses") == last).select(digest.alias("digest")), "digest", left)
    return uses.where((F.col("uses") > last) | ((F.col("uses") == last) & (digest <= F.lit(cut))))


def ranked_terms(uses: DataFrame) -> DataFrame:
    """(term, uses, slot): terms numbered from the most used on, terms used equally often in their own order.

    A sort deals the terms to ranges and numbers them inside each; see `numbered`.
    """
    placed = numbered(uses.select("term", "uses").orderBy(F.desc("uses"), "term"), "slot", "ranked-terms")
    return placed.withColumn("slot", F.col("slot").cast("int"))


def document_frequency(df: DataFrame, words: str = "words") -> DataFrame:
    """In how many rows each term occurs. Repeats go away inside the row."""
    terms = df.select(F.explode(F.array_distinct(words)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("doc_freq"))


def term_statistics(df: DataFrame, words: str = "words") -> DataFrame:
    """Uses and document frequency of each term, from one explode and one shuffle."""

    def tagged(array: Column, use: int, row: int) -> Column:
        return F.transform(
            array,
            lambda word: F.struct(word.alias("term"), F.lit(use).alias("use"), F.lit(row).alias("row")),
        )

    both = F.concat(tagged(F.col(words), 1, 0), tagged(F.array_distinct(words), 0, 1))
    return (
        df.select(F.inline(both))
        .groupBy("term")
        .agg(F.sum("use").alias("uses"), F.sum("row").alias("doc_freq"))
    )


def smoothed_idf(rows: Column, doc_freq: Column) -> Column:
    return F.log((rows + 1).cast("double") / (doc_freq + 1))


def idf_weights(df: DataFrame, words: str = "words") -> DataFrame:
    df = settle(df.select(words), "words")
    rows = df.agg(F.count("*")).scalar()
    return term_statistics(df, words).withColumn("idf", smoothed_idf(rows, F.col("doc_freq")))


def join_on_term(terms: DataFrame, table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inner join of many term rows with one row per term.

    `table` has a `uses` column and should be a settled one, as it is read
    several times. Its few hot terms are broadcast, which keeps
    most term rows where they are; only the rest are shuffled by term, and
    among those no term is frequent.
    """
    keys = [*by, "term"]
    total = table.agg(F.sum("uses")).scalar()
    is_hot = F.col("uses") * HOT_SHARE > total
    hot, cold = table.where(is_hot), table.where(~is_hot)
    return (
        terms.join(F.broadcast(hot), keys)
        .unionByName(terms.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
        .drop("uses")
    )


def counted_in_rows(rows: DataFrame, words: str, key: str) -> DataFrame:
    """(key, term, tf) of each row by itself: its terms in order, cut where the next one begins. No task holds more than a row."""
    ordered, starts, size = F.col("row_terms"), F.col("row_starts"), F.size("row_terms")
    rows = rows.where(F.size(words) > 0).select(key, F.array_sort(words).alias("row_terms"))
    begins = lambda i: (i == 0) | ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1))
    rows = rows.withColumn("row_starts", F.filter(F.sequence(F.lit(0), size - 1), begins))
    found = F.transform(
        starts,
        lambda start, i: F.struct(
            F.get(ordered, start).alias("term"), (F.coalesce(F.get(starts, i + 1), size) - start).cast("bigint").alias("tf")
        ),
    )
    return rows.select(key, F.inline(found))


def term_frequencies(df: DataFrame, words: str = "words", key: str = "id") -> DataFrame:
    """Bag of words in long form: (key, term, tf).

    A row's terms are counted in the row, so nothing is grouped; only rows that
    share their key, or have none, are added up.
    """
    rows = settle(df.select(key, words), "row-terms")
    shared = settle(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("shared_key")), "shared-keys")
    if shared.isEmpty():
        return counted_in_rows(rows, words, key)
    is_shared = F.col(key).eqNullSafe(F.col("shared_key"))
    several = counted_in_rows(rows.join(shared, is_shared, "left_semi"), words, key)
    several = several.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return counted_in_rows(rows.join(shared, is_shared, "left_anti"), words, key).unionByName(several)


def tfidf_terms(df: DataFrame, words: str = "words", key: str = "id") -> DataFrame:
    """(key, term, tf, tfidf) with the whole vocabulary, nothing held on the driver.

    Texts are read once: the counts of each row's terms, and one line without
    a term per row, are written and give the document frequencies, the number
    of rows and the terms that meet their weights.
    """
    counted = term_frequencies(df.select(key, F.array_append(words, None).alias(words)), words, key)
    counted = settle(counted, "term-frequencies")
    terms = counted.where(F.col("term").isNotNull())
    rows = counted.where(F.col("term").isNull()).agg(F.sum("tf")).scalar()
    doc_freq = F.count("*")
    weights = terms.groupBy("term").agg(doc_freq.alias("uses"), smoothed_idf(rows, doc_freq).alias("idf"))
    joined = join_on_term(terms, settle(weights, "idf"))
    return joined.select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))
