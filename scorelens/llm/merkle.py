"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A paragraph is a line, a section is SECTION lines in a row. A paragraph is cut
where its content says, after the first blank or stop that follows ten
characters, or after sixteen, into leaves. Leaves are hashed into paragraphs,
those into sections, those into the root, so equal roots mean equal texts and
differing branches show where an edit is. Built-in SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.texts import only
from scorelens.session import settle

SECTION = 8
LEAF = r"(?s).{9,15}?[ ,.;:!?]|.{1,16}|^\z"
NODE, LEAF_HASH = 8, 4  # characters of base64 that a fingerprint keeps of a node and of a leaf
FIRST_ID = -(1 << 63)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _short(md5: Column, characters: int) -> Column:
    return F.base64(F.unhex(F.substring(md5, 1, characters * 3 // 2)))


def fingerprint(text: Column) -> Column:
    """root:sections:paragraphs, the nodes of a level blank-separated; a null text counts as empty.

    A paragraph is its own node and, without a break, its leaves in order.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    leaves = F.transform(lines, lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5))

    def paragraph(hashes: Column) -> Column:
        kept = F.transform(hashes, lambda h: _short(h, LEAF_HASH))
        return F.struct(F.md5(F.array_join(hashes, "")).alias("node"), F.array_join(kept, "").alias("leaves"))

    def levels(paragraphs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION))
        sections = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(paragraphs["node"], i, SECTION), "")))
        branches = F.transform(paragraphs, lambda p: F.concat(_short(p["node"], NODE), p["leaves"]))
        return _let(
            sections,
            lambda nodes: F.concat_ws(
                ":",
                F.md5(F.array_join(nodes, "")),
                F.array_join(F.transform(nodes, lambda n: _short(n, NODE)), " "),
                F.array_join(branches, " "),
            ),
        )

    return _let(F.transform(leaves, paragraph), levels)


def _level(fingerprint: Column, level: int) -> Column:
    return F.split(F.split_part(fingerprint, F.lit(":"), F.lit(level)), " ")


def _nodes(branches: Column) -> Column:
    return F.transform(branches, lambda p: F.substring(p, 1, NODE))


def _weight(branches: Column) -> Column:
    """How many leaves are under these paragraphs."""
    return (F.length(F.array_join(branches, "")) - NODE * F.size(branches)) / LEAF_HASH


def _head(x: Column, y: Column) -> Column:
    """How many entries both lists begin with."""
    shorter = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, 1, shorter), F.slice(y, 1, shorter), lambda u, v: u == v)
    return _let(F.array_position(same, F.lit(False)), lambda first: F.when(first > 0, (first - 1).cast("int")).otherwise(shorter))


def _both_ends(x: Column, y: Column) -> Column:
    """head, tail: entries that both lists begin and end with; the tail doesn't reach into the head."""
    head = _head(x, y)
    tail = _head(F.reverse(x), F.reverse(y))
    return _let(head, lambda n: F.struct(n.alias("head"), F.least(tail, F.least(F.size(x), F.size(y)) - n).alias("tail")))


def _cut(entries: Column, ends: Column) -> Column:
    return F.slice(entries, ends["head"] + 1, F.size(entries) - ends["head"] - ends["tail"])


def _equal_leaves(x: Column, y: Column) -> Column:
    """Equal leaves of differing paragraphs: at both ends, or anywhere."""
    leaves = lambda p: F.regexp_extract_all(
        F.array_join(F.transform(p, lambda b: F.substr(b, F.lit(NODE + 1))), ""), F.lit(f".{{{LEAF_HASH}}}"), F.lit(0)
    )
    count = lambda p, q: _let(
        _both_ends(p, q), lambda ends: F.greatest(ends["head"] + ends["tail"], F.size(F.array_intersect(p, q)))
    )
    return _let(F.struct(leaves(x).alias("x"), leaves(y).alias("y")), lambda s: count(s["x"], s["y"]))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of equal leaves, of the text that has more; 1 for equal roots.

    The search goes down differing branches only. All leaves of the sections
    that both begin with are equal; so are, among the other paragraphs, those
    of the ones at both ends and then those of equal ones anywhere (repeated
    ones count once there). Only leaves of what is left are compared, those at
    both ends or those that stand anywhere, whichever are more.
    """

    def below(s: Column) -> Column:
        """What is left under the first differing section."""
        ends = _both_ends(_nodes(s["x"]), _nodes(s["y"]))

        def between(e: Column) -> Column:
            outside = _weight(s["x"]) - _weight(_cut(s["x"], e))
            return _let(
                F.struct(_cut(s["x"], e).alias("x"), _cut(s["y"], e).alias("y")),
                lambda m: outside
                + _weight(F.array_intersect(m["x"], m["y"]))
                + _equal_leaves(F.array_except(m["x"], m["y"]), F.array_except(m["y"], m["x"])),
            )

        return _let(ends, between)

    def from_sections(s: Column) -> Column:
        skipped = _head(s["p"], s["q"]) * SECTION
        rest = lambda p, n: F.slice(p, n + 1, F.size(p))
        equal = _let(
            F.least(skipped, F.size(s["x"]), F.size(s["y"])),
            lambda n: _weight(F.slice(s["x"], F.lit(1), n))
            + _let(F.struct(rest(s["x"], n).alias("x"), rest(s["y"], n).alias("y")), below),
        )
        return equal / F.greatest(_weight(s["x"]), _weight(s["y"]))

    both = F.struct(_level(a, 2).alias("p"), _level(b, 2).alias("q"), _level(a, 3).alias("x"), _level(b, 3).alias("y"))
    root = lambda f: F.split_part(f, F.lit(":"), F.lit(1))
    return F.when(root(a) == root(b), 1.0).otherwise(_let(both, from_sections))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of the second fingerprint that the first one lacks."""
    marked = F.transform(_nodes(_level(b, 3)), lambda p, i: F.when(~F.array_contains(_nodes(_level(a, 3)), p), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _successors(keys: DataFrame) -> DataFrame:
    """Each distinct (place, digest) with the one that follows, the last with the first.

    Ranges of the keys are numbered by their partition; within a range the next
    key is a window function, between ranges it is the first of the next one,
    for which there is one row per range.
    """
    key = F.struct("place", "digest")
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = keys.distinct().repartitionByRange(parts, "place", "digest").withColumn("range", F.spark_partition_id())
    ranged = settle(ranged, "ranges")
    firsts = ranged.groupBy("range").agg(F.min(key).alias("first"))
    ends = Window.orderBy("range")
    whole = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("range", F.coalesce(F.lead("first").over(ends), F.first("first").over(whole)).alias("after"))
    inside = F.lead(key).over(Window.partitionBy("range").orderBy("place", "digest"))
    return (
        ranged.withColumn("next", inside)
        .join(after, "range")
        .select("place", "digest", "n_chars", F.coalesce("next", "after").alias("next"))
        .select("place", "digest", "n_chars", F.col("next.place").alias("next_place"), F.col("next.digest").alias("next_digest"))
    )


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    The edited text has the last quarter replaced by the beginning of the next
    document, by ascending doc_id; null ids come first (the smallest bigint
    counts as null) and texts of one id go by a hash. Rows equal in id and text are one place in that order. A text
    alone in its table is its own next one; null texts count as empty.
    """
    # Both joins below read the same columns, so that Spark moves the texts once.
    rows = only(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("place"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("digest", F.xxhash64("text"))
    order = _successors(rows.select("place", "digest", F.length("text").alias("n_chars")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    heads = (
        rows.join(
            order.select(
                F.col("next_place").alias("place"),
                F.col("next_digest").alias("digest"),
                F.col("place").alias("of_place"),
                F.col("digest").alias("of_digest"),
                quarter.alias("quarter"),
            ),
            ["place", "digest"],
        )
        .select(
            F.col("of_place").alias("place"),
            F.col("of_digest").alias("digest"),
            F.struct(F.substring("text", F.lit(1), F.col("quarter")).alias("head"), fingerprint(F.col("text")).alias("next")).alias("from"),
        )
        .groupBy("place", "digest")
        .agg(F.first("from").alias("from"))
    )
    n_chars = F.length("text")
    both = rows.join(heads, ["place", "digest"]).select(
        F.when(F.col("place") != FIRST_ID, F.col("place")).alias("doc_id"),
        n_chars.cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n_chars - F.floor(n_chars / 4).cast("int")), F.col("from.head")).alias("edited"),
        fingerprint(F.col("text")).alias("fingerprint"),
        F.col("from.next").alias("next_fingerprint"),
    )
    return both.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
