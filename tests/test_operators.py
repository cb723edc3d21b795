import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelens.operators import counts, explain, filters, labels, lexicon, quantile, splits, vocabulary
from scorelens.sources.readers import lexicon_frame

LEXICON = {"good": 3, "bad": -3, "meh": 0, "fine": 2, "awful": -3}


def scored(spark, values, group=None):
    rows = [(i, float(v), (group or (lambda i: "g"))(i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, score_double double, subreddit string")


def test_placeholders(spark):
    rows = [
        (1, "ann", "hello"),
        (2, "[deleted]", "hello"),
        (3, "ann", "[removed]"),
        (4, "ann", "[deleted]"),
        (5, None, "hello"),
        (6, "ann", None),
        (7, "ann", "[Deleted]"),
    ]
    df = spark.createDataFrame(rows, "id int, author string, body string")
    kept = [row["id"] for row in filters.keep_real_comments(df).collect()]
    assert sorted(kept) == [1, 7]
    stages = counts.stage_counts(df).first()
    assert (stages["loaded"], stages["filtered"], stages["train"] + stages["test"]) == (7, 2, 2)
    assert counts.stage_counts(df, limit=1).first()["limited"] == 1


def rank_by_hand(values):
    return sorted(values)[len(values) - len(values) // 4 - 1]


@pytest.mark.parametrize("values, expected", [([1, 2, 3, 4], 3), ([5], 5), ([2, 2, 2, 9], 2)])
def test_quartile(spark, values, expected):
    assert quantile.upper_quartile(scored(spark, values)).first()["threshold"] == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.integers(-3000, 3000), st.floats(-5000, 5000)), min_size=1, max_size=60))
def test_quartile_equals_sorted_rank(spark, values):
    got = quantile.upper_quartile(scored(spark, values)).first()
    assert (got["rows"], got["threshold"]) == (len(values), rank_by_hand(list(map(float, values))))


def test_quartile_by_group_with_one_hot_group(spark):
    draw = random.Random(3)
    groups = ["hot" if draw.random() < 0.5 else f"g{draw.randrange(6)}" for _ in range(600)]
    values = [draw.randrange(-4000, 4000) if draw.random() < 0.7 else 1 for _ in range(600)]
    got = quantile.upper_quartile(scored(spark, values, groups.__getitem__), by=["subreddit"]).collect()
    for row in got:
        own = [v for v, g in zip(values, groups) if g == row["subreddit"]]
        assert row["threshold"] == rank_by_hand(own)
        assert (row["rows"], row["max_score"]) == (len(own), max(own))
    assert len(got) == len(set(groups))


def test_quartile_of_nothing(spark):
    assert quantile.upper_quartile(scored(spark, [])).count() == 0


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=40),
    st.integers(1, 45),
)
def test_value_at_rank(spark, values, rank):
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    got = quantile.value_at_rank(df, "k", rank)
    assert got == (sorted(values)[rank - 1] if rank <= len(values) else None)


def test_value_at_rank_of_doubles(spark):
    values = [0.1 * i * i for i in range(50)] + [7.0] * 30 + [-1.7e308, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "k double")
    for rank in (1, 2, 9, 10, 40, 80, 82):
        assert quantile.value_at_rank(df, "k", rank) == sorted(values)[rank - 1]


def test_first_rows(spark):
    df = spark.range(0, 3000, 3).repartition(5)
    kept = [row["id"] for row in filters.first_rows(df, 10).collect()]
    assert sorted(kept) == list(range(0, 30, 3))
    assert filters.first_rows(df, 5000).count() == 1000
    assert filters.first_rows(df, -1).count() == 1000


def test_first_rows_of_text_keys(spark):
    df = spark.range(1000).select(F.conv("id", 10, 36).alias("id"))
    first = {row["id"] for row in filters.first_rows(df.repartition(3), 100).collect()}
    second = {row["id"] for row in filters.first_rows(df.repartition(7), 100).collect()}
    assert len(first) == 100 and first == second
    split = {row["id"]: row["part"] for row in splits.ordered_split(df).collect()}
    assert {i for i in split if split[i] == "train"} == set(sorted(split)[:600])


def test_labels(spark):
    labelled = labels.with_binary_label(scored(spark, [1, 2, 3, 4])).orderBy("id").collect()
    assert [row["score_bucket"] for row in labelled] == [0.0, 0.0, 0.0, 1.0]
    assert labels.with_binary_label(scored(spark, [5])).first()["score_bucket"] == 0.0


def test_distributions(spark):
    df = scored(spark, [-3, 0, 1, 2, 3, 4, 7, 8])
    binary = counts.binary_distribution(df, 3.0).first()
    assert (binary["below"], binary["above"], binary["above_share"]) == (5, 3, 0.375)
    buckets = counts.class_distribution(labels.with_log_bucket(df)).collect()
    assert [(r["bucket"], r["low"], r["high"], r["comments"]) for r in buckets] == [
        (0.0, -1, -1, 2),
        (1.0, 1, 2, 1),
        (2.0, 2, 4, 2),
        (3.0, 4, 8, 2),
        (4.0, 8, 16, 1),
    ]
    assert counts.majority_baseline(labels.with_log_bucket(df)).first()["baseline"] == 0.25


WORDS = [
    (1, ["good", "x", "bad", "good"]),
    (2, ["meh", "good"]),
    (3, ["", "y"]),
    (4, []),
    (5, ["meh"]),
]


def test_sentiment(spark):
    df = spark.createDataFrame(WORDS, "id int, words array<string>")
    lex = lexicon_frame(spark, LEXICON)
    got = lexicon.with_sentiment(df, lex).orderBy("id").collect()
    assert [row["sentiment"] for row in got] == [1.0, 1.5, 0.0, 0.0, 0.0]
    got = lexicon.with_sentiment(df, lex, skip_zero=True).orderBy("id").collect()
    assert [row["sentiment"] for row in got] == [1.0, 3.0, 0.0, 0.0, 0.0]


def test_repeated_lexicon_words_and_null_tokens(spark):
    df = spark.createDataFrame([(1, ["good", "good"]), (2, None), (3, ["x"])], "id int, words array<string>")
    twice = spark.createDataFrame([("good", 2), ("good", 4), (None, 1), ("x", None)], "word string, valence int")
    got = lexicon.with_sentiment(df, twice).orderBy("id").collect()
    assert [row["sentiment"] for row in got] == [4.0, 0.0, 0.0]
    assert [row["filtered"] for row in lexicon.with_lexicon_words(df, twice).collect()] == [["good", "good"]]
    assert [tuple(row) for row in lexicon.lexicon_hits(df, twice).collect()] == [("good", 4, 2)]


def test_lexicon_filter_keeps_order_and_drops_rows(spark):
    df = spark.createDataFrame(WORDS, "id int, words array<string>")
    kept = lexicon.with_lexicon_words(df, lexicon_frame(spark, LEXICON)).orderBy("id")
    assert [(row["id"], row["filtered"]) for row in kept.collect()] == [
        (1, ["good", "bad", "good"]),
        (2, ["meh", "good"]),
        (5, ["meh"]),
    ]


def test_lexicon_of_zero_valences_only(spark):
    df = spark.createDataFrame(WORDS, "id int, words array<string>")
    got = lexicon.with_sentiment(df, lexicon_frame(spark, {"meh": 0}), skip_zero=True)
    assert {row["sentiment"] for row in got.collect()} == {0.0}


def test_hash_split_does_not_depend_on_layout(spark):
    ids = spark.range(5000)
    first = {r["id"]: r["part"] for r in splits.hash_split(ids.repartition(3)).collect()}
    second = {r["id"]: r["part"] for r in splits.hash_split(ids.repartition(17, "id")).collect()}
    assert first == second
    share = sum(part == splits.TRAIN for part in first.values()) / 5000
    assert abs(share - 0.7) < 0.03


def test_ordered_split(spark):
    parts = splits.ordered_split(spark.range(7).repartition(3)).orderBy("id").collect()
    assert [row["part"] for row in parts] == ["train"] * 4 + ["test"] * 3


def test_random_split_loses_no_row(spark):
    assert splits.random_split(spark.range(500)).select("id").distinct().count() == 500


def digest(term):
    return hashlib.md5(term.encode()).hexdigest()[:15]


def test_top_terms_breaks_ties_by_digest(spark):
    rows = [(1, ["b", "a", "c", "c"]), (2, ["b", "a", "d"])]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    best = vocabulary.top_terms(vocabulary.term_uses(df), 3).collect()
    assert {(r["term"], r["uses"]) for r in best} == {("a", 2), ("b", 2), ("c", 2)}
    two = {r["term"] for r in vocabulary.top_terms(vocabulary.term_uses(df), 2).collect()}
    assert two == set(sorted("abc", key=digest)[:2])


def test_row_cap_cuts_rows_of_one_key(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "id bigint")
    assert [r["id"] for r in filters.first_rows(df, 2).collect()] == [1, 1]


def test_top_terms_of_groups_equal_a_sort(spark):
    draw = random.Random(5)
    rows = [(g, [f"w{draw.randrange(200)}" for _ in range(300)]) for g in "xyz"]
    df = spark.createDataFrame(rows, "g string, words array<string>")
    uses = vocabulary.term_uses(df, by=["g"])
    got = vocabulary.top_terms(uses, 20, by=["g"]).collect()
    for group, words in rows:
        ranked = sorted(set(words), key=lambda w: (-words.count(w), digest(w)))[:20]
        assert {r["term"] for r in got if r["g"] == group} == set(ranked)


def test_split_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "HOT_SHARE", 4)
    draw = random.Random(9)
    words = ["hot"] * 500 + [f"w{draw.randrange(50)}" for _ in range(500)]
    terms = spark.createDataFrame(list(enumerate(words)), "id int, term string")
    table = vocabulary.term_uses(terms.select(F.array("term").alias("words"))).withColumn("v", F.length("term"))
    joined = vocabulary.join_on_term(terms, table)
    plain = terms.join(table, "term").select("term", "id", "v")
    assert sorted(map(tuple, joined.select("term", "id", "v").collect())) == sorted(map(tuple, plain.collect()))
    hot = table.where(F.col("uses") * 4 > 1000).collect()
    assert [row["term"] for row in hot] == ["hot"]


def test_term_statistics(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, [])], "id int, words array<string>")
    stats = {r["term"]: (r["uses"], r["doc_freq"], r["idf"]) for r in vocabulary.idf_weights(df).collect()}
    assert stats == {"a": (3, 2, math.log(4 / 3)), "b": (1, 1, math.log(4 / 2))}


def test_explain_weights_names_and_ties(spark):
    rows = explain.explain_weights(spark, [0.5, -1.0, 0.5, 2.0], ["word a", "word b"], 2).collect()
    assert [(r["side"], r["feature"]) for r in rows] == [
        ("top", "Feature 3"),
        ("top", "word a"),
        ("bottom", "word b"),
        ("bottom", "word a"),
    ]


def test_terms_are_counted_in_their_row(spark):
    """No group of (key, term) is held unless rows share their key; those are added up."""
    from scorelens.operators.vocabulary import term_frequencies

    schema = "id bigint, words array<string>"
    single = spark.createDataFrame([(1, ["b", "a", "b", ""]), (2, []), (3, None), (4, ["a", None])], schema)
    found = term_frequencies(single)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "", 1), (1, "a", 1), (1, "b", 2), (4, "a", 1), (4, None, 1)}
    shared = spark.createDataFrame([(1, ["b", "a"]), (1, ["b"]), (None, ["c"]), (None, ["c", "d"]), (2, ["a"])], schema)
    found = sorted(map(str, map(tuple, term_frequencies(shared).collect())))
    assert found == ["(1, 'a', 1)", "(1, 'b', 2)", "(2, 'a', 1)", "(None, 'c', 2)", "(None, 'd', 1)"]


def test_a_small_lexicon_is_broadcast_from_the_first_plan(spark):
    """Tokens would be dealt out before the size of an unwritten lexicon is known."""
    from scorelens.operators import lexicon
    from scorelens.sources.readers import lexicon_frame

    rows = spark.createDataFrame([(1, ["good", "x"]), (2, ["y"])], "id bigint, words array<string>")
    for found in (lexicon.with_lexicon_words(rows, lexicon_frame(spark, {"good": 3})), lexicon.with_sentiment(rows, lexicon_frame(spark, {"good": 3}))):
        assert "BroadcastHashJoin [word" in found._jdf.queryExecution().executedPlan().toString()


def test_sums_over_packed_rows(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from scorelens.functions.vectors import nonzero_slots
    from scorelens.operators.packed import packed, slot_moments

    rows = [(float(i), Vectors.sparse(5, {i % 4: i + 1.0}) if i % 3 else Vectors.dense([0, 0, 0, 0, i])) for i in range(50)]
    df = spark.createDataFrame(rows, ["y", "v"])
    records = packed(df, F.col("y"), nonzero_slots("v"), "test-packed")
    # A record holds many rows: no value is turned to a row and to Arrow in a pass.
    assert records.count() < 50 and {f.dataType.simpleString() for f in records.schema} == {"binary"}
    count, moments = slot_moments(records, 5)
    x, y = np.array([v.toArray() for _, v in rows]), np.array([y for y, _ in rows])
    assert count == 50 and np.allclose(moments, np.column_stack([x.sum(0), (x * x).sum(0), y @ x]))
    count, moments = slot_moments(packed(df.where("false"), F.col("y"), nonzero_slots("v"), "test-packed"), 5)
    assert count == 0 and not moments.any()
