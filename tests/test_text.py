import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelens.functions import scores, text


def rows(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id int, body string")


def one_by_one(spark, bodies, expression):
    result = rows(spark, bodies).select("id", expression.alias("out")).orderBy("id").collect()
    return [row["out"] for row in result]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("a  b ", ["a", "", "b"]),
        ("  ", []),
        ("", [""]),
        (" a", ["", "a"]),
        ("Aw :(", ["aw", ":("]),
        ("one\ttwo\nthree\r\n", ["one", "two", "three"]),
    ],
)
def test_raw_tokens(spark, body, expected):
    assert one_by_one(spark, [body], text.raw_tokens(F.col("body"))) == [expected]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("Aw :(", ["aw", ""]),
        ("", [""]),
        ("  ", []),
        ("Don't stop_now", ["dont", "stopnow"]),
        ("été 3,5", ["t", "35"]),
        ("... --", ["", ""]),
    ],
)
def test_clean_tokens(spark, body, expected):
    assert one_by_one(spark, [body], text.clean_tokens(F.col("body"))) == [expected]


def tokens_by_hand(body):
    """Split the lower-cased body at each blank, cut trailing empties, then clean each token."""
    if body == "":
        return [""]
    pieces = re.split("[ \t\n\x0b\f\r]", body.lower())
    while pieces and pieces[-1] == "":
        pieces.pop()
    return [re.sub("[^A-Za-z0-9]", "", piece) for piece in pieces]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aZ9_é!? .\t\n\x0b'", max_size=30), min_size=1, max_size=20))
def test_cleaning_at_once_equals_cleaning_each_token(spark, bodies):
    assert one_by_one(spark, bodies, text.clean_tokens(F.col("body"))) == list(map(tokens_by_hand, bodies))


def test_null_body_stays_null(spark):
    df = spark.createDataFrame([(None,)], "body string")
    body = F.col("body")
    row = df.select(text.clean_tokens(body).alias("w"), text.link_count(body).alias("n")).first()
    assert row["w"] is None and row["n"] is None


def test_counts_of_blank_and_empty_bodies(spark):
    df = rows(spark, ["  ", "", "ab c"]).withColumn("w", text.clean_tokens(F.col("body")))
    w = F.col("w")
    count, chars = text.words_count(w), text.chars_count(w)
    got = df.select("id", count, chars, text.mean_or_zero(chars, count)).orderBy("id").collect()
    assert [tuple(row)[1:] for row in got] == [(0, 0, 0.0), (1, 0, 0.0), (2, 3, 1.5)]


def test_links(spark):
    cases = {
        "no address at all": 0,
        "http://one.test": 1,
        "(https://in.brackets.net), [http://xy.org/p]": 2,
        "https://ab.io:8443/path?q=1&r=%20#frag": 1,
        "HTTP://UPPER.EXAMPLE.COM and Http://mixed.com": 0,
        "http://nodomain and http://x.c and https://": 0,
        "http://same.org http://same.org http://same.org": 3,
        "ftp://files.example.org www.example.org": 0,
        "": 0,
    }
    assert one_by_one(spark, list(cases), text.link_count(F.col("body"))) == list(cases.values())


def test_punctuation_and_spaces(spark):
    body = F.col("body")
    df = rows(spark, ["what?! no??", "a  b c"])
    got = df.select(
        text.char_count(body, "?"),
        text.char_count(body, "!"),
        text.space_words_count(body),
        text.space_word_length(body),
    ).collect()
    assert [tuple(row) for row in got] == [(3, 1, 2, 5.0), (0, 0, 4, 0.75)]


def test_hour_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        df = spark.createDataFrame([("0",), ("3600",), ("86399",), ("-1",), ("x",)], "t string")
        hours = [row[0] for row in df.select(text.hour_of_day(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert hours == [0.0, 1.0, 23.0, 23.0, None]


def test_word_runs(spark):
    got = one_by_one(spark, ["It's a déjà_vu, x 42!"], text.word_runs(F.col("body")))
    assert got == [["it", "déjà_vu", "42"]]


def test_log_buckets(spark):
    given_scores = [-3, 0, 1, 2, 3, 4, 7, 8]
    df = spark.createDataFrame([(float(s),) for s in given_scores], "s double")
    assert [row[0] for row in df.select(scores.log_bucket(F.col("s"))).collect()] == [0, 0, 1, 2, 2, 3, 3, 4]


def test_log_buckets_are_bit_lengths(spark):
    df = spark.range(1, 5000).withColumn("b", scores.log_bucket(F.col("id").cast("double")))
    assert all(row["b"] == int(row["id"]).bit_length() for row in df.collect())


def test_bucket_ranges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (4.0,), (31.0,), (1000.0,)], "b double")
    got = df.select(scores.bucket_low(F.col("b")), scores.bucket_high(F.col("b"))).collect()
    largest = 2**63 - 1
    assert [tuple(row) for row in got] == [(-1, -1), (1, 2), (8, 16), (2**30, 2**31), (largest, largest)]


def test_scores_that_are_no_numbers(spark):
    texts = ["3", "x", None, "-2.5", "NaN", "Infinity", "-Infinity", "1e400"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [row[0] for row in df.select(scores.score_double(F.col("s"))).collect()]
    assert got == [3.0, None, None, -2.5, None, None, None, None]
