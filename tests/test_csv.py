"""The split reading of CSV files against the csv module."""

import csv
import random

import pytest

from scorelens.sources.readers import read_csv_comments

PIECES = ["word", '"', '""', ",", "\n", "\n\n", "é", "x" * 60, "\r", " "]


def text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))


def written(path, rows, **options):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL, **options).writerows(rows)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(3))
def test_one_file_in_many_splits(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(str(i), text(rng)) for i in range(80)] + [("long", "a\n" * 400), ("end", "e")]
    written(tmp_path / "a.csv", [("id", "body"), *rows])
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
    found = read_csv_comments(spark, str(tmp_path / "a.csv"))
    assert found.columns == ["id", "body"]
    assert sorted((r.id, r.body or "") for r in found.collect()) == sorted(rows)


def test_several_files(spark, tmp_path):
    for name in ("a", "b"):
        written(tmp_path / f"{name}.csv", [("id", "odd `name`"), (name, "one\ntwo"), (name + "2", '"')])
    found = read_csv_comments(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("a", "one\ntwo"), ("a2", '"'), ("b", "one\ntwo"), ("b2", '"')]


def test_only_a_header(spark, tmp_path):
    written(tmp_path / "a.csv", [("id", "body")])
    found = read_csv_comments(spark, str(tmp_path / "a.csv"))
    assert found.columns == ["id", "body"] and found.count() == 0


def test_no_frame_is_gone_through_anew_for_every_row(spark, tmp_path):
    written(tmp_path / "a.csv", [("id", "body"), ("a", "one\ntwo")])
    plan = read_csv_comments(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "unboundedfollowing" not in plan
