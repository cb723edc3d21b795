"""Penalty paths, grouped systems and order statistics against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scorelens.operators import least_squares
from scorelens.operators.filters import first_rows
from scorelens.operators.quantile import Place, place_of_rank, value_at_rank
from scorelens.operators.splits import ordered_split

WIDTH = 7


@pytest.fixture(scope="module")
def design(spark):
    """Correlated columns, one constant, one always zero."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, WIDTH)) * (rng.random((120, WIDTH)) < 0.6)
    x[:, 2] = x[:, 0] + 0.3 * rng.normal(size=120)
    x[:, 5], x[:, 6] = 3.0, 0.0
    y = 4 + x @ np.arange(WIDTH) + rng.normal(size=120)
    rows = [(i, float(v), Vectors.sparse(WIDTH, [(j, float(r[j])) for j in np.flatnonzero(r)])) for i, (v, r) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, ["id", "y", "features"]).repartition(3).cache()


def ridge(x, y, reg):
    sd = x.std(axis=0)
    used = sd > 1e-9
    z = (x[:, used] - x[:, used].mean(axis=0)) / sd[used]
    a = z.T @ z / len(y) + reg / y.std() * np.eye(used.sum())
    w = np.zeros(x.shape[1])
    w[used] = np.linalg.solve(a, z.T @ (y - y.mean()) / len(y)) / sd[used]
    return y.mean() - w @ x.mean(axis=0), w


@pytest.mark.parametrize("dense", [0, 512])
def test_path_equals_single_systems(design, monkeypatch, dense):
    x, y, df = design
    monkeypatch.setattr(least_squares, "DENSE", dense)
    regs = (2.0, 0.0, 0.125, 8.0)
    for reg, (intercept, w) in zip(regs, least_squares.solve_path(df, "y", "features", WIDTH, regs, tolerance=1e-12)):
        expected = ridge(x, y, reg)
        assert np.isclose(intercept, expected[0]) and np.allclose(w, expected[1], atol=1e-7)


def test_wide_path_without_penalty_fits_all_rows(spark):
    """More slots than rows: the answer is found among the shortest."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 40))
    y = rng.normal(size=12)
    df = spark.createDataFrame([(float(v), Vectors.dense(r.tolist())) for v, r in zip(y, x)], ["y", "features"])
    ((intercept, w),) = least_squares._wide_path(
        df.select("y", least_squares.nonzero_slots("features").alias("entries")), 40, [0.0], 1e-10, 300
    )
    assert np.allclose(x @ w + intercept, y, atol=1e-6)


def test_constant_score(spark):
    df = spark.createDataFrame([(2.0, Vectors.dense([float(i), 1.0])) for i in range(5)], ["y", "features"])
    for intercept, w in least_squares.solve_path(df, "y", "features", 2, [0.0, 1.0]):
        assert intercept == 2.0 and not w.any()


def test_groups_equal_single_systems(spark, monkeypatch):
    monkeypatch.setattr(least_squares, "HELD_CELLS", 20)
    rng = np.random.default_rng(7)
    rows = [(["a", "b", "c", None][min(int(rng.exponential(0.7)), 3)], float(rng.normal()), rng.normal(size=3).tolist()) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y double, x array<double>").repartition(4)
    for r in least_squares.solve_by_group(df, ["g"], 0.5).collect():
        x = np.array([v for g, _, v in rows if g == r.g])
        y = np.array([v for g, v, _ in rows if g == r.g])
        expected = ridge(x, y, 0.5)
        assert np.isclose(r.intercept, expected[0]) and np.allclose(r.weights, expected[1])


def test_stochastic_steps_repeat_and_skip_empty_batches(design):
    _, _, df = design
    one, two = (least_squares.stochastic_steps(df.repartition(n), "y", "features", WIDTH, 4, 0.5, 40) for n in (1, 5))
    assert np.allclose(one[1], two[1])
    intercept, w = least_squares.stochastic_steps(df, "y", "features", WIDTH, 2, 0.5, 0)
    assert intercept == 0 and not w.any()


TEXTS = ["", "a", "a", "aa", "ab", "a\x00", "b", "é", "ê", "\U0001f600", "zz", "common/prefix/1", "common/prefix/2", "common/prefix/2"]


def test_rank_of_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS + [None]], "k string").repartition(3)
    ordered = sorted(TEXTS, key=lambda t: t.encode())
    for rank, text in enumerate(ordered, 1):
        assert value_at_rank(df, "k", rank) == text
    assert value_at_rank(df, "k", len(TEXTS) + 1) is None and value_at_rank(df.where("false"), "k", 1) is None
    assert place_of_rank(df, "k", ordered.index("a") + 2) == Place("a", 2, 2)


def test_ordered_split_of_texts(spark):
    names = [f"t3_{i:x}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "id string")
    found = {r.id: r.part for r in ordered_split(df).collect()}
    assert {n for n in found if found[n] == "train"} == set(sorted(names)[:30])


@pytest.mark.parametrize("n", [1, 3, 7, 10, 23, 39, 40, 50])
def test_cap_is_exact_on_repeated_rows(spark, n):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2, 3]), rng.choice(["x", "y"])) for _ in range(40)] + [(None, "x")]
    df = spark.createDataFrame(rows, "id bigint, body string").repartition(3)
    kept = first_rows(df, n).collect()
    assert len(kept) == min(n, 40)
    ids = sorted(r.id for r in kept)
    assert ids == sorted(i for i, _ in rows if i is not None)[: len(ids)]
    assert first_rows(df, n).exceptAll(df).count() == 0 and first_rows(df, 0).count() == 41
    assert first_rows(df.withColumn("id", F.col("id").cast("string")), n).count() == min(n, 40)


def test_wide_path_goes_on_until_it_is_settled(spark, monkeypatch):
    """Spreads of two and a half orders of magnitude: every system, that without penalty too, is settled, however many steps it takes."""
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.normal(size=(600, 600)))[0]
    x = rng.normal(size=(700, 600)) * np.geomspace(1, 3e-3, 600) @ turn
    y = x @ turn.T @ rng.normal(size=600) + rng.normal(size=700)
    c, steps = x - x.mean(axis=0), []
    moments = np.column_stack([x.sum(axis=0), (x * x).sum(axis=0), x.T @ y])
    monkeypatch.setattr(least_squares, "slot_moments", lambda records, width: (700, moments))
    monkeypatch.setattr(least_squares, "times_covariance", lambda records, q, mean, rows: steps.append(1) or c.T @ (c @ q) / (rows - 1))
    df = spark.createDataFrame([(float(v), Vectors.dense([1.0])) for v in y], ["y", "features"])
    regs = (0.0, 0.125, 8.0)
    found = least_squares.solve_path(df, "y", "features", 600, regs)
    z = c / x.std(axis=0)
    for reg, (intercept, w) in zip(regs, found):
        left = z.T @ (y - x @ w - intercept) / 700 - reg / y.std() * w * x.std(axis=0)
        assert np.linalg.norm(left) <= (1.1e-4 if reg else 1.1e-3) * np.linalg.norm(z.T @ (y - y.mean()) / 700)
    assert len(steps) > 100
    with pytest.raises(ArithmeticError):
        least_squares.solve_path(df, "y", "features", 600, regs, most=20)
