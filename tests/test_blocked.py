"""The blocked fit against the closed form, and an experiment that holds neither weights nor terms on the driver."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from scorelens.operators import blocked
from scorelens.plans import models
from scorelens.plans.experiments import report_experiment
from scorelens.plans.stages import WrittenVocabularyModel
from scorelens.sources.readers import lexicon_frame


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocked, "LEAST", 7)
    monkeypatch.setattr(blocked, "BLOCKS", 4)


def test_blocked_fit_equals_closed_form(spark, small_blocks):
    """Sparse and dense rows, an empty one, equal ones, a feature without variance, one that is never there and one far from zero."""
    draw = np.random.default_rng(5)
    x = draw.poisson(0.2, size=(43, 90)) * draw.uniform(0.2, 4, 90)
    x[:, 3], x[:, 50], x[:, 8] = 2.0, 0.0, 500 + draw.normal(size=43)
    x[11] = x[12]
    x[5, [j for j in range(90) if j not in (3, 8)]] = 0
    y = x[:, :10] @ draw.normal(size=10) + draw.normal(size=43)
    y[11] = y[12]
    vector = lambda i, r: Vectors.dense(r) if i % 5 == 0 else Vectors.sparse(90, {int(j): float(r[j]) for j in np.flatnonzero(r)})
    rows = [(i if i % 7 else None, vector(i, r), float(y[i])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features", "score_double"])
    df = df.repartition(3)
    held = spark.conf.get(blocked.BATCH_CONF)
    model = blocked.fit_linear(df, "score_double", "features", 90, 4.0, tolerance=1e-10)
    sd, c = x.std(axis=0, ddof=1), y - y.mean()
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    expected = np.linalg.solve(z.T @ z / 43 + 4.0 / y.std(ddof=1) * np.eye(90), z.T @ c / 43) / np.where(sd > 0, sd, 1)
    found = model.weights().orderBy("slot").collect()
    assert [row["slot"] for row in found] == list(range(90))
    np.testing.assert_allclose([row["weight"] for row in found], expected, atol=1e-7)
    assert math.isclose(model.intercept, y.mean() - x.mean(axis=0) @ expected, rel_tol=1e-5)
    scored = model.transform(df)
    assert scored.columns == [*df.columns, "prediction"] and scored.count() == 43
    got = sorted(row["prediction"] for row in scored.collect())
    np.testing.assert_allclose(got, np.sort(y.mean() + (x - x.mean(axis=0)) @ expected), atol=1e-5)
    assert spark.conf.get(blocked.BATCH_CONF) == held and not [t for t in spark.catalog.listTables() if t.name.startswith("scorelens_")]


def test_equal_labels_weigh_nothing(spark):
    df = spark.createDataFrame([(1, Vectors.dense([1.0, 0.0]), 3.0), (2, Vectors.dense([0.0, 2.0]), 3.0)], ["id", "features", "score_double"])
    model = blocked.fit_linear(df, "score_double", "features", 2, 1.0)
    assert [row["weight"] for row in model.weights().collect()] == [0.0, 0.0] and model.intercept == 3.0


def test_wide_weights_and_terms_stay_off_the_driver(spark, monkeypatch):
    """The report is that of Spark's own fit, but the term list is never asked for."""
    draw = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, f"best {' '.join(draw.choice(words, 6))} http://x.example.com", "a", "3600", str(int(draw.integers(0, 50)))) for i in range(25)]
    view = spark.createDataFrame(rows, "id long, body string, author string, created_utc string, score string")
    options = {"plan": "record", "mode": "linear", "buckets": None, "reg_param": 8.0, "split": "ordered", "lexicon": lexicon_frame(spark, {"best": 3})}
    held = report_experiment(view, **options)
    before, named = held.metrics.collect(), {(r["slot"], r["feature"]) for r in held.weights.collect()}
    monkeypatch.setattr(models, "HELD_TERMS", 10)
    monkeypatch.setattr(WrittenVocabularyModel, "vocabulary", property(lambda self: pytest.fail("all terms on the driver")))
    wide = report_experiment(view, **options)
    for a, b in zip(before, wide.metrics.collect(), strict=True):
        assert a["metric"] == b["metric"] and math.isclose(a["value"], b["value"], rel_tol=0.05)
    found = wide.weights.collect()
    slots = dict(named)
    assert len(found) == 20 and all(slots.get(r["slot"], r["feature"]) == r["feature"] for r in found)
    assert {r["feature"] for r in found if r["slot"] < 5} <= {"body_chars", "link_count", "space_words", "space_word_length", "sentiment"}
