import numpy as np
import pytest
from brute import remainder
from conftest import EDGE_ROWS

from scorelens.llm import quality
from scorelens.llm.queries import op3_quality


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, text string")


GOOD_AND_BAD = [(d, int(d is not None and d % 2 == 0), "t") for d, _ in EDGE_ROWS] + [(1, 1, "t"), (None, 1, "t"), (3, None, "t")]


def test_edges(spark, edge, empty):
    got = quality.quality_scores(edge, labels(spark, GOOD_AND_BAD)).collect()
    assert sorted((repr(r.doc_id), r.held_out) for r in got) == sorted((repr(d), remainder(d, 4) == 2) for d, _ in EDGE_ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(empty, labels(spark, GOOD_AND_BAD)).count() == 0
    kept = quality.keep_good(edge, labels(spark, GOOD_AND_BAD))
    assert kept.schema == edge.schema
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if r.score >= 0.5)


@pytest.mark.parametrize(("rows", "score"), [([], 0.5), ([(1, 1, "t")], 1.0), ([(1, 0, "t"), (4, 0, "t")], 0.0)])
def test_too_few_labels(spark, edge, rows, score):
    assert {r.score for r in quality.quality_scores(edge, labels(spark, rows)).collect()} == {score}


@pytest.mark.parametrize("rows", [[], [(1, 1, "t")], [(1, 0, "t"), (4, 0, "t")]])
def test_one_class_rejects_nothing(spark, edge, rows):
    assert quality.keep_good(edge, labels(spark, rows)).count() == len(EDGE_ROWS)


def test_no_statistic_jumps_with_the_length():
    x = np.array([quality.statistics(" ".join(f"w{i % 150}" for i in range(n)).encode()) for n in range(190, 211)])
    assert np.abs(np.diff(x, axis=0)).max() < 0.01


def test_moments_and_density():
    rng = np.random.default_rng(1)
    d = quality.STATISTICS
    x = {0: rng.normal(1, 2, (300, d)), 1: rng.normal(0, 1, (900, d))}
    model = quality.discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, 0.25)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 1200
    logs = []
    for k in (0, 1):
        c = 0.75 * np.cov(x[k].T, bias=True) + 0.25 * pooled + quality.RIDGE * np.eye(d)
        gap = x[0] - x[k].mean(axis=0)
        distance = (gap * np.linalg.solve(c, gap.T).T).sum(axis=1)
        logs.append(np.log(len(x[k]) / 1200) - 0.5 * (np.linalg.slogdet(c)[1] + distance))
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_are_finite():
    for _, text in EDGE_ROWS:
        x = quality.statistics(None if text is None else text.encode())
        assert len(x) == quality.STATISTICS and np.isfinite(x).all()
    assert quality.statistics(None) == quality.statistics(b"")


def test_held_out_accuracy(spark):
    """On the driver's own rows: what the labels of the other part teach holds for the held-out one."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op3_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95
