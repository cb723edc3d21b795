"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one
and a small ridge. A score is the posterior of class 1 from the difference of
the Mahalanobis log-densities; the Cholesky factors are made once and travel
with the scoring task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.texts import only, slices
from scorelens.session import settle

SHRINK = 0.1
RIDGE = 1e-3
LEFT_OUT = 2
UPPERS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
STOPS, MARKS = b".,;:!?", b"#$%&*|<>{}[]=_~^\\/+@"
STATISTICS = 12


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of one whole text; a null one counts as empty.

    Shares are smoothed by a few neutral words, so that short texts come near
    the middle instead of the ends, and put on a log scale.
    """
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    gone = lambda drop: size - len(text.translate(None, drop))
    share = lambda count, prior, of: float(np.log((count + 4 * prior) / (of + 4)))
    letters = size - n
    return [
        float(np.log1p(n)),
        float(np.log((letters + 20) / (n + 4))),
        share(gone(UPPERS), 0.2, n),
        share(gone(DIGITS), 0.05, n),
        share(gone(STOPS), 0.15, n),
        share(gone(MARKS), 0.05, n),
        share(gone(b"!"), 0.01, n),
        share(sum(len(w) <= 3 for w in words), 0.4, n),
        # Longer texts repeat more words; the second term makes up for that.
        share(len(counts), 0.9, n) + 0.25 * float(np.log1p(n / 200)),
        share(max(counts.values(), default=0), 0.1, n),
        share(sum(map(eq, words, words[1:])), 0.01, n),
        share(sum(len(w) == 1 and w in b"#$%&*|<>{}[]=_~^\\/+@-" for w in words), 0.02, n),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x of every row."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for _, texts in slices(batch) for t in texts]
            x = pa.array(rows, pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), x], ["doc_id", "x"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(each, "doc_id bigint, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == LEFT_OUT, F.lit(False))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-weights of the two classes."""

    means: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = [
            w - 0.5 * np.square((x - m) @ half.T).sum(axis=1)
            for m, half, w in zip(self.means, self.whiten, self.weights)
        ]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> Discriminant:
    """From rows, sums and sums of products of each class."""
    rows = {k: n for k, (n, _, _) in moments.items()}
    means = {k: s / n for k, (n, s, _) in moments.items()}
    covariances = {k: p / n - np.outer(means[k], means[k]) for k, (n, _, p) in moments.items()}
    pooled = sum(rows[k] * covariances[k] for k in rows) / sum(rows.values())
    whiten, weights = [], []
    for k in (0, 1):
        mixed = (1 - shrink) * covariances[k] + shrink * pooled + RIDGE * np.eye(len(pooled))
        factor = np.linalg.cholesky(mixed)
        whiten.append(np.linalg.inv(factor))
        weights.append(np.log(rows[k] / sum(rows.values())) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array([means[0], means[1]]), np.array(whiten), np.array(weights))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | float:
    """The fitted model, or the share of class 1 as a constant score if a class has no row (0.5 without rows).

    All labelled rows outside the held-out part count; one aggregate gives the
    moments. Null labels and ids with contradicting labels teach nothing.
    """
    agreed = (
        labels.where(F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
    )
    d, x = STATISTICS, F.col("x")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    known = stats.where(~held_out(F.col("doc_id"))).join(agreed, "doc_id").groupBy("label")
    rows = known.agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(x[i]) for i in range(d))).alias("sums"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("products"),
    ).collect()
    moments = {}
    for row in rows:
        products = np.zeros((d, d))
        for (i, j), value in zip(pairs, row["products"]):
            products[i, j] = products[j, i] = value
        moments[int(row["label"])] = row["n"], np.array(row["sums"]), products
    if set(moments) == {0, 1}:
        return discriminant(moments)
    return float(sum(moments)) if moments else 0.5


def scored(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """doc_id and score (0 to 1, higher: class 1 likelier) of every row of described()."""
    if isinstance(model, float):
        return stats.select("doc_id", F.lit(model).alias("score"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(each, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score for every row; repeated rows and null ids are scored like any other."""
    stats = settle(described(docs), "statistics")
    return scored(stats, fit(stats, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is at least `least`, columns unchanged.

    Labels of one class only, or none, tell good from bad in no way: all rows
    stay then. An empty table gives an empty one.
    The model sees the statistics of the same rows; scoring then runs beside
    the row itself, so nothing is joined and repeated ids can't mix.
    """
    model = fit(settle(described(docs), "statistics"), labels)
    if isinstance(model, float):
        return docs

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for _, texts in slices(batch) for t in texts]
            if x:
                yield batch.filter(pa.array(model.score(np.array(x)) >= least))

    return docs.mapInArrow(each, docs.schema)
