"""What a task holds and what stays on disk: records of a megabyte, groups of a fit, and the copies that a written bag needs."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from scorelens import session
from scorelens.operators import logistic, packed
from scorelens.plans import features, stages
from scorelens.plans.features import feature_plan, fit_features
from scorelens.sources.readers import lexicon_frame


def test_records_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(packed, "FILE_GROUP", 2**16)
    rows = spark.range(0, 200, 1, 1).select("id", F.expr("repeat(cast(uuid() as string), 200)").cast("binary").alias("v"))
    held = packed.settle_records(rows, "test-records")
    (file,) = held.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file:")).num_row_groups > 10

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    before = [spark.conf.get(conf) for conf in (packed.BATCH_CONF, packed.READER_CONF)]
    with packed.small_batches(spark):
        assert max(r.n for r in held.mapInArrow(sizes, "n long").collect()) <= packed.BATCH
    assert [spark.conf.get(conf) for conf in (packed.BATCH_CONF, packed.READER_CONF)] == before


def test_counts_of_a_group_take_a_byte_and_fit_the_same(spark):
    assert logistic._small(np.array([1.0, 255.0])).dtype == "uint8"
    for odd in ([1.5], [-1.0], [256.0], [np.nan]):
        assert logistic._small(np.array(odd)).dtype == "float64"
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, size=(60, 3)) * (draw.random((60, 3)) < 0.7)
    y = (x @ [1, -1, 0.5] + draw.normal(size=60) > 0).astype(float)

    def fit(factor):
        rows = [("a", float(v), [(j, float(c * factor)) for j, c in enumerate(r) if c]) for v, r in zip(y, x)]
        df = spark.createDataFrame(rows, "g string, y double, entries array<struct<slot:int,value:double>>")
        return logistic.fit_groups(df, ["g"], 0.5).first()

    one, many, broken = fit(1), fit(25), fit(0.25)
    np.testing.assert_allclose(np.array(many.weights) * 25, one.weights, rtol=1e-4)
    np.testing.assert_allclose(np.array(broken.weights) * 0.25, one.weights, rtol=1e-4)


def test_a_written_bag_leaves_only_its_vectors(spark, monkeypatch):
    for module in (stages, features):
        monkeypatch.setattr(module, "HELD_TERMS", 2)
    rows = [(i if i % 4 else None, f"best {w} other {w} http://x.example.com", "a", "3600", str(i)) for i, w in enumerate("pqrpqrxyz")]
    view = spark.createDataFrame(rows, "id long, body string, author string, created_utc string, score string")
    fitted = fit_features(view, feature_plan("record", buckets=None, lexicon=lexicon_frame(spark, {"best": 3})))
    wanted = sorted(map(str, fitted.transform(view).select("id", "features").collect()))
    folder = Path(session.shared_folder(spark))
    before = set(folder.iterdir())
    found = fitted.narrow(view, "id", "features")
    assert sorted(map(str, found.collect())) == wanted
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left.isdisjoint({"scorelens-bag-rows", "scorelens-bag-counts", "scorelens-bags"}) and "scorelens-assembled" in left
    assert "body" not in spark.read.parquet(str(next(p for p in set(folder.iterdir()) - before if "assembled" in p.name))).columns
