import zlib
from collections import Counter

from conftest import EDGE_ROWS, frame, prose

from scorelens.llm import sharding


def test_edges(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 20_000)
    got = sharding.shard_digests(edge, 4).collect()
    expected = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in EDGE_ROWS), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == expected
    counts = Counter(r.shard for r in got)
    assert set(counts) == {0, 1, 2, 3} and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    sharding.write_shards(edge.withColumn("slot", edge.n_chars), f"{tmp_path}/out", 4)
    read = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(read.columns) == sorted([*edge.columns, "slot", "shard"])
    assert sorted(map(repr, (r.text for r in read.collect()))) == sorted(repr(t) for _, t in EDGE_ROWS)


def test_same_seed_same_order(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 5_000)
    rows = [(i, prose(20, i)) for i in range(300)]
    place = lambda docs, seed: sorted((r.shard, r.slot, r.doc_id) for r in sharding.shard_digests(docs, 8, seed).collect())
    first = place(frame(spark, rows).repartition(5), 1)
    assert first == place(frame(spark, rows[::-1]).repartition(2), 1)
    assert first != place(frame(spark, rows), 2)
    ids = [d for _, _, d in first]
    assert abs(sum(a < b for a, b in zip(ids, ids[1:])) - 150) < 40


def test_copies_are_scattered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 4_000)
    rows = [(i, "the same text") for i in range(400)] + [(i, prose(10, i)) for i in range(400, 800)]
    got = sharding.shard_digests(frame(spark, rows)).collect()
    assert all(25 <= sum(r.doc_id < 400 for r in got if r.shard == s) <= 75 for s in range(8))


def test_equal_rows_are_scattered_and_starts_add_up(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 500)
    monkeypatch.setattr(sharding, "COPIES", 50)
    monkeypatch.setattr(sharding, "CELL", 4)
    taken = []
    shuffle = sharding._starts
    monkeypatch.setattr(sharding, "_starts", lambda sizes: taken.append(sizes) or shuffle(sizes))
    rows = [(None, None)] * 600 + [(i, prose(10, i)) for i in range(200)]
    got = sharding.shard_digests(frame(spark, rows)).collect()
    sizes = sorted((r.shuffle_bucket, r.n) for r in taken[0].collect())
    assert sum(n for _, n in sizes) == 800 and max(n for _, n in sizes) < 80
    before = {r.shuffle_bucket: r.shuffle_before for r in shuffle(taken[0]).collect()}
    assert before == {b: sum(n for c, n in sizes if c < b) for b, _ in sizes}
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(8) for i in range(100)]
    assert sum(r.doc_id is None for r in got) == 600


def test_empty(empty):
    assert sharding.shard_digests(empty).count() == 0
