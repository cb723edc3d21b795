"""Quotas against seats given out one by one; the whole mix against sums over its pieces."""

import heapq
import random
from collections import Counter, defaultdict

import pytest
from oracle_check import compare, connect

from brute import words
from scorelens.llm import mixing, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, source string, text string, size int, spot string, quota int, cell string, pieces int"


def table(spark, rows, parts=3):
    """With further columns under names that the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "s", 2, "c", 3) for r in rows], SCHEMA).repartition(parts)


def noisy(count, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        n = rng.choice([0, 1, 5, 40, 200])
        text = rng.choice([None, "", " \t\n", " ".join(f"w{i}.{j}" for j in range(n)), "é \x1c x"])
        out.append((rng.choice([i, i, None]), rng.choice(["b", "a", None, "", "é", "Z"]), text))
    return out + [(7, "a", "copy of one text")] * 30 + [(None, None, "w " * 3000)]


def filled(sizes):
    """Targets by taking sources out at their limit one at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    open_names = set(names)
    while open_names:
        level = left / sum(weight[s] for s in open_names)
        full = {s for s in open_names if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_names}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_names -= full
    return target


def highest_quotients(target, block):
    """Seats of each source when the highest quotients from block / 2 on get one, in that order."""
    heap = [(-t, s is None, s or "", 0) for s, t in target.items() if t > 0]
    heapq.heapify(heap)
    won = Counter()
    while heap:
        quotient, none, s, seat = heapq.heappop(heap)
        if -quotient < block / 2:
            break
        name = None if none else s
        won[name] += 1
        heapq.heappush(heap, (-target[name] / (2 * seat + 3), none, s, seat + 1))
    return won


def check(rows, found, block=mixing.BLOCK, shard_blocks=mixing.SHARD_BLOCKS):
    assert Counter((r.doc_id, r.source) for r in found) == Counter((d, s) for d, s, _ in rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(words(t))
    target = filled(sizes)
    taken, seats, shards = Counter(), defaultdict(Counter), defaultdict(set)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == sum(p.length for p in r.pieces) <= 2 * r.size
        covered = Counter()
        for p in r.pieces:
            assert 0 <= p.start and p.start + p.length <= r.size and p.length > 0
            covered.update(range(p.start, p.start + p.length))
            seats[r.source][p.seat] += p.length
            shards[r.source].add((p.seat, p.shard))
        assert max(covered.values(), default=0) <= 2
        taken[r.source] += r.taken
    quotas = highest_quotients(target, block)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1.5 * block
        assert set(seats[s]) == set(range(quotas[s]))
        # Each seat is worth a block, but for the source's short one.
        assert sum(v != block for v in seats[s].values()) <= 2
        assert [k for _, k in sorted(shards[s])] == sorted(k for _, k in shards[s]) and len(shards[s]) == len(seats[s])
    everything = sum(target.values())
    for s in sizes:
        for seat, shard in shards[s]:
            assert shard == pytest.approx(everything * (2 * seat + 1) / (2 * shard_blocks * target[s]), abs=1)


def test_query_equals_its_twin(spark):
    assert compare(queries.op11_mixing, queries.ORACLE["op11_mixing"], spark, connect(SF), SF) == ""


@pytest.mark.parametrize(("seed", "block", "shard_blocks"), [(1, 32, 1 << 15), (2, 7, 10), (3, 1, 100)])
def test_odd_rows(spark, seed, block, shard_blocks):
    rows = noisy(150, seed)
    check(rows, mixing.mix(table(spark, rows), block=block, shard_blocks=shard_blocks).collect(), block, shard_blocks)


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = noisy(80, 4)
    runs = [sorted(map(str, mixing.mix(table(spark, r, p)).drop("source").collect())) for r, p in ((rows, 1), (rows[::-1], 5))]
    assert runs[0] == runs[1]


def test_many_copies_fall_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows = [(1, "a", "one two three")] * 20 + [(2, "b", "x " * 500)]
    check(rows, mixing.mix(table(spark, rows)).collect())


def test_empty_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    none = mixing.mix(table(spark, [(1, "a", None), (2, None, " ")])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixed_texts_are_the_pieces(spark):
    rows = noisy(60, 5)
    docs = table(spark, rows)
    pieces = mixing.mix(docs, block=16)
    texts = mixing.mixed_texts(docs, block=16).collect()
    assert Counter((r.source, r.seat, r.doc_id, r.start, len(r.text.split(" "))) for r in texts) == Counter(
        (r.source, p.seat, r.doc_id, p.start, p.length) for r in pieces.collect() for p in r.pieces
    )
    held = defaultdict(set)
    for d, s, t in rows:
        held[d, s].add(" ".join(words(t)))
    assert all(any(r.text in t for t in held[r.doc_id, r.source]) for r in texts)


def test_permutation_hits_every_block_once(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 9, 100, 1001):
        seats = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5).cast("bigint")).alias("s"))
        assert sorted(r.s for r in seats.collect()) == list(range(n))
    big, b = 3_999_999_999_989, 3_123_456_789_012
    got = spark.range(1).select(mixing._permuted(F.lit(b), F.lit(big), F.lit(17).cast("bigint"))).first()[0]
    assert got == (mixing.PRIME * b + 17) % big
