import random

import pytest
from brute import fingerprint, groups
from conftest import EDGE_ROWS, frame, prose

from scorelens.llm import components as steps
from scorelens.llm.components import components
from scorelens.llm.simhash import fingerprint_links, keep_one, near_duplicates

FULL = (1 << 64) - 1


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = groups(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        least.setdefault(r, []).append(d)
    names = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, p, names[r]) for (d, _), p, r in zip(rows, prints, roots)), key=repr)


def test_edges(edge):
    got = sorted(((r.doc_id, r.fp & FULL, r.component_id) for r in near_duplicates(edge).collect()), key=repr)
    assert got == expected(EDGE_ROWS)


def test_empty(empty):
    assert near_duplicates(empty).count() == 0
    assert keep_one(empty).count() == 0 and keep_one(empty).columns == empty.columns


def test_near_copies(spark):
    base = prose(400, "base").split()
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(40)] + [(99, prose(400, "other"))]
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fp & FULL, r.component_id) for r in got), key=repr) == expected(rows)


@pytest.mark.parametrize("file", [2, 64])
def test_links_of_a_crowded_file(spark, file):
    """Fingerprints around a few centres: pairing and one-bit neighbours give the same components."""
    rng = random.Random(file)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            near = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                near ^= 1 << b
            prints.add(near)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), file)
    found = {r.node & FULL: r.root for r in components(links).collect()}
    roots = groups(prints)
    ours = [found.get(p, p - (1 << 64) if p >> 63 else p) for p in prints]
    assert len(set(roots)) == len(set(ours)) == len(set(zip(roots, ours)))


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 1000: 1000, 1001: 1000}


def test_components_around_hubs(spark, monkeypatch):
    """Stars with many leaves, joined by one of them: hubs go by broadcast, the rest by shuffle."""
    monkeypatch.setattr(steps, "FEW", 10)
    monkeypatch.setattr(steps, "MOST_HUBS", 1 << 4)
    rng = random.Random(2)
    edges = [(h, rng.randrange(1000 * h, 1000 * h + 300)) for h in (7, 8, 9) for _ in range(400)]
    edges += [(7, 8500), (8, 8500), (30, 31), (31, 32)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e}
    assert got == {n: 30 if n in (30, 31, 32) else 9 if n == 9 or n >= 9000 else 7 for n in nodes}


def test_one_of_each_group_stays(edge):
    kept = keep_one(edge)
    assert kept.schema == edge.schema
    groups_of = {}
    for d, _, c in expected(EDGE_ROWS):
        groups_of.setdefault(c, set()).add(d)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted((c for c in groups_of), key=repr)
