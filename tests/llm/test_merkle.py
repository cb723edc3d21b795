import random
from hashlib import md5

import pytest
from brute import sha
from conftest import EDGE_ROWS, frame, prose
from pyspark.sql import functions as F

from scorelens.llm import merkle


def order(rows):
    """Each different (id, text) with the text that follows; ties under one id by the operator's hash."""
    return sorted({(-(1 << 63) if d is None else d, t or "") for d, t in rows})


def test_edges(spark, edge):
    got = merkle.edited_neighbours(edge).collect()
    hashes = dict(spark.createDataFrame([(t,) for _, t in order(EDGE_ROWS)], "t string").select("t", F.xxhash64("t")).collect())
    places = sorted(order(EDGE_ROWS), key=lambda p: (p[0], hashes[p[1]]))
    after = {p: places[(i + 1) % len(places)][1] for i, p in enumerate(places)}
    expected = []
    for d, t in EDGE_ROWS:
        t = t or ""
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + after[-(1 << 63) if d is None else d, t][:quarter]
        expected.append((d, len(t), sha(edited), edited == t))
    rows = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint == r.edited_fingerprint) for r in got), key=repr)
    assert rows == sorted(expected, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_equal_and_different_texts(spark):
    text = "\n".join(prose(20, i) + "." for i in range(30))
    lines = text.split("\n")
    texts = [text, text, text + " ", "\n".join(lines[:10] + [prose(20, "new")] + lines[10:]), prose(500, "other"), "", " ", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", merkle.fingerprint(F.col("t")).alias("f"))
    prints = {r.i: r.f for r in rows.collect()}
    assert prints[0] == prints[1] and len(set(prints.values())) == len(texts) - 1
    pairs = spark.createDataFrame([(prints[0], prints[i]) for i in range(len(texts))], "a string, b string")
    near = [r[0] for r in pairs.select(merkle.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == near[1] == 1.0 and 0.9 < near[2] <= 1 and near[3] > 0.9 and near[4] < 0.1
    changed = pairs.limit(4).select(merkle.changed_paragraphs(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in changed] == [[], [], [29], [10]]


def test_one_document_and_none(spark, empty):
    row = merkle.edited_neighbours(frame(spark, [(1, "abcdefgh")])).first()
    assert row.edited_sha256 == sha("abcdefab") and row.near_next == 1.0
    assert merkle.edited_neighbours(empty).count() == 0


def test_repeated_phrases_count_by_place(spark):
    row = merkle.edited_neighbours(frame(spark, [(1, "same word " * 400), (2, prose(900, "n"))])).where("doc_id = 1").first()
    assert 0.7 < row.near_edited < 0.8 and row.near_next < 0.1


@pytest.mark.parametrize("size", [200, 256, 257, 300, 4000])
@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x5E00))), "abcdefgh\t", "ab cd. e"])
def test_three_quarters_stay_at_any_length_and_whatever_the_blanks(spark, size, alphabet):
    rng = random.Random(size)
    text = lambda: "".join(rng.choices(alphabet, k=size))
    row = merkle.edited_neighbours(frame(spark, [(1, text()), (2, text())])).where("doc_id = 1").first()
    assert abs(row.near_edited - 0.75) < 0.1 and row.near_next < 0.2


def tree(text):
    """Paragraphs as lists of leaf hashes, cut by hand."""
    out = []
    for line in text.split("\n"):
        leaves, at = [], 0
        while at < len(line) or not leaves:
            ends = [i for i in range(at + 9, min(at + 16, len(line))) if line[i] in " ,.;:!?"]
            end = ends[0] + 1 if ends else min(at + 16, len(line))
            leaves.append(md5(line[at:end].encode()).hexdigest())
            at = end
        out.append(leaves)
    return out


def ends(x, y):
    shorter = min(len(x), len(y))
    head = next((i for i in range(shorter) if x[i] != y[i]), shorter)
    tail = next((i for i in range(shorter) if x[-1 - i] != y[-1 - i]), shorter)
    return head, min(tail, shorter - head)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([tuple(p) for p in tree(t)] for t in (a, b))
    weight = lambda paragraphs: sum(map(len, paragraphs))
    most = max(weight(x), weight(y))
    eights = lambda p: [tuple(p[i : i + 8]) for i in range(0, len(p), 8)]
    skipped = 8 * ends(eights(x), eights(y))[0]
    equal, x, y = weight(x[:skipped]), x[skipped:], y[skipped:]
    head, tail = ends(x, y)
    equal += weight(x[:head]) + weight(x[len(x) - tail :])
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    once = lambda p, q, both: [e for e in dict.fromkeys(p) if (e in q) == both]
    equal += weight(once(x, y, True))
    p, q = sum(once(x, y, False), ()), sum(once(y, x, False), ())
    return (equal + max(sum(ends(p, q)), len(set(p) & set(q)))) / most


def test_likeness_is_that_of_a_plain_tree(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(60):
        lines = [rng.choice([prose(rng.randint(0, 25), rng.random()), "", "again and again"]) for _ in range(rng.randint(1, 40))]
        other = list(lines)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(other)) if other else 0
            change = rng.randrange(4)
            if change == 0:
                other.insert(at, prose(9, rng.random()))
            elif change == 1 and other:
                del other[at]
            elif change == 2 and other:
                other.append(other.pop(at))
            elif other:
                words = other[at].split(" ")
                words.insert(rng.randint(0, len(words)), "new")
                other[at] = " ".join(words)
        pairs.append(("\n".join(lines), "\n".join(other)))
    pairs += [("", "\n"), ("\n\n", "\n"), ("a", ""), ("\r", "\r\n"), ("𝒳" * 40, "𝒳" * 41)]
    frame_of = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    prints = frame_of.select("i", *(merkle.fingerprint(F.col(c)).alias(c) for c in "ab"))
    got = {r.i: (r.to, r.back) for r in prints.select(
        "i", merkle.likeness(F.col("a"), F.col("b")).alias("to"), merkle.likeness(F.col("b"), F.col("a")).alias("back")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx((plain_likeness(a, b), plain_likeness(b, a))), (a, b)
