"""Collocations against counting in plain Python; automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

from scorelens.llm import collocations, queries, transducers

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(rows, least, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            for size in range(1, 5):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        covered = set()
        for y, b in candidates.items():
            covered |= {
                y[i : i + size]
                for size in range(2, len(y))
                for i in range(len(y) - size + 1)
                if 100 * b >= 80 * candidates[y[i : i + size]]
            }
        found = []
        for w, a in candidates.items():
            if w not in covered:
                cuts = [(2_000_000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows, parts=4):
    """With further columns under names that the operator uses itself."""
    schema = "lang string, text string, part int, blob string, phrase string, f double, word int, shard int"
    return spark.createDataFrame([(*r, 1, "b", "p", 2.0, 3, 4) for r in rows], schema).repartition(parts)


def noisy(count, seed):
    rng = random.Random(seed)
    words = ["The", "of", "a", "bé", "c\x00d", "the", "Straße", "x" * 300, "İ"]
    seps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";:", "\r", "\x1c"]

    def text():
        return "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))

    return [(rng.choice(["en", "en", "de", None, ""]), rng.choice([None, "", " .,", text(), text(), text()])) for _ in range(count)]


def result(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_its_twin(spark):
    assert compare(queries.op12_collocations, queries.ORACLE["op12_collocations"], spark, connect(SF), SF) == ""


@pytest.mark.parametrize(("least", "fan", "shard_bytes"), [(30, 64, 1 << 24), (5, 2, 300), (2, 3, 2000), (1, 2, 1500)])
def test_odd_rows(spark, least, fan, shard_bytes):
    rows = noisy(150, least) + [("en", "again and again, again and again and again")] * 40
    found = collocations.collocations(table(spark, rows), least=least, fan=fan, shard_bytes=shard_bytes)
    assert result(found) == plain(rows, least)


def test_few_ranks(spark):
    rows = noisy(120, "ranks")
    assert result(collocations.collocations(table(spark, rows), least=3, top=4)) == plain(rows, 3, 4)


def test_many_prefix_ranges_and_full_filters(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS_PER_RANGE", 50)
    monkeypatch.setattr(collocations, "GRAMS_PER_RANGE", 40)
    rows = noisy(150, "ranges")
    assert result(collocations.collocations(table(spark, rows), least=4)) == plain(rows, 4)
    monkeypatch.setattr(collocations, "passes", lambda bits, hashes: np.ones(len(hashes), bool))
    assert result(collocations.collocations(table(spark, rows), least=4)) == plain(rows, 4)


def test_nothing_to_find(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("en", ""), ("en", "one"), ("de", ". , \n")])).count() == 0


def test_very_long_text(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choices(["alpha", "beta", "gamma.", "delta"], k=60_000))), ("en", "alpha beta"), ("de", "alpha beta")]
    assert result(collocations.collocations(table(spark, rows))) == plain(rows, 30)


SEQUENCES = st.dictionaries(
    st.lists(st.sampled_from([b"a", b"b", b"ab", b"\xc3\xa9"]), min_size=1, max_size=4).map(tuple), st.integers(1, 3), max_size=30
)


@settings(max_examples=60, deadline=None)
@given(SEQUENCES, SEQUENCES)
def test_automata_count_like_dictionaries(one, other):
    a, b = (transducers.build(sorted(d.items())) for d in (one, other))
    assert dict(a.sequences()) == one
    both = transducers.Transducer.loads(transducers.union([a, transducers.Transducer.loads(b.dumps())]).dumps())
    total = Counter(one) + Counter(other)
    assert list(both.sequences()) == sorted(total.items())
    for w in total:
        for k in range(1, len(w) + 1):
            assert both.weight(w[:k]) == sum(c for v, c in total.items() if v[:k] == w[:k])
    begin = Counter()
    for w, c in total.items():
        for k in range(1, len(w) + 1):
            begin[w[:k]] += c
    assert dict(both.prefixes(3)) == {w: c for w, c in begin.items() if c >= 3}


def test_equal_ends_share_states():
    built = transducers.build(sorted(((w, e), 1) for w in (b"a", b"b", b"c") for e in (b"x", b"y")))
    assert len(built.ends) == 3
