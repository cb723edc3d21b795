import itertools
import math

import numpy as np
import pytest
from brute import lowered, remainder, unigram_scores
from conftest import EDGE_ROWS, frame, prose

from scorelens.llm import hmm


def small_model(seed=0, states=3, symbols=5):
    rng = np.random.default_rng(seed)
    normal = lambda a: a / a.sum(axis=-1, keepdims=True)
    return hmm.Model(normal(rng.random(states)), normal(rng.random((states, states))), normal(rng.random((states, symbols))))


def paths(model, line):
    """Every state path with its joint probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(line)):
        p = model.start[path[0]] * model.emit[path[0], line[0]]
        for a, b, symbol in zip(path, path[1:], line[1:]):
            p *= model.move[a, b] * model.emit[b, symbol]
        yield path, p


def test_forward_is_the_sum_over_all_paths():
    model = small_model()
    lines = [np.array(x, "<u2") for x in ([0], [1, 2, 3], [4, 4, 0, 1, 2], [2, 1], [3, 0, 0, 4, 1, 1])]
    expected = [math.log10(sum(p for _, p in paths(model, x))) for x in lines]
    assert np.allclose(hmm.log10_likelihoods(model, lines), expected)


def test_expected_counts_are_sums_over_all_paths():
    model = small_model(1)
    lines = [[3, 0, 0, 4, 1], [1, 2, 3], [2, 2], [4]]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for line in lines:
        whole = sum(p for _, p in paths(model, line))
        for path, p in paths(model, line):
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                move[a, b] += p / whole
            for a, symbol in zip(path, line):
                emit[a, symbol] += p / whole
    padded = np.array([x + [0] * (5 - len(x)) for x in lines], "uint16")
    found = hmm.forward_backward(model, padded, np.array([len(x) for x in lines]))
    assert all(np.allclose(a, b) for a, b in zip(found, (start, move, emit)))


@pytest.mark.parametrize("local", [hmm.LOCAL_WORDS, 40])
def test_base_scores(spark, local, monkeypatch):
    monkeypatch.setattr(hmm, "OWN_SYMBOLS", 20)
    monkeypatch.setattr(hmm, "LOCAL_WORDS", local)
    monkeypatch.setattr(hmm.lexicon, "__defaults__", (20, local))
    rows = EDGE_ROWS + [(100 + i, prose(80, i % 5) + " " + prose(10, i)) for i in range(60)]
    got = hmm.text_scores(frame(spark, rows), rounds=2).collect()
    key = lambda r: (repr(r[0]), r[2], r[5])
    pairs = list(zip(sorted(map(tuple, got), key=key), sorted(unigram_scores(rows), key=key)))
    assert len(got) == len(rows)
    for ours, plain in pairs:
        assert ours[:5] == plain[:5] and math.isclose(ours[5], plain[5], rel_tol=1e-9)
        assert ours[6] < 0


def test_shares_of_a_class_sum_to_one(spark):
    """Symbols of a state, and within a class its words and one place for the unseen, are distributions."""
    rows = frame(spark, [(i, prose(60, i)) for i in range(30)])
    counts = hmm.word_counts(rows)
    lex = hmm.lexicon(counts, own=30, local=60)
    inside = np.zeros(hmm.CLASSES)
    for r in counts.collect():
        if bytes(r.word) not in lex.symbols:
            inside[r["class"]] += (r.c + 1) / (lex.class_uses[r["class"]] + lex.class_words[r["class"]] + 1)
    unseen = 1 / (lex.class_uses + lex.class_words + 1)
    assert np.allclose(inside + unseen, 1)


def test_no_training_rows(spark, empty):
    assert hmm.text_scores(empty).count() == 0
    out = next(i for i in range(1000) if remainder(i, 7) == 2)
    row = hmm.text_scores(frame(spark, [(out, "two words")]), rounds=1).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_training_helps_held_out_texts(spark):
    """Two kinds of text: the states tell them apart, so the model beats single words."""
    first, second = sorted(set(lowered(prose(300, "a"))))[:60], sorted(set(lowered(prose(300, "b"))))[60:120]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(first if i % 2 else second, 80))) for i in range(300)]
    got = hmm.text_scores(frame(spark, rows), states=4, rounds=8).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
