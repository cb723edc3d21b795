import re

import pytest
from conftest import EDGE_ROWS, frame, prose

from scorelens.llm import licenses


def shingles(text):
    words = [w for w in re.split(licenses.SEPARATORS, (text or "").lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(rows, templates=licenses.TEMPLATES, least=licenses.LEAST):
    """Best share of a template's shingles in any stretch of its length and some slack, per id and license."""
    best = {}
    for doc_id, text in rows:
        own = shingles(text)
        for name, template in templates:
            wanted = set(shingles(template))
            if not wanted & set(own):
                continue
            n = len(shingles(template)) + 2 * licenses.SLACK
            share = max(len(wanted & set(own[i : i + n])) for i in range(max(1, len(own) - n + 1))) / len(wanted)
            if share >= least:
                best[doc_id, name] = max(best.get((doc_id, name), 0), share)
    return best


def found(docs, **kw):
    return {(r.doc_id, r.license): r.containment for r in licenses.scan(docs, **kw).collect()}


def test_whole_and_damaged_notices(spark):
    rows = [(i, prose(30, i) + " " + t + " " + prose(20, -i)) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + i, t.upper().replace(" ", "\n## ")) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    long = licenses.TEMPLATES[5][1].split()
    rows += [(200 + k, prose(9, k) + " " + " ".join(long[:k] + ["changed"] + long[k + 1 :])) for k in range(0, len(long), 3)]
    rows += [(300 + k, " ".join(long[:k])) for k in range(20, len(long))]
    rows += [(400, "the MIT License"), (401, " ".join([licenses.TEMPLATES[0][1]] * 50)), (402, "under the MIT")]
    got, expected = found(frame(spark, rows)), brute(rows)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert {c for c in got.values()} - {1.0}


def test_position_and_places(spark):
    notice = licenses.TEMPLATES[0][1]
    row = licenses.scan(frame(spark, [(1, prose(12, 1) + " " + notice + " " + prose(40, 2) + " " + notice)])).first()
    assert (row.position, row.places) == (12, 2)


def word_count(text):
    return len([w for w in re.split(licenses.SEPARATORS, text.lower()) if w])


def test_places_of_whole_and_edited_notices(spark):
    """Each notice once after k other words, with a word put in or left out, and several times in a row or apart."""
    rows, expected = [], {}

    def case(text, name, position, places):
        doc = len(rows)
        rows.append((doc, text))
        expected[doc, name] = (position, places)

    for i, (name, t) in enumerate(licenses.TEMPLATES):
        case(prose(3 + i, i) + " " + t + " " + prose(30, -i), name, 3 + i, 1)
        case(" ".join([t] * 4), name, 0, 4)
        case(prose(2, i) + " " + t + " " + prose(25, 50 + i) + " " + t, name, 2, 2)
        w = t.split()
        if word_count(t) >= 30:
            for k in (8, len(w) // 2, len(w) - 6):
                case(prose(3, k) + " " + " ".join(w[:k] + ["inserted"] + w[k:]), name, 3, 1)
                case(prose(3, k) + " " + " ".join(w[:k] + w[k + 1 :]), name, 3, 1)
    got = {(r.doc_id, r.license): (r.position, r.places) for r in licenses.scan(frame(spark, rows)).collect()}
    assert {k: got.get(k) for k in expected} == expected


def test_edges(edge, empty, spark):
    assert found(edge) == brute(EDGE_ROWS) == {}
    assert licenses.scan(empty).count() == 0
    assert found(frame(spark, [(None, licenses.TEMPLATES[0][1]), (None, "x")])) == {(None, "MIT"): 1.0}


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    monkeypatch.setattr(licenses, "BLOCK", 120)
    assert found(frame(spark, rows)) == brute(rows)


def test_short_template_is_refused(empty):
    with pytest.raises(ValueError):
        licenses.scan(empty, (("x", "three words only"),))
