from brute import sha, substrings
from conftest import EDGE_ROWS, frame, prose

from scorelens.llm.substrings import COVER, PERIOD, remove_repeated


def got(rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in rows), key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_edges(edge):
    assert got(remove_repeated(edge).collect()) == sorted(substrings(EDGE_ROWS), key=repr)


def test_every_offset(spark):
    """A passage of exactly a window, one less and one more, at all offsets against each other."""
    exact, less, more = prose(35, "e"), prose(34, "l"), prose(36, "m")
    rows = [(i, prose(i, f"a{i}") + " " + text) for i, text in enumerate([exact, less, more] * 14)]
    rows += [(1000 + i, text + " " + prose(3 * i, f"b{i}")) for i, text in enumerate([exact, less, more])]
    assert got(remove_repeated(frame(spark, rows)).collect()) == sorted(substrings(rows), key=repr)


def test_repeats_inside_one_document(spark):
    rows = [(1, prose(40, "p") + " " + prose(5, "q") + " " + prose(40, "p")), (2, "a " * 36), (3, "b " * 35)]
    assert got(remove_repeated(frame(spark, rows)).collect()) == sorted(substrings(rows), key=repr)


def test_empty(empty):
    assert remove_repeated(empty).count() == 0
