import random

from brute import edit_distance_inside
from conftest import EDGE_ROWS, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelens.llm import decontaminate as d

ITEMS = [(i, prose(20 + i, f"item{i}")) for i in range(6)] + [(90, "tiny one"), (91, ""), (92, None), (93, prose(20, "item0"))]


def edited(text, count, seed):
    rng = random.Random(seed)
    chars = list(text)
    for _ in range(count):
        at = rng.randrange(5, len(chars) - 5)
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "z"
        elif kind == 1:
            chars.insert(at, "z")
        else:
            del chars[at]
    return "".join(chars)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")


def brute(rows, items):
    """Every pair within the budget, by comparing the whole item with every place of the whole text."""
    found = {}
    for doc_id, text in rows:
        line = d.normalised((text or "").encode())
        for item_id, item in items:
            item = d.normalised((item or "").encode())
            if not item:
                continue
            if len(item) < d.Q:
                if b" " + item + b" " in b" " + line + b" ":
                    found[doc_id, item_id] = 0
                continue
            errors = edit_distance_inside(item, line)
            if errors <= d.budget(len(item)):
                found[doc_id, item_id] = errors
    return found


def test_edited_items(spark):
    rows = []
    for i, text in ITEMS[:6]:
        for n in (0, 2, 5, 9, 14, 40):
            rows.append((10 * i + n, prose(9, f"l{i}") + " " + edited(text, n, f"{i}/{n}") + " " + prose(9, f"r{i}")))
    rows += [(900, "a TINY, one b"), (901, "a tinyone b"), (902, ITEMS[2][1].upper().replace(" ", "!! ")), (903, ITEMS[1][1])]
    got = d.contaminated(frame(spark, rows), benchmark(spark, ITEMS)).collect()
    expected = brute(rows, ITEMS)
    assert {(r.doc_id, r.item_id): r.edits for r in got} == expected and len(got) == len(expected)
    assert {e for e in expected.values()} >= {0, 2, 5}
    for r in got:
        line = d.normalised(dict(rows)[r.doc_id].encode()).decode()
        item = d.normalised(dict(ITEMS)[r.item_id].encode())
        assert edit_distance_inside(item, line[r.start : r.end].encode()) == r.edits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_alignment_is_the_edit_distance(seed):
    rng = random.Random(seed)
    item = "".join(rng.choices("ab c", k=rng.randint(10, 40)))
    region = "".join(rng.choices("ab", k=3)) + edited(item + "xxxxxxxxxx", rng.randint(0, 4), seed)
    item, region = item.encode(), region.encode()
    width = len(region)
    best = edit_distance_inside(item, region)
    found = d.aligned(item, region, len(item), width)
    assert found[0] == best
    assert edit_distance_inside(item, region[found[1] : found[2]]) == best


def test_edges(spark, edge, empty):
    items = [*ITEMS, (7, "alone with no id"), (8, "naive")]
    got = {(r.doc_id, r.item_id) for r in d.contaminated(edge, benchmark(spark, items)).collect()}
    assert got == {(None, 7)}
    assert d.contaminated(empty, benchmark(spark, ITEMS)).count() == 0
    assert d.contaminated(edge, benchmark(spark, [])).count() == 0
    kept = d.keep_clean(edge, benchmark(spark, items))
    assert kept.schema == edge.schema and kept.count() == len(EDGE_ROWS) - 1
    assert d.keep_clean(empty, benchmark(spark, ITEMS)).count() == 0
    assert d.keep_clean(edge, benchmark(spark, [])).count() == len(EDGE_ROWS)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [(i, prose(5, i) + " " + t) for i, t in ITEMS[:6]]
    whole = sorted(map(tuple, d.contaminated(frame(spark, rows), benchmark(spark, ITEMS)).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, d.contaminated(frame(spark, rows), benchmark(spark, ITEMS)).collect())) == whole


def test_items_that_lack_bytes_at_the_beginning_of_a_text(spark):
    rows = []
    for i, text in ITEMS[:6]:
        middle = len(text) // 2
        cut = [text[1:], text[3:], text[:20] + text[21:], text[:middle] + text[middle + 1 :], text[2:middle] + text[middle + 2 :]]
        cut += [text[:-2], text[text.index(" ") + 1 :], text[:4] + text[9:], "z" + text[2:]]
        for n, part in enumerate(cut):
            rows += [(100 * i + 3 * n, part), (100 * i + 3 * n + 1, part + " " + prose(9, f"r{i}")), (100 * i + 3 * n + 2, prose(9, f"l{i}") + " " + part)]
    got = d.contaminated(frame(spark, rows), benchmark(spark, ITEMS)).collect()
    expected = brute(rows, ITEMS)
    assert {(r.doc_id, r.item_id): r.edits for r in got} == expected and len(got) == len(expected) > 100
    for r in got:
        line = d.normalised(dict(rows)[r.doc_id].encode()).decode()
        item = d.normalised(dict(ITEMS)[r.item_id].encode())
        assert edit_distance_inside(item, line[r.start : r.end].encode()) == r.edits
    kept = {r.doc_id for r in d.keep_clean(frame(spark, rows), benchmark(spark, ITEMS)).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in expected}
