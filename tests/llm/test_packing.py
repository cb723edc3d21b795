import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import EDGE_ROWS, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorelens.llm.packing import WordIds, pack, pack_digests, pack_lengths, place

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_word():
    return WordIds(PATH)


@settings(max_examples=1500, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_by_word_are_ids_of_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    tokenizer, by_word = TOKENIZERS
    ids = np.frombuffer(next(iter(by_word([text.encode()]))), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


TOKENIZERS = Tokenizer.from_file(PATH), WordIds(PATH)


@pytest.mark.parametrize(
    "text", ["\x1f{ a\x7f. \x01", "it's don't 'll x's,y", "a b　c \x1c d", "é É. ,é", "İstanbul <|startoftext|> <|ENDOFTEXT|>x", "¡hola!… ...a,b.c ½ ²", "ﬁ ǅ ß ΑΣ Σ."]
)
def test_odd_texts(text, whole, by_word):
    assert np.frombuffer(next(iter(by_word([text.encode()]))), "<u4").tolist() == whole(text)


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_edges(edge, whole):
    rows = pack(edge, capacity=64).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start].append(bytes(r.ids))
    expected = defaultdict(list)
    for doc_id, text in EDGE_ROWS:
        ids = np.array([*whole(text), 0], "<u4")
        for k in range(0, len(ids), 64):
            expected[doc_id, k // 64, k].append(ids[k : k + 64].tobytes())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert all(r.length * 4 == len(r.ids) for r in rows)
    check_places(rows, 64)
    digests = pack_digests(edge, capacity=64).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in digests) == sorted(
        (str(r.doc_id), r.piece, zlib.crc32(bytes(r.ids))) for r in rows
    )


def test_empty(empty):
    assert pack(empty).count() == 0


@given(st.lists(st.integers(1, 64), max_size=200))
def test_any_lengths_fit(lengths):
    number, offset = pack_lengths(lengths, 64)
    fill = defaultdict(int)
    for n, o, size in zip(number.tolist(), offset.tolist(), lengths):
        assert o == fill[n]
        fill[n] += size
    assert all(f <= 64 for f in fill.values())


def test_each_place_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 20, 200).tolist()
    number, offset = pack_lengths(lengths, 20)
    free = {}
    for n, o, size in zip(number.tolist(), offset.tolist(), lengths):
        options = {None: 20, **{k: f for k, f in free.items() if size <= f < 20}}

        def squares(choice):
            after = dict(free)
            after[choice if choice is not None else "new"] = options[choice] - size
            gaps = [g for g in after.values() if g]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        taken = n if n in free else None
        assert squares(taken) == min(squares(c) for c in options)
        free[n] = 20 - o - size


def test_few_sequences():
    rng = np.random.default_rng(5)
    lengths = sorted(rng.integers(1, 2048, 5000).tolist(), reverse=True)
    assert pack_lengths(lengths, 2048)[0].max() + 1 <= 1.06 * sum(lengths) / 2048


def test_long_prose(whole, by_word):
    text = prose(3000, "tokens").replace("the", "The,").replace("ou", "oü")
    assert np.frombuffer(next(iter(by_word([text.encode()]))), "<u4").tolist() == whole(text)


def test_equal_rows_are_dealt_to_all_groups(spark):
    pieces = spark.range(4000).selectExpr(
        "cast(null as bigint) doc_id", "0 piece", "0L start", "7L length", "id piece_no", "'x' offset", "1 pack_group", "2 sequence_id"
    )
    rows = place(pieces, 64, 100).collect()
    sizes = np.bincount([r.sequence_id >> 32 for r in rows])
    assert len(rows) == 4000 and len(sizes) == 40 and sizes.max() < 200
    check_places(rows, 64)


def test_many_empty_documents(spark):
    rows = pack_digests(frame(spark, [(None, None)] * 300), capacity=64).collect()
    assert check_places(rows, 64) == 5 and set(rows[0].asDict()) == {
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
