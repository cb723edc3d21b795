"""Best-fit packing by sums of squares: token sequences of one length from whole documents.

Documents become token ids, each with an end id; only documents longer than a
sequence are cut. Pieces are dealt by hash into groups of a bounded size and
each group is packed on its own: a piece goes where the sum of the squared
numbers of open sequences per free space becomes smallest, ties to the tightest
place. Pieces go in by falling length. A group leaves a few open sequences, so
the loss against one global packing shrinks with the group size.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.texts import once_per_process, only, slices
from scorelens.session import settle

CAPACITY = 2048
GROUP = 20_000
END_ID = 0
KEPT_WORDS = 500_000
WORDS_PER_CALL = 1000
# ASCII punctuation; after an ASCII letter or digit and before a blank it is a token run of its own.
PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
ALPHANUMERIC = b"0123456789abcdefghijklmnopqrstuvwxyz"
OWN = ("pack_group", "sequence_id", "offset")
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


class WordIds:
    """Token ids of lower-cased words as little-endian 32-bit numbers, for vocabularies that work word by word.

    No token of such a vocabulary reaches over a blank, so a text's ids are its
    words' ids in a row; equal words are encoded once. Texts that may hold one
    of the special marks go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.marks = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {b"": b""}

    def _whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, found: set[bytes]) -> None:
        from unicodedata import is_normalized

        parts = {}
        for word in found:
            core = word.rstrip(PUNCTUATION)
            cut = len(core) if core[-1:] in ALPHANUMERIC and core else len(word)
            parts[word] = word[:cut], word[cut:]
        letters, other = [], []
        for part in {p for pair in parts.values() for p in pair}.difference(self.known):
            text = part.decode()
            plain = text.isalpha() and (text.isascii() or text == text.lower() and is_normalized("NFC", text))
            (letters if plain else other).append(part)
        for i in range(0, len(letters), WORDS_PER_CALL):
            some = letters[i : i + WORDS_PER_CALL]
            line = b" ".join(some).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                flat, at = ids.tobytes(), 0
                for part, end in zip(some, ends.tolist()):
                    self.known[part] = flat[4 * at : 4 * end]
                    at = end
            else:
                other += some
        for part in other:
            self.known[part] = self._whole(part)
        for word, (core, tail) in parts.items():
            self.known[word] = self.known[core] + self.known[tail]

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known = {b"": b""}
        lowered = [(t or b"").lower() for t in texts]
        marked = [any(m in t for m in self.marks) for t in lowered]
        lists = [[] if m else t.split() for t, m in zip(lowered, marked)]
        found = set().union(*lists).difference(self.known)
        if found:
            self._learn(found)
        look = self.known.__getitem__
        for text, mark, listed in zip(texts, marked, lists):
            yield self._whole(text) if mark else b"".join(map(look, listed))


def _tokenizer_path(tokenizer: str) -> str:
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def tokenize(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of every document.

    A null or empty text is the end id alone. Null and repeated doc_ids are
    kept, row by row. `tokenizer` is a path or the name of a public vocabulary
    that works word by word.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _tokenizer_path(tokenizer)
        encode = once_per_process(("word ids", path), lambda: WordIds(path))
        width, end = 4 * capacity, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in slices(batch):
                rows = []
                for doc_id, ids in zip(doc_ids[first:], encode(texts)):
                    ids += end
                    rows += [
                        (doc_id, k, at // 4, (min(at + width, len(ids)) - at) // 4, ids[at : at + width])
                        for k, at in enumerate(range(0, len(ids), width))
                    ]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(cut, PIECES)


def pack_lengths(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the given order."""
    number, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    count = np.zeros(capacity + 1, "int64")  # open sequences by free space
    places: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i, size in enumerate(lengths):
        # What the sum of squares gains when a sequence with free space `size`, `size` + 1, ... takes the piece.
        gain = 2 * (count[: capacity - size] - count[size:capacity] + 1)
        if len(gain):
            gain[0] = 1 - 2 * count[size]
            gain[count[size:capacity] == 0] = np.iinfo("int64").max
        best = int(gain.argmin()) if len(gain) else 0
        fresh = 0 if size == capacity else 2 * count[capacity - size] + 1
        if len(gain) and gain[best] <= fresh:
            free = size + best
            place = places[free].pop()
            count[free] -= 1
        else:
            free, place, opened = capacity, opened, opened + 1
        number[i], offset[i] = place, capacity - free
        if free > size:
            places[free - size].append(place)
            count[free - size] += 1
    return number, offset


def place(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset; other columns are carried along.

    `pieces` has doc_id, piece, length (1 to `capacity`) and piece_no, a number
    of the row, and is read twice, so it must be a written table. Groups come
    from a hash of that number, so rows equal in all else are dealt as well.
    Columns named pack_group, sequence_id or offset are replaced; no rows give
    none.
    """
    pieces = pieces.drop(*OWN)
    groups = max(1, -(-pieces.count() // group))
    carried = pieces.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        number, offset = pack_lengths(rows["length"].tolist(), capacity)
        return rows.drop(columns="pack_group").assign(sequence_id=key[0] * (1 << 32) + number, offset=offset)

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("piece_no"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack, f"{schema}, sequence_id bigint, offset bigint")


def _numbered(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("piece_no", F.monotonically_increasing_id())


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their ids, sequence_id and offset.

    Only lengths are packed; the ids meet their places in a join on a number
    that is written with the piece.
    """
    pieces = settle(_numbered(tokenize(docs, tokenizer, capacity)), "pieces")
    placed = settle(place(pieces.drop("ids"), capacity), "places").select("piece_no", "sequence_id", "offset")
    return pieces.join(placed, "piece_no").drop("piece_no")


def pack_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """As pack(), with a CRC-32 in place of the ids, which then stay where they were made."""
    pieces = tokenize(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(settle(_numbered(pieces), "piece-digests"), capacity).drop("piece_no")
