"""Substring deduplication: difference-cover anchors, then exact windows.

A window is WINDOW consecutive words. Words number 0, 1, ... in a document; a
position is an anchor if it lies in COVER modulo PERIOD. Any two positions have
a shift below PERIOD that takes both to anchors, so two equal windows share an
equal run of WINDOW - PERIOD + 1 words that starts at an anchor of both. Only
runs at anchors are hashed and matched; where one repeats, the match is
extended to the windows around it, and windows are compared by 128-bit hashes.

A batch of rows sends each hash once, with the number of places it was seen
at, so a passage that is everywhere makes one entry per batch, and no group is
ever larger than the number of batches. Entries travel as arrays, one row per
batch and bucket of hashes. Equal texts are counted first: all their windows
repeat, so one of them stands for the others when windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.texts import only, slices
from scorelens.session import settle

WINDOW = 35
# A difference cover, every difference modulo 21 occurs among these five.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
KEPT_WORDS = 300_000
GROUP_PLACES = 1 << 19
BUCKET_BYTES = 16 << 20


class WordHashes(dict):
    """64-bit hashes of words, kept while a task runs."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), "uint64", len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of `length` word hashes from each start."""
    total = np.zeros(len(starts), "uint64")
    for k in range(length):
        total = _mixed(total + np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) * np.uint64(3) + hashes[starts + k]
    return _mixed(total)


def anchors(n: int, window: int = WINDOW) -> np.ndarray:
    """Anchor positions of a document of n words whose run lies in a whole window's reach."""
    if n < window:
        return np.empty(0, "int64")
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at <= n - (window - PERIOD + 1)]


def _buckets(rows: DataFrame) -> int:
    """How many parts the hashes are dealt into, each of a size a task can hold."""
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.array(values, kind))


def _groups(keys: list[np.ndarray]) -> np.ndarray:
    """Number of the group of equal keys, for sorted keys."""
    fresh = np.zeros(len(keys[0]), bool)
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.cumsum(fresh)


def _sent(keys: list[np.ndarray], rid: np.ndarray, at: np.ndarray, many: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket of hashes: keys and places in the order of their rows, which are listed with counts.

    A place of -1 says that the key was seen more than once. A row without keys
    lists places that are known to repeat.
    """
    order = np.lexsort(keys[::-1])
    group = _groups([key[order] for key in keys])
    first = np.flatnonzero(np.diff(group, prepend=-1))
    several = np.bincount(group, np.where(many[order], 2, 1)) > 1
    twice = np.empty(len(order), bool)
    twice[order] = several[group]
    once = np.sort(order[first])
    known = np.flatnonzero(twice)
    place = np.where(twice, -1, at)[once]
    bucket = (keys[0][once] >> np.uint64(32)).astype("int64") % buckets
    parts = [_packed([k[once] for k in keys], rid[once], place, bucket)]
    if len(known):
        parts.append(_packed([np.empty(0, "uint64")] * len(keys), rid[known], at[known], _home(rid[known], buckets)))
    return pa.concat_batches(parts)


def _packed(keys: list[np.ndarray], rid: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    rid, at, bucket = rid[order], at[order], bucket[order]
    names, last = np.unique(bucket, return_index=True)
    ends = np.append(last[1:], len(bucket))
    change = np.append(True, (rid[1:] != rid[:-1]) | (bucket[1:] != bucket[:-1])) if len(rid) else np.empty(0, bool)
    runs = np.flatnonzero(change)
    lengths = np.diff(np.append(runs, len(rid)))
    run_ends = np.searchsorted(runs, ends)
    columns = [pa.array(names.astype("int32"))]
    for key in keys:
        columns.append(_list(key[order].view("int64") if len(key) else key.view("int64"), ends * bool(len(key)), pa.int64()))
    columns += [
        _list(rid[runs].view("int64"), run_ends, pa.int64()),
        _list(lengths.astype("int32"), run_ends, pa.int32()),
        _list(at.astype("int32"), ends, pa.int32()),
    ]
    return pa.record_batch(columns, ["bucket", *(f"h{i}" for i in range(len(keys))), "rid", "places", "at"])


def _sent_schema(keys: int) -> str:
    hashes = ", ".join(f"h{i} array<bigint>" for i in range(keys))
    return f"bucket int, {hashes}, rid array<bigint>, places array<int>, at array<int>"


def _gathered(parts: Iterable[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """What batches of about GROUP_PLACES places send, from (keys, row hashes, positions, seen before) of some rows each."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[2])
        if size >= GROUP_PLACES:
            yield _joined(held, buckets)
            held, size = [], 0
    if size:
        yield _joined(held, buckets)


def _joined(held: list, buckets: int) -> pa.RecordBatch:
    keys = [np.concatenate(column) for column in zip(*(k for k, *_ in held))]
    rid, at, many = (np.concatenate([part[i] for part in held]) for i in (1, 2, 3))
    return _sent(keys, rid, at, many, buckets)


def _hashed(
    known: WordHashes,
    lists: list[list[bytes]],
    rids: list[int],
    starts: list[np.ndarray],
    length: int,
    seeds: int,
    many: list[bool] | None = None,
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, row hashes, positions and `many` of the runs that start at the given positions of each word list."""
    sizes = [len(x) for x in starts]
    at = np.concatenate(starts)
    begin = np.cumsum([0, *map(len, lists)])[:-1]
    hashes = known.of([w for words in lists for w in words])
    places = at + np.repeat(begin, sizes)
    rid = np.repeat(np.array(rids, "int64").view("uint64"), sizes)
    seen = np.repeat(np.array(many if many else [False] * len(sizes), bool), sizes)
    return [run_hashes(hashes, places, length, seed) for seed in range(seeds)], rid, at, seen


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _home(rid: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a row's own places."""
    return (_mixed(rid) >> np.uint64(32)).astype("int64") % buckets


def _repeated(sent: DataFrame, keys: int, buckets: int) -> DataFrame:
    """rid and at (positions, as an array) of all places whose key was seen twice or more.

    One exchange by key finds them, a second one by row puts the places of a
    row together; what they send is listed per bucket, as before.
    """

    def judge(table: pa.Table) -> pa.Table:
        flat = lambda name: _flat(table, name)
        sizes = table.column("h0").combine_chunks().value_lengths().to_numpy()
        listed = table.column("at").combine_chunks().value_lengths().to_numpy()
        rid, at = np.repeat(flat("rid"), flat("places")), flat("at")
        with_key = np.repeat(sizes > 0, listed)
        hashes = [flat(f"h{i}") for i in range(keys)]
        good = ~with_key
        if len(hashes[0]):
            order = np.lexsort(hashes[::-1])
            group = _groups([h[order] for h in hashes])
            place = at[with_key][order]
            weight = np.bincount(group, np.where(place < 0, 2, 1))
            again = np.zeros(len(order), bool)
            again[order] = (weight[group] > 1) & (place >= 0)
            good[with_key] = again
        rid, at = rid[good], at[good]
        order = np.argsort(rid, kind="stable")
        rid, at = rid[order].view("uint64"), at[order]
        return pa.Table.from_batches([_packed([], rid, at, _home(rid, buckets))])

    def gather(table: pa.Table) -> pa.Table:
        rid, at = np.repeat(_flat(table, "rid"), _flat(table, "places")), _flat(table, "at")
        order = np.lexsort((at, rid))
        rid, at = rid[order], at[order]
        fresh = np.append(True, (rid[1:] != rid[:-1]) | (at[1:] != at[:-1])) if len(rid) else np.empty(0, bool)
        rid, at = rid[fresh], at[fresh]
        runs = np.flatnonzero(np.append(True, rid[1:] != rid[:-1])) if len(rid) else np.empty(0, "int64")
        ends = np.append(runs[1:], len(rid)) if len(rid) else runs
        return pa.table({"rid": pa.array(rid[runs], pa.int64()), "at": _list(at, ends, pa.int32())})

    found = sent.groupBy("bucket").applyInArrow(judge, "bucket int, rid array<bigint>, places array<int>, at array<int>")
    return found.groupBy("bucket").applyInArrow(gather, "rid bigint, at array<int>")


def repeated_anchors(rows: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """rid, at: the anchors of each row whose run of words also starts at another anchor anywhere."""
    length = window - PERIOD + 1

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def parts() -> Iterator:
            for batch in batches:
                rids = batch.column(0).to_pylist()
                for first, texts in slices(batch):
                    lists = [(t or b"").split() for t in texts]
                    starts = [anchors(len(words), window) for words in lists]
                    yield _hashed(known, lists, rids[first : first + len(lists)], starts, length, 1)

        yield from _gathered(parts(), buckets)

    return _repeated(rows.select("rid", "text").mapInArrow(each, _sent_schema(1)), 1, buckets)


def _near(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of the windows that hold the run of one of the anchors."""
    starts = np.unique((at.astype("int64")[:, None] - np.arange(PERIOD)).ravel())
    return starts[(starts >= 0) & (starts <= n - window)]


def repeated_windows(rows: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """rid, at: starts of the windows that occur elsewhere too.

    `rows` has rid, text, at (repeated anchors) and copied, true for a text that
    stands for further equal ones.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def parts() -> Iterator:
            for batch in batches:
                rids, found, copied = batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()
                for first, texts in slices(batch):
                    lists = [(t or b"").split() for t in texts]
                    here = slice(first, first + len(lists))
                    starts = [
                        _near(found[i].values.to_numpy(), len(words), window) for i, words in enumerate(lists, first)
                    ]
                    yield _hashed(known, lists, rids[here], starts, window, 2, copied[here])

        yield from _gathered(parts(), buckets)

    return _repeated(rows.select("rid", "text", "at", "copied").mapInArrow(each, _sent_schema(2)), 2, buckets)


def _words_left(text: bytes | None, starts: list[int], window: int) -> tuple[int, list[bytes]]:
    """Number of words and those outside the windows that begin at `starts`."""
    words = (text or b"").split()
    n = len(words)
    if not starts:
        return n, words
    edge = np.zeros(n + 1, "int64")
    starts = np.unique(np.array(starts, "int64"))
    edge[starts] += 1
    edge[starts + window] -= 1
    return n, [words[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]


def _told(n: int, left: list[bytes], digest: bool) -> tuple[int, int, bytes]:
    kept = b" ".join(left)
    return n, n - len(left), hashlib.sha256(kept).hexdigest().encode() if digest else kept


def _first_judgement(joined: DataFrame, digest: bool) -> DataFrame:
    """Results of the rows that need no comparison of windows; the texts of those that take part in it.

    A row without a repeated anchor loses nothing, one of several equal texts
    (`copied`) loses all. Of these, one (`stands`) takes part for the others.
    """
    schema = (
        "doc_id bigint, text binary, at array<int>, copied boolean, "
        "n_words bigint, n_removed bigint, kept binary"
    )
    types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "text", "at", "copied", "n_words", "n_removed", "kept"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2)
            copied, stands = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, texts in slices(batch):
                out = []
                for i, text in enumerate(texts, first):
                    n, words = _words_left(text, [], 1)
                    opened = found[i].is_valid
                    told = (None, None, None)
                    if copied[i] or not opened:
                        told = _told(n, [] if copied[i] else words, digest)
                    passed = (text, found[i].as_py()) if opened and (stands[i] or not copied[i]) else (None, None)
                    out.append((ids[i], *passed, copied[i], *told))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return joined.select("doc_id", "text", "at", "copied", "stands").mapInArrow(each, schema)


def _last_judgement(rows: DataFrame, window: int, digest: bool) -> DataFrame:
    """Results of the rows whose windows were compared, from doc_id, text and at (repeated windows)."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2)
            for first, texts in slices(batch):
                out = []
                for i, text in enumerate(texts, first):
                    out.append((ids[i], *_told(*_words_left(text, found[i].as_py(), window), digest)))
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_words", "n_removed", "kept"]
                )

    return rows.select("doc_id", "text", "at").mapInArrow(
        each, "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
    )


def remove_repeated(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of `docs`.

    Removed is each word of a window that starts anywhere else too, judged on
    the input. `kept` has the words left, one blank between, or with `digest`
    their SHA-256. Null texts have no words; texts under `window` words lose
    none. Equal texts repeat each other, whatever their ids, and rows equal in
    all stay as many rows.
    """
    rows = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("rid"),
        F.xxhash64(F.lit(window), "text").alias("rid2"),  # with rid, 128 bits that name a text
    )
    buckets = _buckets(rows)
    texts = rows.groupBy("rid", "rid2").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    known = settle(texts.join(repeated_anchors(rows, buckets, window), "rid"), "repeated-anchors")
    joined = (
        rows.join(known, ["rid", "rid2"], "left")
        .withColumn("copied", F.coalesce(F.col("n") > 1, F.lit(False)))
        .withColumn("stands", F.col("doc_id").eqNullSafe(F.col("least")))
    )
    # The number is written with the row: a name that no other row has.
    first = _first_judgement(joined, digest).withColumn("rid", F.monotonically_increasing_id())
    first = settle(first, "judged-rows")
    open_rows = first.where("text is not null").select("rid", "doc_id", "text", "at", "copied")
    windows = repeated_windows(open_rows, buckets, window)
    left = open_rows.where("not copied").select("rid", "doc_id", "text").join(windows, "rid", "left")
    results = ["doc_id", "n_words", "n_removed", "kept"]
    out = first.where("n_words is not null").select(*results).unionByName(_last_judgement(left, window, digest))
    return out.withColumn("kept", F.col("kept").cast("string"))
