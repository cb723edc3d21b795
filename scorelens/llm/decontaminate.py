"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as UTF-8 bytes, lower-cased, without ASCII punctuation and
with one space for blanks, so decorated passages are found too. An item
of m bytes that occurs in a document with at most e edits shares at least
m + 1 - Q * (e + 1) of its Q-grams with it, all on e + 1 neighbouring
diagonals. So shared Q-grams are counted in diagonal bands that overlap by
half, regions that reach the bound are kept, and an alignment inside the band
gives the edits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.texts import only, slices

Q = 10
EDIT_SHARE = 0.08
BLOCK_BYTES = 4 << 20
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
OUTSIDE = b"\xff"  # in no UTF-8 text
FILTER_BITS = 21
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalised(text: bytes | None) -> bytes:
    text = text or b""
    lowered = text.lower() if text.isascii() else text.decode().lower().encode()
    return b" ".join(lowered.translate(None, PUNCTUATION).split())


def budget(size: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """Edits allowed for an item, few enough for the lemma's bound to be 1 or more."""
    return max(0, min(int(share * size), size // q - 1))


def gram_hashes(line: bytes, q: int = Q) -> np.ndarray:
    """A hash for the q bytes (8 to 16) from every place."""
    if len(line) < q:
        return np.empty(0, "uint64")
    n = len(line) - q + 1
    first = np.ndarray((n,), "<u8", line, 0, (1,))
    last = np.ndarray((n,), "<u8", line, q - 8, (1,))
    return first * MULTIPLIERS[0] ^ (last * MULTIPLIERS[1] >> np.uint64(1))


@dataclass
class Items:
    """Normalised items and where each of their q-grams stands."""

    ids: list
    lines: list[bytes]
    grams: np.ndarray  # sorted and distinct
    first: np.ndarray  # of each gram, its first place in the next two; one more for the end
    item: np.ndarray
    at: np.ndarray
    passes: np.ndarray  # a coarse filter by the gram's highest bits
    short: list[int]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], q: int = Q) -> Items:
        rows = [(i, line) for i, line in ((i, normalised(t)) for i, t in rows) if line]
        ids, lines = [i for i, _ in rows], [line for _, line in rows]
        parts = [gram_hashes(line, q) for line in lines]
        grams = np.concatenate(parts) if parts else np.empty(0, "uint64")
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, "int64")
        order = np.argsort(grams, kind="stable")
        distinct, first = np.unique(grams[order], return_index=True)
        passes = np.zeros(1 << FILTER_BITS, bool)
        passes[distinct >> np.uint64(64 - FILTER_BITS)] = True
        short = [i for i, line in enumerate(lines) if len(line) < q]
        return cls(ids, lines, distinct, np.append(first, len(order)), item[order], at[order], passes, short)


def shared_grams(line: bytes, items: Items, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the line, items and places in them, of all shared q-grams."""
    hashes = gram_hashes(line, q)
    places = np.flatnonzero(items.passes[hashes >> np.uint64(64 - FILTER_BITS)])
    if not len(places) or not len(items.grams):
        return (np.empty(0, "int64"),) * 3
    found = hashes[places]
    rank = np.minimum(np.searchsorted(items.grams, found), len(items.grams) - 1)
    good = items.grams[rank] == found
    places, rank = places[good], rank[good]
    many = items.first[rank + 1] - items.first[rank]
    entry = np.repeat(items.first[rank] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(places, many), items.item[entry], items.at[entry]


def aligned(item: bytes, region: bytes, edits: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item inside the region, if it needs at most `edits`.

    Only diagonals 0 to `width` (place in the region minus place in the item)
    are computed; leftmost end among the best.
    """
    exact = region.find(item)
    if exact >= 0:
        return 0, exact, exact + len(item)
    p, t = np.frombuffer(item, "uint8"), np.frombuffer(region, "uint8")
    far = len(item) + len(region) + 1
    d = np.arange(width + 1)
    cost = np.where(d <= len(t), 0, far)
    begin = d.copy()
    padded = np.concatenate([t, np.zeros(max(0, len(p) + width + 1 - len(t)), "uint8")])
    for i in range(1, len(p) + 1):
        # The cell of diagonal d in row i stands at region place i + d.
        swap = cost + (padded[i - 1 : i + width] != p[i - 1])
        skip = np.append(cost[1:], far) + 1
        from_skip = skip < swap
        best, start = np.where(from_skip, skip, swap), np.where(from_skip, np.append(begin[1:], 0), begin)
        run = best - d
        low = np.minimum.accumulate(run)
        origin = np.maximum.accumulate(np.where(run == low, d, 0))
        cost, begin = low + d, start[origin]
        cost[i + d > len(t)] = far
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(begin[end]), len(p) + end) if cost[end] <= edits else None


def matches(lines: list[bytes], items: Items, q: int = Q, share: float = EDIT_SHARE) -> Iterator[tuple[int, int, int, int, int]]:
    """(line, item, start, end, edits): the best place of every item in every line that holds it."""
    joined = b"\n".join(lines)  # no gram reaches over a line's end: no line and no item holds this byte
    begin = np.cumsum([0, *(len(x) + 1 for x in lines)])[:-1]
    place, item, at = shared_grams(joined, items, q)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if len(place):
        sizes = np.array([len(x) for x in items.lines])
        edits = np.array([budget(n, q, share) for n in sizes])
        line = np.searchsorted(begin, place, "right") - 1
        half = edits[item] + 1
        band = (place - begin[line] - at) // half
        needed = sizes + 1 - q * (edits + 1)
        key = np.concatenate([np.stack([line, item, b]) for b in (band, band - 1)], axis=1)
        order = np.lexsort(key[::-1])
        key = key[:, order]
        fresh = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        count = np.diff(np.append(fresh, key.shape[1]))
        key = key[:, fresh]
        for x, i, b in key[:, count >= needed[key[1]]].T.tolist():
            e = int(edits[i])
            low = b * (e + 1) - e
            # An item that lacks bytes where the line begins lies on diagonals under 0.
            region = OUTSIDE * -low + lines[x][max(0, low) : max(0, low + int(sizes[i]) + 4 * e + 3)]
            found = aligned(items.lines[i], region, e, 4 * e + 3)
            if found:
                errors, a, z = found
                best[x, i] = min(best.get((x, i), (1 << 60, 0, 0)), (errors, max(0, low + a), max(0, low + z)))
    for i in items.short:
        padded = b" " + items.lines[i] + b" "
        for x, text in enumerate(lines):
            a = (b" " + text + b" ").find(padded)
            if a >= 0:
                best[x, i] = (0, a, a + len(items.lines[i]))
    for (x, i), (errors, a, z) in sorted(best.items()):
        yield x, i, a, z, errors


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row for each row of `docs` and item that it holds.

    start and end are code points of the normalised text. The whole item must
    be there with at most `share` of its bytes edited; the best, then leftmost
    place counts. Items under `q` bytes must be there as whole words; null and
    empty items and texts match nothing. The items are taken in blocks of
    BLOCK_BYTES, one scan of `docs` each, so no task is sent more.
    """
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int"
    found = []
    for items in _blocks(benchmark):
        found.append(rows.mapInArrow(_scan(items, q, share), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Distinct items in groups of bounded size."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for k in range(blocks):
        kept = items.where(block == k).distinct().collect()
        yield sorted(((r["item_id"], r["text"].encode()) for r in kept), key=lambda r: (r[0] is None, r))


def _scan(rows: list[tuple[int, bytes]], q: int, share: float):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(rows, q)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch):
                lines = [normalised(t) for t in texts]
                out = []
                for x, i, a, z, errors in matches(lines, items, q, share):
                    points = lambda k: len(lines[x][:k].decode(errors="ignore"))  # noqa: B023, E731
                    out.append((ids[first + x].as_py(), items.ids[i], points(a), points(z), errors))
                if out:
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "item_id", "start", "end", "edits"]
                    )

    return each


def keep_clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of `docs` that hold no item, columns unchanged; judged row by row, beside the row itself."""

    def clean(rows: list[tuple[int, bytes]]):
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items.of(rows, q)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for first, texts in slices(batch):
                    for x, *_ in matches([normalised(t) for t in texts], items, q, share):
                        good[first + x] = False
                yield batch.filter(pa.array(good))

        return each

    for items in _blocks(benchmark):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
