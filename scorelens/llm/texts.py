"""Words and whole texts inside Arrow batches, and small column helpers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates words, the ASCII blanks. bytes.split() splits at the same ones.
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for a null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def blobs(column: pa.Array) -> pa.Array:
    """A string column as bytes, without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of about a megabyte each, so that word lists stay small; always whole texts."""
    column = blobs(batch.column(batch.schema.get_field_index(text)))
    start, size, held = 0, 0, []
    for i in range(len(column)):
        value = column[i].as_py()
        held.append(value)
        size += len(value or b"")
        if size >= SLICE_BYTES:
            yield start, held
            start, size, held = i + 1, 0, []
    if held:
        yield start, held


def once_per_process(key: tuple, make: Callable[[], object]) -> object:
    """make()'s result, kept for the later tasks of a worker process."""
    kept = vars(sys.modules.setdefault("scorelens_kept", types.ModuleType("scorelens_kept"))).setdefault("values", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with ours."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
