"""Sparse rows as a few arrays of bytes a record, for sums over all rows that are taken again and again.

A list of (slot, value) per row is turned from columns to rows and to Arrow
value by value in every pass; a record of bytes is handed on as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelens.session import fresh_path, settle

SCHEMA = "labels binary, lengths binary, slots binary, vals binary"
NAMES = ["labels", "lengths", "slots", "vals"]
KINDS = ("float64", "int32", "int32", "float64")
# Entries of one record, about: a megabyte.
RECORD_ENTRIES = 2**16
# Records that a reader and an Arrow batch hold at once, and bytes of a row group; their defaults hold a whole file.
BATCH = 16
FILE_GROUP = 2**24
BATCH_CONF, READER_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def setting(spark: SparkSession, conf: str, value: str) -> Iterator[None]:
    before = spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """Inside, tasks hold few of the rows that they read or hand on: for rows of a megabyte."""
    with setting(spark, BATCH_CONF, str(size)), setting(spark, READER_CONF, str(size)):
        yield


def settle_records(df: DataFrame, name: str) -> DataFrame:
    """`settle` for rows of a megabyte: the writer looks at its row group's size after every few of them."""
    path = fresh_path(df.sparkSession, name)
    groups = {"parquet.block.size": FILE_GROUP, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 4}
    df.write.options(**groups).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Where Spark's row numbers hold the partition.
RANGE_BITS = 33


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """A written copy of the rows with their number, from 0 without gaps, in the order in which they lie.

    A row's number inside its partition is written with it, and the sizes of
    the partitions before it, one row each, are added: no task and no driver
    holds the rows.
    """
    placed = settle(df.withColumn(column, F.monotonically_increasing_id()), name)
    part, before = f"{column}_range", f"{column}_before"
    placed = placed.withColumn(part, F.shiftright(column, RANGE_BITS))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    starts = F.broadcast(sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)))
    inside = F.col(column) - F.shiftleft(part, RANGE_BITS)
    return placed.join(starts, part).withColumn(column, inside + F.col(before)).drop(part, before)


def packed(df: DataFrame, label: Column, entries: Column, name: str) -> DataFrame:
    """A written copy of the rows' labels and of their entries, lists of (slot, value)."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            step = max(1, rows * RECORD_ENTRIES // max(len(batch.column(1).flatten()), 1))
            for first in range(0, rows, step):
                labels, lists = (batch.column(i).slice(first, step) for i in range(2))
                flat = lists.flatten()
                parts = [labels, lists.value_lengths(), flat.field(0), flat.field(1)]
                made = [p.to_numpy(zero_copy_only=False).astype(kind).tobytes() for p, kind in zip(parts, KINDS)]
                yield pa.record_batch([pa.array([m], pa.binary()) for m in made], NAMES)

    rows = df.select(label.cast("double").alias("label"), entries.alias("entries"))
    return settle_records(rows.mapInArrow(each, SCHEMA), name)


def summed(records: DataFrame, size: int, add: Callable[[np.ndarray, list[np.ndarray]], None], kinds: Sequence[str] = KINDS) -> np.ndarray:
    """`size` sums over all records; `add(total, arrays)` adds what one record, its columns as arrays of `kinds`, gives.

    Each task, as many as there are cores, adds up its records and sends one
    array to the driver, which adds those up: nothing is shuffled.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                add(total, [np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds)])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    spark = records.sparkSession
    total = np.zeros(size)
    # A pass is one stage, so there is nothing to adapt.
    with small_batches(spark), setting(spark, "spark.sql.adaptive.enabled", "false"):
        for row in records.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(each, "sums binary").collect():
            total += np.frombuffer(row["sums"])
    return total


def sums_by_slot(
    records: DataFrame, width: int, columns: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]
) -> np.ndarray:
    """A width x columns table of sums; `add(total, label, slot, value, row)` adds what one record of rows gives."""

    def each(total: np.ndarray, arrays: list[np.ndarray]) -> None:
        label, lengths, slot, value = arrays
        add(total.reshape(columns, width).T, label, slot, value, np.repeat(np.arange(len(label)), lengths))

    return np.ascontiguousarray(summed(records, width * columns, each).reshape(columns, width).T)


def slot_moments(records: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Rows, and (slots x 3): each slot's sums of values, of squares and of values times labels."""

    def add(total, label, slot, value, row):
        total[:width, 0] += np.bincount(slot, value, width)
        total[:width, 1] += np.bincount(slot, value * value, width)
        total[:width, 2] += np.bincount(slot, value * label[row], width)
        total[width, 0] += len(label)

    total = sums_by_slot(records, width + 1, 3, add)
    return round(total[width, 0]), total[:width]
