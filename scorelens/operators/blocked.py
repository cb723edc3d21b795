"""Least squares over more slots than a process should hold: rows and weights are met block by block.

The rows' entries are records of one block of rows in one block of slots, and
weights are a table of blocks. A prediction sends blocks of the weights to the
records, and the sums of the records on to the blocks of rows.

A penalty means what Spark's does for many slots: slopes of standardised
features are shrunk by reg / sd(y), deviations with rows - 1; features without
variance weigh nothing. A fit deals the entries by blocks of slots alone: the
product of all rows with each other, K, times a vector over the rows is then
one pass, in which a block of slots is held by one task. Steps are conjugate
gradients for the weights, kept in the rows: the driver holds a few numbers per
row, and no process one per slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.vectors import nonzero_slots
from scorelens.operators.packed import BATCH_CONF, numbered, settle_records, small_batches, summed
from scorelens.session import fresh_path, released, settle

# Most rows or slots in a block, so that a place in it takes two bytes; blocks that are made of fewer, and fewest rows or slots.
BLOCK, BLOCKS, LEAST = 2**16, 64, 1024
# Entries that a task turns to records at once, and sums that it holds before it hands them on.
TASK_ENTRIES, HELD_SUMS = 2**20, 2**23
# Records and blocks in an Arrow batch: half a megabyte each, about.
BATCH = 32
TOLERANCE, MOST = 1e-4, 100_000

RECORD = "rb int, sb int, row binary, col binary, value binary"


def _small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    return small_batches(spark, BATCH)


@dataclass(frozen=True)
class _Sizes:
    """Row i is row i % row_size of block i // row_size; slot j is slot j // slot_blocks of block j % slot_blocks, which deals frequent ones out."""

    rows: int
    row_size: int
    slot_blocks: int
    slot_size: int
    at_once: int

    @classmethod
    def of(cls, spark: SparkSession, rows: int, width: int) -> _Sizes:
        row_size, slot_size = (min(BLOCK, max(LEAST, math.ceil(n / BLOCKS))) for n in (rows, width))
        return cls(rows, row_size, max(1, math.ceil(width / slot_size)), slot_size, 2 * spark.sparkContext.defaultParallelism)

    @property
    def row_blocks(self) -> int:
        return max(1, math.ceil(self.rows / self.row_size))

    def size(self, key: str) -> int:
        return self.row_size if key == "rb" else self.slot_size

    def tasks(self, key: str) -> int:
        """Two tasks a core, more where one would have more than 64 blocks."""
        blocks = self.row_blocks if key == "rb" else self.slot_blocks
        return min(blocks, max(self.at_once, blocks // 64))


def _records(rows: DataFrame, sizes: _Sizes) -> DataFrame:
    """The entries of numbered rows (number, entries) as records of RECORD."""
    names = [part.split()[0] for part in RECORD.split(", ")]

    def out(held: list[tuple]) -> pa.RecordBatch:
        number, slot, value = (np.concatenate(part) for part in zip(*held))
        key = number // sizes.row_size * sizes.slot_blocks + slot % sizes.slot_blocks
        order = np.argsort(key, kind="stable")
        key, row = key[order], (number[order] % sizes.row_size).astype("uint16")
        col, value = (slot[order] // sizes.slot_blocks).astype("uint16"), value[order]
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        keys = key[cuts[:-1]]
        blobs = [pa.array([part[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for part in (row, col, value)]
        blocks = [pa.array(k.astype("int32")) for k in (keys // sizes.slot_blocks, keys % sizes.slot_blocks)]
        return pa.record_batch([*blocks, *blobs], names)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            number = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            held.append((number, flat.field(0).to_numpy(), flat.field(1).to_numpy()))
            entries += len(number)
            if entries >= TASK_ENTRIES:
                yield out(held)
                held, entries = [], 0
        if entries:
            yield out(held)

    return rows.select("number", "entries").mapInArrow(each, RECORD)


def _product(records: DataFrame, vector: DataFrame, key: str, sizes: _Sizes) -> DataFrame:
    """(block, v) of the other side: what the records make of a vector (block, v) of the side `key`."""
    to, here, there = ("sb", "row", "col") if key == "rb" else ("rb", "col", "row")
    size = sizes.size(to)
    vector = vector.select(F.col("block").alias(key), "v").hint("shuffle_hash")

    def out(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        touched = [np.flatnonzero(total) for total in held.values()]
        at = pa.array([t.astype("int32").tobytes() for t in touched], pa.binary())
        v = pa.array([total[t].tobytes() for t, total in zip(touched, held.values())], pa.binary())
        return pa.record_batch([pa.array(list(held), pa.int32()), at, v], ["block", "at", "v"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                near, far = (np.frombuffer(batch.column(j)[i].as_buffer(), "uint16") for j in (1, 2))
                value, v = (np.frombuffer(batch.column(j)[i].as_buffer()) for j in (3, 4))
                found = np.bincount(far, value * v[near], size)
                block = batch.column(0)[i].as_py()
                held[block] = held[block] + found if block in held else found
                if len(held) * size >= HELD_SUMS:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                total = held.setdefault(batch.column(0)[i].as_py(), np.zeros(size))
                at, v = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in ((1, "int32"), (2, "float64")))
                total[at] += v
        for block, total in held.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "v"])

    met = records.join(vector, key).select(to, here, there, "value", "v")
    parts = met.mapInArrow(partial, "block int, at binary, v binary")
    return parts.repartition(sizes.tasks(to), "block").mapInArrow(summed, "block int, v binary")


def _entries(df: DataFrame, vector: str, *columns: Column) -> DataFrame:
    return numbered(df.select(*columns, nonzero_slots(vector).alias("entries")), "number", "block-rows")


@dataclass(frozen=True)
class WrittenLinearModel:
    """A linear model whose weights are a written table of blocks, which no process holds whole."""

    spark: SparkSession
    path: str
    width: int
    slot_blocks: int
    intercept: float

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("block", "v")

    def weights(self) -> DataFrame:
        """(slot, weight) of every slot."""
        blocks, width = self.slot_blocks, self.width

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    slot = np.arange(batch.column(0)[i].as_py(), width, blocks, "int32")
                    weight = np.frombuffer(batch.column(1)[i].as_buffer())[: len(slot)]
                    yield pa.record_batch([pa.array(slot), pa.array(weight)], ["slot", "weight"])

        return self.blocks().mapInArrow(each, "slot int, weight double")

    def transform(self, df: DataFrame, vector: str = "features") -> DataFrame:
        """The rows with their `prediction`, which are worked out and written when this is called."""
        rows = numbered(df, "prediction_row", "predicted-rows")
        entries = rows.select(F.col("prediction_row").alias("number"), nonzero_slots(vector).alias("entries"))
        sizes = _Sizes.of(self.spark, rows.count(), self.width)
        size = sizes.row_size

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    margin = np.frombuffer(batch.column(1)[i].as_buffer())
                    number = batch.column(0)[i].as_py() * size + np.arange(len(margin), dtype="int64")
                    yield pa.record_batch([pa.array(number), pa.array(margin)], ["prediction_row", "margin"])

        with _small_batches(self.spark):
            # Dealt by whole blocks of rows, a block of weights meets few records.
            dealt = entries.repartition(sizes.tasks("rb"), F.expr(f"number div {size}"))
            margins = _product(_records(dealt, sizes), self.blocks(), "sb", sizes)
            margins = settle(margins.mapInArrow(each, "prediction_row bigint, margin double"), "margins")
        prediction = F.lit(self.intercept) + F.coalesce("margin", F.lit(0.0))
        return rows.join(margins, "prediction_row", "left").withColumn("prediction", prediction).drop("prediction_row", "margin")


BY_SLOT = "block int, row binary, col binary, value binary, pull binary, mean binary, scale binary"
BY_SLOT_KINDS = ("int32", "uint16", "float64", "float64")


def _by_slot(records: DataFrame, sizes: _Sizes) -> DataFrame:
    """BY_SLOT of every block of slots that has entries: rows, places and values over their slot's deviation; of its slots mean / deviation, mean and 1 / deviation or 0."""
    names = [part.split()[0] for part in BY_SLOT.split(", ")]
    rows = sizes.rows

    def out(block: int, held: list[tuple]) -> pa.RecordBatch:
        row, col, value = (np.concatenate(part) for part in zip(*held))
        s, q = (np.bincount(col, value**power, sizes.slot_size) for power in (1, 2))
        mean = s / rows
        sd = np.sqrt(np.clip(q - s * mean, 0, None) / max(rows - 1, 1))
        scale = np.divide(1, sd, out=np.zeros(len(s)), where=sd > 1e-7 * (1 + np.abs(mean)))
        parts = [row, col, value * scale[col], mean * scale, mean, scale]
        return pa.record_batch([pa.array([block], pa.int32()), *(pa.array([part.tobytes()], pa.binary()) for part in parts)], names)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                if held and block != last:
                    yield out(last, held)
                    held = []
                row, col, value = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in ((2, "uint16"), (3, "uint16"), (4, "float64")))
                held.append((row + np.int32(batch.column(1)[i].as_py() * sizes.row_size), col, value))
                last = block
        if held:
            yield out(last, held)

    dealt = records.select("sb", "rb", "row", "col", "value").repartition(sizes.tasks("sb"), "sb").sortWithinPartitions("sb")
    return settle_records(dealt.mapInArrow(each, BY_SLOT), "by-slot")


def _times_rows(by_slot: DataFrame, v: np.ndarray) -> np.ndarray:
    """K v: every row's product with the sum of all centred, scaled rows, each taken v times."""
    sent, n = by_slot.sparkSession.sparkContext.broadcast((v, v.sum())), len(v)

    def add(total: np.ndarray, arrays: list[np.ndarray]) -> None:
        row, col, value, pull = arrays
        v, whole = sent.value
        u = np.bincount(col, value * v[row], len(pull)) - pull * whole
        total += np.bincount(row, value * u[col], n)
        total -= pull @ u

    found = summed(by_slot.select("row", "col", "value", "pull"), n, add, BY_SLOT_KINDS)
    sent.destroy()
    return found


def _solve(by_slot: DataFrame, y: np.ndarray, penalty: float, tolerance: float, most: int) -> np.ndarray:
    """The rows' multipliers a, of which the weights are sums.

    These are the steps that conjugate gradients take for the weights: s is
    what is left of y, K s gives the gradient's length, and p turns with it.
    """
    n = len(y)
    a, s = np.zeros(n), y.copy()
    turned = _times_rows(by_slot, s)
    p, p_turned = s.copy(), turned.copy()
    norm = first = float(s @ turned)
    for step in range(most + 1):
        if norm <= tolerance**2 * first:
            break
        if step == most:
            raise ArithmeticError(f"not settled after {most} steps")
        bent = p_turned / n + penalty * p
        alpha = norm / float(p_turned @ bent)
        a += alpha * p
        s -= alpha * bent
        turned = _times_rows(by_slot, s)
        left = float(s @ turned)
        p, p_turned, norm = s + left / norm * p, turned + left / norm * p_turned, left
    return a


def fit_linear(
    df: DataFrame, label: str, vector: str, width: int, reg: float, tolerance: float = TOLERANCE, most: int = MOST
) -> WrittenLinearModel:
    """Weights and intercept; a step is one job of one stage.

    Steps end when the gradient is `tolerance` of the first one; `most` without
    that are an error. Without penalty and with more slots than rows there are
    many answers; steps from zero go to the shortest one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "weights")
    with released(spark), _small_batches(spark):
        rows = _entries(df, vector, F.col(label).cast("double").alias("y"))
        labels = rows.select("number", "y").toArrow()
        if not labels.num_rows:
            raise ValueError("no row to fit on")
        y = np.zeros(labels.num_rows)
        y[labels.column(0).to_numpy()] = labels.column(1).to_numpy()
        y_mean, y_sd = y.mean(), y.std(ddof=1) if len(y) > 1 else 0.0
        sizes = _Sizes.of(spark, len(y), width)
        by_slot = _by_slot(_records(rows, sizes), sizes)
        answer = _solve(by_slot, y - y_mean, reg / y_sd, tolerance, most) if y_sd > 0 else np.zeros(len(y))
        shift = _write_weights(by_slot, answer, sizes, path)
    return WrittenLinearModel(spark, path, width, sizes.slot_blocks, float(y_mean - shift))


def _write_weights(by_slot: DataFrame, answer: np.ndarray, sizes: _Sizes, path: str) -> float:
    """Writes (block, v, shift) for every block of slots; the product of all weights with the means."""
    spark = by_slot.sparkSession
    sent, whole = spark.sparkContext.broadcast(answer), answer.sum()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kinds = (*BY_SLOT_KINDS, "float64", "float64")
                row, col, value, pull, mean, scale = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds, 1))
                w = scale * (np.bincount(col, value * sent.value[row], len(pull)) - pull * whole) / sizes.rows
                parts = [batch.column(0).slice(i, 1), pa.array([w.tobytes()], pa.binary()), pa.array([float(mean @ w)])]
                yield pa.record_batch(parts, ["block", "v", "shift"])

    found = by_slot.mapInArrow(each, "block int, v binary, shift double")
    every = spark.range(sizes.slot_blocks).select(F.col("id").cast("int").alias("block"))
    nothing = F.lit(bytes(8 * sizes.slot_size))
    every.join(found, "block", "left").select("block", F.coalesce("v", nothing).alias("v"), "shift").write.parquet(path)
    sent.destroy()
    return spark.read.parquet(path).agg(F.sum("shift")).first()[0] or 0.0
