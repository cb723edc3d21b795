"""Logistic regression for many labels, penalties or groups at once, one pass over the rows per step.

Every fit minimises its mean log loss plus reg / 2 times the squared weights of
the standardised features; features without variance weigh nothing and the
intercept is free, as in Spark's own classifier. What the fits share is the
pass: `fit_columns` fits several label columns and penalties over the same
rows, `fit_groups` one model for every group of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.vectors import nonzero_slots
from scorelens.operators.minimise import MEMORY, Minimiser
from scorelens.operators.packed import packed, settle_records, slot_moments, small_batches, sums_by_slot
from scorelens.session import settle

TOLERANCE, GROUP_TOLERANCE = 1e-7, 1e-6
MOST = 300
# Doubles that the fits under way may hold on the driver: a gigabyte.
LARGEST = 2**27
# Rows and slots of one record of the grouped fit.
CELL_ROWS = 1024
BLOCK = 4096
# Entries of a group that one task may hold: 2^24 of a place, a row and a count are 120 MB, of other values 230 MB.
HELD_ENTRIES = 2**24
# Tasks for each core over which the groups that are fitted whole are dealt.
DEALS = 8
STATE = (
    "n bigint, slots array<int>, mean array<double>, sd array<double>, "
    "steps binary, done boolean, weights array<double>, intercept double"
)
STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]


def log_loss(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - label * margin


def chance(margin: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -margin))


@dataclass
class Scaling:
    """Rows, and mean and spread of every slot; a slot without spread has spread 0."""

    rows: int
    mean: np.ndarray
    sd: np.ndarray

    @classmethod
    def of(cls, rows: int, sums: np.ndarray, squares: np.ndarray) -> Scaling:
        mean = sums / max(rows, 1)
        variance = np.clip(squares - rows * mean * mean, 0, None) / max(rows - 1, 1)
        sd = np.sqrt(variance)
        return cls(rows, mean, np.where(sd > 1e-9 * (1 + np.abs(mean)), sd, 0.0))

    def plain(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and intercept over the rows' own values from those of the standardised ones, intercept last."""
        weights = np.divide(point[:-1], self.sd, out=np.zeros(len(self.sd)), where=self.sd > 0)
        return weights, float(point[-1] - weights @ self.mean)

    def objective(self, point: np.ndarray, reg: float, loss: float, residuals: float, products: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient at a point from the sums over the rows: losses, residuals, residuals times values."""
        slopes = np.divide(products - self.mean * residuals, self.sd, out=np.zeros(len(self.sd)), where=self.sd > 0)
        gradient = np.append(slopes, residuals) / self.rows
        gradient[:-1] += reg * point[:-1]
        return loss / self.rows + reg / 2 * float(point[:-1] @ point[:-1]), gradient


@dataclass(frozen=True)
class Columns:
    """Fitted columns: weights (slots x fits), intercepts, the largest gradient entry left and the evaluations of each."""

    weights: np.ndarray
    intercepts: np.ndarray
    worst: np.ndarray
    evaluations: np.ndarray


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, value, row) of lists of (slot, value)."""
    flat = lists.flatten()
    slot, value = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    return slot, value, np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _pass(records: DataFrame, weights: np.ndarray, intercepts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all packed rows for every column: losses, residuals, residuals times values (slots x columns)."""
    width, columns = weights.shape
    sent = records.sparkSession.sparkContext.broadcast((np.asfortranarray(weights), intercepts, targets))

    def add(total, label, slot, value, row):
        weights, intercepts, targets = sent.value
        for j in range(columns):
            margin = np.bincount(row, value * weights[:, j][slot], len(label)) + intercepts[j]
            wanted = (label == targets[j]).astype(float)
            residual = chance(margin) - wanted
            total[:width, j] += np.bincount(slot, value * residual[row], width)
            total[width, j] += residual.sum()
            total[width + 1, j] += log_loss(margin, wanted).sum()

    total = sums_by_slot(records, width + 2, columns, add)
    sent.destroy()
    return total[width + 1], total[width], total[:width]


def scaling(records: DataFrame, width: int) -> Scaling:
    """From packed rows."""
    rows, moments = slot_moments(records, width)
    return Scaling.of(rows, moments[:, 0], moments[:, 1])


def fit_columns(
    df: DataFrame, label: str, vector: str, width: int, fits: Sequence[tuple[float, float]], tolerance: float = TOLERANCE, most: int = MOST
) -> Columns:
    """All of `fits`, pairs (target label, reg), over the same rows: one pass per step for all that aren't done.

    The driver holds the points of the fits; if they are many, groups of them
    follow one another.
    """
    records = packed(df, F.col(label), nonzero_slots(vector), "logistic-entries")
    scales = scaling(records, width)
    if not scales.rows:
        raise ValueError("no row to fit on")
    at_once = max(1, LARGEST // ((width + 1) * (2 * MEMORY + 6)))
    done: list[Minimiser] = []
    for first in range(0, len(fits), at_once):
        some = fits[first : first + at_once]
        steps = [Minimiser(np.zeros(width + 1), tolerance, most) for _ in some]
        while open_fits := [i for i, m in enumerate(steps) if not m.done]:
            plain = [scales.plain(steps[i].trial) for i in open_fits]
            sums = _pass(
                records,
                np.column_stack([w for w, _ in plain]),
                np.array([b for _, b in plain]),
                np.array([some[i][0] for i in open_fits]),
            )
            for i, loss, residuals, products in zip(open_fits, *sums[:2], sums[2].T):
                steps[i].feed(*scales.objective(steps[i].trial, some[i][1], loss, residuals, products))
        done += steps
    plain = [scales.plain(m.x) for m in done]
    return Columns(
        np.column_stack([w for w, _ in plain]),
        np.array([b for _, b in plain]),
        np.array([m.worst for m in done]),
        np.array([m.evaluations for m in done]),
    )


# Groups


def _keys(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)


def _state_types() -> list[pa.DataType]:
    numbers = pa.list_(pa.float64())
    return [pa.int64(), pa.list_(pa.int32()), numbers, numbers, pa.binary(), pa.bool_(), numbers, pa.float64()]


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records of up to CELL_ROWS rows of one group: by, labels, lengths, slots, values.

    A range partitioning over (by, place) splits groups of any size and keeps
    the rows of small ones together.
    """
    schema = f"{_keys(rows, by)}, labels array<double>, lengths array<int>, slots array<int>, values array<double>"
    width = len(by)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("entries").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            slot, value, _ = _flat(lists)
            parts = [table.column("y").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), slot, value]
            names = [*by, "labels", "lengths", "slots", "values"]
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            made = [table.column(i).slice(0, 1).combine_chunks() for i in range(width)]
            made = [m.chunk(0) if isinstance(m, pa.ChunkedArray) else m for m in made]
            return pa.record_batch(made + [pa.array([p], pa.list_(k)) for p, k in zip(parts, kinds)], names)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if held and (last != keys[start]):
                    yield out()
                    held = []
                last = keys[start]
                while start < i:
                    room = CELL_ROWS - sum(b.num_rows for b in held)
                    held.append(batch.slice(start, min(room, i - start)))
                    start += held[-1].num_rows
                    if sum(b.num_rows for b in held) == CELL_ROWS:
                        yield out()
                        held = []
        if held:
            yield out()

    place = F.xxhash64("y", "entries")
    dealt = rows.select(*by, "y", "entries").repartitionByRange(*by, place).sortWithinPartitions(*by, place)
    return dealt.mapInArrow(each, schema)


def _states(rows: DataFrame, by: list[str], reg: float, tolerance: float, most: int) -> DataFrame:
    """The STATE of every group at its start: rows, scaling, a Minimiser, and the model it asks about."""
    sums = rows.select(*by, F.inline("entries")).groupBy(*by, "slot").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    # A group's slots are at most the width of the vectors.
    lists = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("slot", "s", "q"))).alias("moments"))
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    both = counted.join(lists, by, "left").select(*by, "n", F.col("moments.slot").alias("slots"), "moments.s", "moments.q")
    schema = f"{_keys(rows, by)}, {STATE}"
    width = len(by)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, slots, s, q in zip(*(batch.column(i).to_pylist() for i in range(width, width + 4))):
                scales = Scaling.of(n, np.array(s or [], float), np.array(q or [], float))
                start = Minimiser(np.zeros(len(scales.mean) + 1), tolerance, most)
                made.append((n, slots or [], scales.mean.tolist(), scales.sd.tolist(), *_shown(start, scales)))
            if made:
                columns = [pa.array(c, t) for c, t in zip(zip(*made), _state_types())]
                yield pa.record_batch(batch.columns[:width] + columns, [*by, *STATE_NAMES])

    return both.mapInArrow(each, schema)


def _shown(steps: Minimiser, scales: Scaling) -> tuple:
    """steps, done, weights and intercept of a state: those to be judged next, or the answer."""
    weights, intercept = scales.plain(steps.x if steps.done else steps.trial)
    return steps.dumps(), steps.done, weights.tolist(), intercept


def _sums(cells: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """by, block, sums: losses and residuals in block -1, residuals times values of BLOCK slots in each other block.

    Tasks add up their own cells first; the blocks of a large group are then
    added up in different tasks.
    """
    width = len(by)
    schema = f"{_keys(cells, by)}, block int, sums array<double>"

    def out(total: dict, types: list) -> Iterator[pa.RecordBatch]:
        for key, (loss, residuals, products) in total.items():
            parts = [(-1, np.array([loss, residuals]))]
            parts += [(b, products[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-len(products) // BLOCK))]
            columns = [pa.array([k] * len(parts), t) for k, t in zip(key, types)]
            yield pa.record_batch(
                [*columns, pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.list_(pa.float64()))],
                [*by, "block", "sums"],
            )

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        held = 0
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(width)]
            for i in range(batch.num_rows):
                key = tuple(batch.column(j)[i].as_py() for j in range(width))
                label, lengths, slots, values, known, weights = (
                    batch.column(width + j)[i].values.to_numpy(zero_copy_only=False) for j in range(6)
                )
                place = np.searchsorted(known, slots)
                row = np.repeat(np.arange(len(label)), lengths)
                margin = np.bincount(row, values * weights[place], len(label)) + batch.column(width + 6)[i].as_py()
                residual = chance(margin) - label
                sums = total.get(key)
                if sums is None:
                    sums = total[key] = [0.0, 0.0, np.zeros(len(known))]
                    held += len(known)
                sums[0] += log_loss(margin, label).sum()
                sums[1] += residual.sum()
                sums[2] += np.bincount(place, values * residual[row], len(known))
            if held > 2**22:
                yield from out(total, types)
                total, held = {}, 0
        if total:
            yield from out(total, types)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums, types = None, None, None
        done: list[tuple] = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(width)]
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(width + 1)))):
                mine = batch.column(width + 1)[i].values.to_numpy()
                if key == last:
                    sums += mine
                    continue
                if last is not None:
                    done.append((last, sums))
                last, sums = key, mine.copy()
        if last is not None:
            done.append((last, sums))
        if done:
            columns = [pa.array([k[j] for k, _ in done], t) for j, t in enumerate([*types, pa.int32()])]
            yield pa.record_batch([*columns, pa.array([s for _, s in done], pa.list_(pa.float64()))], [*by, "block", "sums"])

    points = states.select(*by, F.col("slots").alias("known"), "weights", "intercept")
    met = cells.join(points, by).select(*by, "labels", "lengths", "slots", "values", "known", "weights", "intercept")
    partial = met.mapInArrow(judged, schema)
    return partial.repartition(*by, "block").sortWithinPartitions(*by, "block").mapInArrow(added, schema)


def _fed(states: DataFrame, sums: DataFrame, by: list[str], reg: float) -> DataFrame:
    """The states after one evaluation."""
    width = len(by)
    lists = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("block", "sums"))).alias("blocks"))
    both = states.join(lists, by).select(*by, "n", "slots", "mean", "sd", "steps", F.flatten("blocks.sums").alias("sums"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, slots, mean, sd, steps, sums in zip(*(batch.column(i).to_pylist() for i in range(width, width + 6))):
                found, scales = Minimiser.loads(steps), Scaling(n, np.array(mean, float), np.array(sd, float))
                loss, residuals, products = sums[0], sums[1], np.array(sums[2:], float)
                found.feed(*scales.objective(found.trial, reg, loss, residuals, products))
                made.append(_shown(found, scales))
            if made:
                columns = [pa.array(c, t) for c, t in zip(zip(*made), _state_types()[4:])]
                yield pa.record_batch(batch.columns[: width + 4] + columns, [*by, *STATE_NAMES])

    return both.mapInArrow(each, states.schema)


def _small(values: np.ndarray) -> np.ndarray:
    """A copy of the values, a byte each where that says the same."""
    with np.errstate(invalid="ignore"):
        counts = values.astype("uint8")
    return counts if np.array_equal(counts, values) else values.copy()


def _fitted_whole(cells: DataFrame, by: list[str], reg: float, tolerance: float, most: int) -> DataFrame:
    """by, known, weights, intercept of groups that a task can hold: each takes all its steps over the cells held there."""
    width = len(by)
    schema = f"{_keys(cells, by)}, known array<int>, weights array<double>, intercept double"

    def fit(held: list[tuple]) -> tuple:
        known = reduce(np.union1d, [np.unique(slots) for _, _, slots, _ in held])
        for i, (y, n, s, v) in enumerate(held):
            held[i] = y, np.repeat(np.arange(len(y), dtype="uint16"), n), np.searchsorted(known, s).astype("int32"), v
        sums = sum(np.bincount(place, v, len(known)) for _, _, place, v in held)
        squares = sum(np.bincount(place, v.astype(float) ** 2, len(known)) for _, _, place, v in held)
        scales = Scaling.of(sum(len(y) for y, *_ in held), sums, squares)
        steps = Minimiser(np.zeros(len(known) + 1), tolerance, most)
        while not steps.done:
            weights, intercept = scales.plain(steps.trial)
            loss, residuals, products = 0.0, 0.0, np.zeros(len(known))
            for y, row, place, value in held:
                margin = np.bincount(row, value * weights[place], len(y)) + intercept
                residual = chance(margin) - y
                loss += log_loss(margin, y).sum()
                residuals += residual.sum()
                products += np.bincount(place, value * residual[row], len(known))
            steps.feed(*scales.objective(steps.trial, reg, loss, residuals, products))
        return known, *scales.plain(steps.x)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, types = None, [], None

        def out() -> pa.RecordBatch:
            known, weights, intercept = fit(held)
            columns = [pa.array([k], t) for k, t in zip(last, types)]
            columns += [pa.array([known], pa.list_(pa.int32())), pa.array([weights], pa.list_(pa.float64())), pa.array([intercept])]
            return pa.record_batch(columns, [*by, "known", "weights", "intercept"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(width)]
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(width)))):
                if held and key != last:
                    yield out()
                    held = []
                last = key
                # Copies, as views would keep the whole batch.
                y, n, slots, values = (batch.column(width + j)[i].values.to_numpy(zero_copy_only=False) for j in range(4))
                held.append((y.copy(), n.copy(), slots.copy(), _small(values)))
        if held:
            yield out()

    tasks = DEALS * cells.sparkSession.sparkContext.defaultParallelism
    return cells.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(each, schema)


def fit_groups(
    rows: DataFrame, by: Sequence[str], reg: float, tolerance: float = GROUP_TOLERANCE, most: int = MOST, held: int = HELD_ENTRIES
) -> DataFrame:
    """by, known, weights, intercept: a model of every group of `rows` (by, y of 0 or 1, entries of (slot, value)).

    A group of up to `held` entries takes all its steps in one task. Larger
    ones take a step in the same jobs, and those that are done leave: a
    group's model, at most as wide as the vectors, goes to its rows' cells and
    the sums come back; neither rows nor sums of such a group meet in one task.
    """
    by = list(by)
    rows = settle(rows.select(*by, F.col("y").cast("double").alias("y"), "entries"), "grouped-rows")
    cells = settle_records(_cells(rows, by), "grouped-cells")
    sizes = rows.groupBy(*by).agg((F.sum(F.size("entries") + 1) > held).alias("large"))
    sizes = settle(sizes, "group-sizes")
    large, small = (sizes.where(c).select(*by) for c in ("large", "not large"))
    with small_batches(rows.sparkSession):
        models = [settle(_fitted_whole(cells.join(small, by, "left_semi"), by, reg, tolerance, most), "grouped-models")]
    states = large
    if not large.isEmpty():
        rows, cells = (settle(df.join(large, by, "left_semi"), "large-groups") for df in (rows, cells))
        states = settle(_states(rows, by, reg, tolerance, most), "grouped-states")
    done: list[DataFrame] = []
    while not states.isEmpty():
        with small_batches(rows.sparkSession):
            stepped = settle(_fed(states, _sums(cells, states, by), by, reg), "grouped-states")
        done.append(stepped.where("done"))
        states = stepped.where("not done")
    models += [d.select(*by, F.col("slots").alias("known"), "weights", "intercept") for d in done]
    return settle(reduce(DataFrame.unionByName, models), "grouped-models")


def margins_by_group(rows: DataFrame, models: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`by`, `keep` and margin of rows (by, keep, entries), by the model of each row's group; rows of other groups are dropped.

    Weights are looked up slot by slot, so no row carries a model.
    """
    by = list(by)
    weights = models.select(*by, F.inline(F.arrays_zip(F.col("known").alias("slot"), F.col("weights").alias("weight"))))
    weights = settle(weights.where("weight != 0"), "group-weights")
    named = rows.select(*by, *keep, "entries").withColumn("margin_row", F.monotonically_increasing_id())
    named = settle(named, "margin-rows")
    sums = (
        named.select(*by, "margin_row", F.inline("entries"))
        .join(weights, [*by, "slot"])
        .groupBy("margin_row")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("sum"))
    )
    found = named.drop("entries").join(models.select(*by, "intercept"), by).join(sums, "margin_row", "left")
    margin: Column = F.col("intercept") + F.coalesce("sum", F.lit(0.0))
    return found.select(*by, *keep, margin.alias("margin"))
