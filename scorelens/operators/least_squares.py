"""Least squares with penalties: small systems from sums of products, wide ones by conjugate gradients, steps on batches.

A penalty means what Spark's does: slopes of standardised features are shrunk by
reg / sd(y); features without variance weigh nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.vectors import nonzero_slots
from scorelens.operators.packed import packed, slot_moments
from scorelens.operators.pca import times_covariance
from scorelens.operators.splits import hash_percent
from scorelens.session import settle

# Groups that a task sums at once, and the widest system that sums of products are made for.
HELD_CELLS = 2**22
DENSE = 512
TOLERANCE, FREE, MOST = 1e-4, 10, 100_000


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The upper triangle of the sums of products of (1, x, y)."""
    full = np.column_stack([np.ones(len(y)), x, y])
    products = full.T @ full
    return products[np.triu_indices(len(products))]


def solve(moments: np.ndarray, reg_param: float) -> tuple[float, np.ndarray]:
    """Intercept and weights from the upper triangle of the sums of products of (1, x, y)."""
    size = int((np.sqrt(8 * len(moments) + 1) - 1) / 2 + 0.5)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = moments / moments[0]
    m = m + np.triu(m, 1).T
    mean, covariance = m[0, 1:-1], m[1:-1, 1:-1] - np.outer(m[0, 1:-1], m[0, 1:-1])
    y_mean = m[0, -1]
    y_sd = np.sqrt(max(0.0, m[-1, -1] - y_mean**2))
    against = m[1:-1, -1] - mean * y_mean
    sd = np.sqrt(np.clip(np.diag(covariance), 0, None))
    used = sd > 1e-9 * (1 + np.abs(mean))
    weights = np.zeros(len(mean))
    if used.any() and y_sd > 0:
        z = covariance[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        z += reg_param / y_sd * np.eye(used.sum())
        weights[used] = np.linalg.lstsq(z, against[used] / sd[used], rcond=1e-10)[0] / sd[used]
    return float(y_mean - weights @ mean), weights


def moments_by_group(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, moments) from rows with `by`, y (double) and x (array of doubles, one length).

    A task adds up all its rows of a group before anything moves, and Spark adds
    the tasks' sums up cell by cell, so a group of any size is a triangle of
    numbers per task, and none of its sums meet in one place unadded.
    """
    by = list(by)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def out(total: dict, types: list) -> pa.RecordBatch:
        columns = [pa.array([key[j] for key in total], t) for j, t in enumerate(types)]
        return pa.record_batch([*columns, pa.array(list(total.values()), pa.list_(pa.float64()))], [*by, "sums"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        types: list = []
        for batch in batches:
            types = [batch.schema.field(j).type for j in range(len(by))]
            y = batch.column(len(by)).to_numpy(zero_copy_only=False)
            lists = batch.column(len(by) + 1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(len(by))))):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                found = _moments(x[at], y[at])
                total[key] = total[key] + found if key in total else found
            if total and len(total) * len(found) > HELD_CELLS:
                yield out(total, types)
                total = {}
        if total:
            yield out(total, types)

    partial = rows.select(*by, F.col("y"), F.col("x")).mapInArrow(summed, f"{keys}, sums array<double>")
    cells = partial.select(*by, F.posexplode("sums").alias("cell", "v")).groupBy(*by, "cell").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell", "v"))).alias("cells"))
    return whole.select(*by, F.col("cells.v").alias("moments"))


def solve_by_group(rows: DataFrame, by: Sequence[str], reg_param: float = 0.0) -> DataFrame:
    """(by, intercept, weights) of a small system per group, all groups at once."""
    by = list(by)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(np.array(m), reg_param) for m in batch.column(len(by)).to_pylist()]
            if found:
                columns = [pa.array([b for b, _ in found]), pa.array([w for _, w in found], pa.list_(pa.float64()))]
                yield pa.record_batch(batch.columns[: len(by)] + columns, [*by, "intercept", "weights"])

    return moments_by_group(rows, by).mapInArrow(solved, f"{keys}, intercept double, weights array<double>")


def _wide_path(entries: DataFrame, width: int, regs: Sequence[float], tolerance: float, most: int) -> list[tuple[float, np.ndarray]]:
    """Conjugate gradients for all penalties at once.

    The residuals of the systems with other penalties are multiples of those of
    the smallest one, so one product with the covariance per step serves all.
    The driver holds a few numbers per slot and penalty.
    """
    records = packed(entries, F.col("y"), F.col("entries"), "path-entries")
    row = entries.agg(F.count("*"), F.avg("y"), F.var_pop("y")).first()
    rows, y_mean, y_sd = row[0], row[1], float(np.sqrt(row[2] or 0.0))
    _, moments = slot_moments(records, width)
    s, q, c = moments.T
    mean = s / rows
    variance = np.clip(q / rows - mean**2, 0, None)
    against = c / rows - mean * y_mean
    sd = np.sqrt(variance)
    sd = np.where(sd > 1e-9 * (1 + np.abs(mean)), sd, 0.0)
    scale = np.divide(1, sd, out=np.zeros(width), where=sd > 0)
    shifts = np.array([reg / y_sd if y_sd > 0 else 0.0 for reg in regs])
    base = shifts.min()
    extra = shifts - base

    def product(v: np.ndarray) -> np.ndarray:
        found = times_covariance(records, (scale * v)[:, None], mean, rows)[:, 0] * ((rows - 1) / rows)
        return scale * found + base * v

    # The recurrences of the shifted systems; zeta says which multiple of the base's residual theirs is.
    r = scale * against
    target = np.where(shifts > 0, tolerance, FREE * tolerance) * np.linalg.norm(r)
    p, norm = r.copy(), float(r @ r)
    x = np.zeros((len(shifts), width))
    directions = np.tile(r, (len(shifts), 1))
    zeta, zeta_before = np.ones(len(shifts)), np.ones(len(shifts))
    alpha_before, beta = 1.0, 0.0
    for step in range(most + 1):
        if (np.abs(zeta) * norm**0.5 <= target).all():
            break
        if step == most:
            raise ArithmeticError(f"not settled after {most} steps")
        turned = product(p)
        bend = float(p @ turned)
        if bend <= 0:
            break
        alpha = norm / bend
        open_ = np.abs(zeta) * norm**0.5 > 1e-2 * target
        below = alpha * beta * (zeta_before - zeta) + zeta_before * alpha_before * (1 + extra * alpha)
        zeta_next = np.where(open_, zeta * zeta_before * alpha_before / below, 0.0)
        shift_alpha = np.where(open_, alpha * zeta_next / zeta, 0.0)
        x += shift_alpha[:, None] * directions
        r = r - alpha * turned
        norm_next = float(r @ r)
        beta = norm_next / norm
        shift_beta = np.where(open_, beta * (zeta_next / zeta) ** 2, 0.0)
        directions = zeta_next[:, None] * r + shift_beta[:, None] * directions
        p = r + beta * p
        zeta_before, zeta = np.where(open_, zeta, 1.0), np.where(open_, zeta_next, 1e-300)
        alpha_before, norm = alpha, norm_next
    weights = x * scale
    return [(float(y_mean - w @ mean), w) for w in weights]


def solve_path(
    df: DataFrame, label: str, vector: str, width: int, regs: Sequence[float], tolerance: float = TOLERANCE, most: int = MOST
) -> list[tuple[float, np.ndarray]]:
    """(intercept, weights) for every penalty, from the passes of one fit.

    Up to DENSE slots one pass sums all products, and the systems are solved as
    they are. Wider ones go on until the residual of every penalty is
    `tolerance` of the first one, whatever the steps, so that the answer is the
    same in the digits that matter; `most` steps without that are an error. A
    system without penalty is often next to singular, with many answers: it
    goes to FREE times the tolerance, near the shortest one.
    """
    rows = df.select(F.col(label).cast("double").alias("y"), vector)
    if width <= DENSE:
        dense = rows.select(F.lit(0).alias("all"), "y", vector_to_array(vector).alias("x"))
        moments = np.array(moments_by_group(dense, ["all"]).first()["moments"])
        return [solve(moments, reg) for reg in regs]
    entries = rows.select("y", nonzero_slots(vector).alias("entries"))
    return _wide_path(entries, width, regs, tolerance, most)


def stochastic_steps(
    df: DataFrame, label: str, vector: str, width: int, steps: int, step_size: float, batch_percent: int, key: str = "id"
) -> tuple[float, np.ndarray]:
    """Intercept and weights after gradient steps on batches of rows, features standardised.

    Step t goes step_size / sqrt(t) down the mean gradient of its batch; a row is
    in the batch by the digest of its key and the step, so runs repeat. One
    aggregate per step; an empty batch moves nothing.
    """
    rows = settle(df.select(key, F.col(label).cast("double").alias("y"), nonzero_slots(vector).alias("entries")), "step-entries")
    sums = (
        rows.select(F.inline("entries")).groupBy("slot").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).toArrow()
    )
    slot, s, q = (sums.column(i).to_numpy() for i in range(3))
    count = rows.count()
    mean, sd = np.zeros(width), np.zeros(width)
    mean[slot] = s / count
    sd[slot] = np.sqrt(np.clip(q / count - mean[slot] ** 2, 0, None))
    scale = np.divide(1, sd, out=np.zeros(width), where=sd > 1e-9 * (1 + np.abs(mean)))
    point, free = np.zeros(width), 0.0
    for t in range(1, steps + 1):
        sent = df.sparkSession.sparkContext.broadcast((point * scale, free - float((point * scale) @ mean)))

        def each(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, intercept = sent.value
            total = np.zeros(width + 2)
            for batch in batches:
                lists = batch.column(1)
                flat = lists.flatten()
                at, value = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                miss = np.bincount(row, value * weights[at], len(lists)) + intercept - batch.column(0).to_numpy(zero_copy_only=False)
                total[:width] += np.bincount(at, value * miss[row], width)
                total[width:] += miss.sum(), len(lists)
            touched = np.flatnonzero(total)
            yield pa.record_batch([pa.array(touched.astype("int32")), pa.array(total[touched])], ["slot", "v"])

        batch = rows if batch_percent >= 100 else rows.where(hash_percent(key, f"step{t}-") < batch_percent)
        found = batch.select("y", "entries").mapInArrow(each, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(width + 2)
        total[found.column(0).to_numpy()] = found.column(1).to_numpy()
        misses, size = total[width:]
        if size:
            length = step_size / t**0.5 / size
            point = point - length * scale * (total[:width] - mean * misses)
            free -= length * misses
    weights = point * scale
    return float(free - weights @ mean), weights
