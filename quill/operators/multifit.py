"""Logistic regressions of many settings, fitted together.

All trials share their features, so they share the passes over them: each pass
computes the loss and the gradient of every trial at its present point, a task
adds up its rows, Spark adds up the tasks by trial, and the driver takes the next
step of every trial (limited-memory BFGS with step halving).  The number of
passes is that of the slowest trial, not their sum.

The model is that of Spark ML's binary logistic regression with standardisation:
features are scaled by their sample deviation, not centred; the penalty is
``reg_param`` / 2 times the squared length of the scaled weights, the intercept
is free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.session import staged

MEMORY, ARMIJO, HALVINGS = 10, 1e-4, 20
# Entries of the (entry, trial) tables that a task works on at once.
ENTRIES = 1 << 21
# A row as the passes read it: its used columns and their scaled values, each as one buffer of numbers.
PACKED = "col binary, val binary, label double"
# The fewest tasks of a pass, if there are rows for them.
TASKS = 8


def sparse_rows(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(at, x, label) of vectors, written once."""
    p = df.select(F.unwrap_udt(features).alias("v"), F.col(label).cast("double").alias("label"))
    dense = F.slice(F.sequence(F.lit(0), F.size("v.values")), 1, F.size("v.values"))
    return staged(p.select(F.coalesce("v.indices", dense).alias("at"), F.col("v.values").alias("x"), "label"), "sparse-rows")


class Scale(NamedTuple):
    """Column of each used feature, by feature number (-1: unused), and one over its deviation."""

    column: np.ndarray
    inverse: np.ndarray


def scale_of(rows: DataFrame) -> Scale:
    """The features that vary in ``rows``; their number is bounded by the size of the feature space."""
    n = rows.count()
    one = rows.select(F.explode(F.arrays_zip("at", "x")).alias("e")).groupBy(F.col("e.at").alias("at")).agg(
        F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("s2")).collect()
    found = sorted((r["at"], np.sqrt(max(0.0, (r["s2"] - r["s"] ** 2 / n) / max(1, n - 1)))) for r in one)
    found = [(i, d) for i, d in found if d > 0]
    column = np.full(1 + max((i for i, _ in found), default=0), -1, np.int64)
    column[[i for i, _ in found]] = np.arange(len(found))
    return Scale(column, np.array([1 / d for _, d in found]))


def _cuts(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of rows of a bounded number of entries: first row and the row after, first entry and the entry after."""
    step = ENTRIES // 64
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(step, ends[-1] if len(ends) else 0, step)), [len(ends)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield lo, hi, (ends[lo - 1] if lo else 0), ends[hi - 1]


def _entries(b: pa.RecordBatch, scale: Scale) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, scaled value, labels) of runs of rows; ``row`` numbers the rows of the run."""
    sizes = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
    at, x = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
    label = b.column(2).to_numpy(zero_copy_only=False)
    column = np.where(at < len(scale.column), scale.column[np.minimum(at, len(scale.column) - 1)], -1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for lo, hi, a, z in _cuts(np.cumsum(sizes)):
        use = column[a:z] >= 0
        col = column[a:z][use]
        yield row[a:z][use] - lo, col, x[a:z][use] * scale.inverse[col], label[lo:hi]


def packed(rows: DataFrame, scale: Scale) -> DataFrame:
    """Sparse rows as ``PACKED``, written once: the passes neither convert arrays nor look columns up again."""
    sent = rows.sparkSession.sparkContext.broadcast(scale)

    def buffers(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
        offsets = (ends * numbers.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, col, val, y in _entries(b, sent.value):
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
                yield pa.RecordBatch.from_arrays([buffers(col.astype(np.int32), ends), buffers(val, ends), pa.array(y)],
                                                 names=["col", "val", "label"])
    return staged(rows.mapInArrow(pack, PACKED), "packed-rows")


def _numbers(c: pa.Array, dtype: type) -> np.ndarray:
    """The numbers of all values of a binary column, one after the other."""
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset:c.offset + len(c) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(dtype) if data is not None else np.empty(0, dtype)


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_entries``, of packed rows."""
    sizes = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False) // 4
    col, val, label = _numbers(b.column(0), np.int32), _numbers(b.column(1), np.float64), b.column(2).to_numpy(zero_copy_only=False)
    for lo, hi, a, z in _cuts(np.cumsum(sizes)):
        yield np.repeat(np.arange(hi - lo), sizes[lo:hi]), col[a:z], val[a:z], label[lo:hi]


def _margins(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """(row, trial): weights (trial, column; the last is the intercept) times features."""
    out = np.empty((n, len(w)))
    for t, own in enumerate(w):
        out[:, t] = np.bincount(row, val * own[col], n) + own[-1]
    return out


class Fits:
    """All trials' weights (trial, column and intercept), and the passes it took to find them."""

    def __init__(self, rows: DataFrame, regs: Sequence[float], max_iter: Sequence[int], tol: float = 1e-6) -> None:
        self.scale = scale_of(rows)
        self.n = rows.count()
        # every task gives out a gradient of all trials, so there are as many tasks as run at once, whatever the rows
        self.rows = packed(rows, self.scale).coalesce(max(TASKS, rows.sparkSession.sparkContext.defaultParallelism))
        self.regs, self.max_iter, self.tol = np.array(regs, float), np.array(max_iter, int), tol
        self.passes = 0
        self.weights = self._fit()

    def losses(self, w: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of the active trials, one pass."""
        spark = self.rows.sparkSession
        sent = spark.sparkContext.broadcast(w[active])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = sent.value
            total = np.zeros((len(weights), weights.shape[1] + 1))
            for b in batches:
                for row, col, val, y in _unpacked(b):
                    z = _margins(row, col, val, len(y), weights)
                    s = np.where(y > 0.5, 1.0, -1.0)[:, None]
                    total[:, 0] += np.logaddexp(0, -s * z).sum(axis=0)
                    r = -s / (1 + np.exp(np.minimum(s * z, 700)))
                    for t, own in enumerate(np.ascontiguousarray(r.T)):
                        total[t, 1:-1] += np.bincount(col, val * own[row], weights.shape[1] - 1)
                    total[:, -1] += r.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(weights)), pa.int32()), pa.array([x.tobytes() for x in total])],
                                             names=["trial", "part"])

        def add(pdf):
            total = sum(np.frombuffer(x) for x in pdf["part"])
            return pdf.head(1).assign(part=[total.tobytes()])

        found = self.rows.mapInArrow(run, "trial int, part binary").groupBy("trial").applyInPandas(add, "trial int, part binary").collect()
        sent.unpersist()
        self.passes += 1
        total = np.zeros((len(active), w.shape[1] + 1))
        for r in found:
            total[r["trial"]] = np.frombuffer(r["part"])
        loss, grad = total[:, 0] / self.n, total[:, 1:] / self.n
        reg = self.regs[active]
        loss = loss + reg / 2 * (w[active, :-1] ** 2).sum(axis=1)
        grad[:, :-1] += reg[:, None] * w[active, :-1]
        return loss, grad

    def _fit(self) -> np.ndarray:
        trials, size = len(self.regs), len(self.scale.inverse) + 1
        w = np.zeros((trials, size))
        every = np.arange(trials)
        loss, grad = self.losses(w, every)
        past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in every]
        step, halved, iteration = np.ones(trials), np.zeros(trials, int), np.zeros(trials, int)
        direction = -grad / np.maximum(np.sqrt((grad * grad).sum(axis=1, keepdims=True)), 1e-12)
        slope = (grad * direction).sum(axis=1)
        active = np.flatnonzero((self.max_iter > 0) & (np.abs(grad).max(axis=1) > self.tol))
        while len(active):
            point = w.copy()
            point[active] += step[active, None] * direction[active]
            f, g = self.losses(point, active)
            still = []
            for i, t in enumerate(active):
                if f[i] > loss[t] + ARMIJO * step[t] * slope[t] and halved[t] < HALVINGS:
                    step[t] /= 2
                    halved[t] += 1
                    still.append(t)
                    continue
                s, y = point[t] - w[t], g[i] - grad[t]
                if s @ y > 1e-12:
                    past[t] = [*past[t], (s, y)][-MEMORY:]
                gain = loss[t] - f[i]
                w[t], loss[t], grad[t] = point[t], f[i], g[i]
                iteration[t] += 1
                if iteration[t] >= self.max_iter[t] or gain <= self.tol * max(abs(f[i]), 1e-12) or np.abs(g[i]).max() <= self.tol * 1e-2:
                    continue
                direction[t] = _direction(past[t], g[i])
                slope[t] = g[i] @ direction[t]
                step[t], halved[t] = 1.0, 0
                still.append(t)
            active = np.array(still, int)
        return w

    def confusion(self, rows: DataFrame) -> np.ndarray:
        """(trial, label, prediction) counts on other rows, one pass."""
        sent = rows.sparkSession.sparkContext.broadcast((self.weights, self.scale))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, scale = sent.value
            total = np.zeros((len(weights), 2, 2), np.int64)
            for b in batches:
                for row, col, val, y in _entries(b, scale):
                    hit = _margins(row, col, val, len(y), weights) > 0
                    for label in (0, 1):
                        own = hit[(y > 0.5) == bool(label)]
                        total[:, label, 1] += own.sum(axis=0)
                        total[:, label, 0] += len(own) - own.sum(axis=0)
            cell = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel())], names=["cell", "n"])

        out = np.zeros(len(self.weights) * 4, np.int64)
        for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r["cell"]] = r["n"]
        return out.reshape(-1, 2, 2)


def _direction(past: list[tuple[np.ndarray, np.ndarray]], g: np.ndarray) -> np.ndarray:
    """The quasi-Newton direction from the last steps and gradient changes."""
    q, kept = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(kept), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def f1_weighted(confusion: np.ndarray) -> np.ndarray:
    """Weighted F1 of each trial."""
    c = confusion.astype(float)
    support, predicted, right = c.sum(axis=2), c.sum(axis=1), np.einsum("tii->ti", c)
    f1 = 2 * right / np.maximum(support + predicted, 1)
    return (f1 * support).sum(axis=1) / np.maximum(support.sum(axis=1), 1)
