"""Heads of all tasks fitted together, with learned uncertainties.

Minimises ``sum_t(L_t e^{-s_t} + s_t / 2) + reg / 2 |W|^2`` over the heads
and the log variances ``s_t``, where ``L_t`` is task t's mean cross-entropy.
A head is linear (H2), or linear, tanh, linear (H3).

Every iteration is one job: each task of Spark's runs its rows through the
heads batch by batch (numpy on Arrow batches) and gives one packed vector of
losses and gradients for all heads, and ``treeReduce`` adds these up. What
travels is the model's size, whatever the rows: up to ``MAX_VALUES`` numbers.
Steps are L-BFGS; a step that doesn't lower the objective is halved, which
takes an iteration too.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.session import ship_package

MAX_VALUES = 4_000_000     # 32 MB
MEMORY = 10                # steps that L-BFGS looks back on


@dataclass(frozen=True)
class Shape:
    """Where the parameters of each task lie in the packed vector: W1, b1
    (with hidden units), W2, b2; the log variances are at the end."""
    dim: int
    hidden: int
    classes: Mapping[int, int]

    def sizes(self, task: int) -> list[tuple[int, ...]]:
        c, h = self.classes[task], self.hidden
        return [(h, self.dim), (h,), (c, h), (c,)] if h else [
            (c, self.dim), (c,)]

    @property
    def values(self) -> int:
        return sum(math.prod(s) for t in self.classes
                   for s in self.sizes(t)) + len(self.classes)

    def views(self, packed: np.ndarray) -> dict[int, list[np.ndarray]]:
        out, at = {}, 0
        for t in self.classes:
            out[t] = []
            for s in self.sizes(t):
                n = math.prod(s)
                out[t].append(packed[at:at + n].reshape(s))
                at += n
        return out

    def is_weight(self) -> np.ndarray:
        """Of the packed values: matrices, which ``reg`` holds down."""
        out = np.zeros(self.values, bool)
        for own in self.views(out).values():
            for v in own:
                v[...] = v.ndim == 2
        return out


def _add_batch(shape: Shape, heads: dict, grad: dict, loss: np.ndarray,
               task: int, x: np.ndarray, y: np.ndarray) -> None:
    """Loss and gradient sums of rows of one task."""
    own, g = heads[task], grad[task]
    h = np.tanh(x @ own[0].T + own[1]) if shape.hidden else x
    z = h @ own[-2].T + own[-1]
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1)
    rows = np.arange(len(y))
    loss[list(shape.classes).index(task)] += (
        np.log(total) - z[rows, y]).sum()
    p /= total[:, None]
    p[rows, y] -= 1
    g[-2] += p.T @ h
    g[-1] += p.sum(0)
    if shape.hidden:
        back = (p @ own[-2]) * (1 - h * h)
        g[0] += back.T @ x
        g[1] += back.sum(0)


def _gradient_batches(shape: Shape, at):
    """One row for each partition: the packed sums, the losses behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shape.views(at.value)
        out = np.zeros(shape.values + len(shape.classes))
        grad, loss = shape.views(out), out[shape.values:]
        for batch in batches:
            task = batch.column("task_id").to_numpy()
            y = batch.column("target").to_numpy()
            x = batch.column("x").flatten().to_numpy(
                zero_copy_only=False).reshape(len(y), shape.dim)
            for t in np.unique(task).tolist():
                of = task == t
                _add_batch(shape, heads, grad, loss, t, x[of], y[of])
        yield pa.RecordBatch.from_pydict({"sums": [out.tobytes()]})
    return run


class JointHeads:
    """Fitted heads of all tasks; ``log_variance`` by task."""

    def __init__(self, shape: Shape, packed: np.ndarray, objective: float,
                 losses: dict[int, float], jobs: int):
        self.shape, self.packed = shape, packed
        self.objective, self.losses, self.jobs = objective, losses, jobs
        self.log_variance = dict(zip(shape.classes, packed[
            len(packed) - len(shape.classes):].tolist(), strict=True))

    def tables(self, spark: SparkSession
               ) -> tuple[DataFrame | None, DataFrame]:
        """Hidden and output layers as ``heads.score`` takes them."""
        def table(layer: int) -> DataFrame:
            return spark.createDataFrame(
                [(t, i, row.tolist(), float(b)) for t, own in
                 self.shape.views(self.packed).items()
                 for i, (row, b) in enumerate(zip(
                     own[layer], own[layer + 1], strict=True))],
                "task_id int, cls int, w array<double>, b double")
        if self.shape.hidden:
            return table(0), table(2)
        return None, table(0)


class _Objective:
    """The objective and its gradient at a point, one job each time."""

    def __init__(self, rows: DataFrame, shape: Shape, counts: np.ndarray,
                 reg: float):
        self.rows, self.shape, self.counts, self.reg = rows, shape, counts, reg
        self.weight = shape.is_weight()
        self.jobs = 0

    def __call__(self, packed: np.ndarray
                 ) -> tuple[float, np.ndarray, np.ndarray]:
        sc = self.rows.sparkSession.sparkContext
        at = sc.broadcast(packed)
        sums = self.rows.mapInArrow(
            _gradient_batches(self.shape, at), "sums binary").rdd.map(
            lambda r: np.frombuffer(r.sums)).treeReduce(np.add)
        at.unpersist()
        self.jobs += 1
        n, k = self.shape.values, len(self.shape.classes)
        loss = sums[n:] / self.counts
        s = packed[n - k:]
        trust = np.exp(np.minimum(-s, 300.0))    # a step far off, not taken
        g = np.array(sums[:n])
        for own, share in zip(self.shape.views(g).values(),
                              trust / self.counts, strict=True):
            for v in own:
                v *= share
        g[n - k:] = 0.5 - trust * loss
        held = packed * self.weight
        g += self.reg * held
        value = float((trust * loss + s / 2).sum()
                      + self.reg / 2 * (held @ held))
        return value, g, loss


def _direction(g: np.ndarray, past: deque) -> np.ndarray:
    """L-BFGS: the gradient through the inverse curvature of past steps."""
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


def fit_jointly(features: DataFrame, x: str = "feature", hidden: int = 0,
                steps: int = 100, reg: float = 1e-4, seed: int = 0,
                tolerance: float = 1e-6) -> JointHeads:
    """Fit on rows of ``task_id``, ``target`` (0 and up) and ``x``, all of
    one length; rows with a null among them take no part, and a task without
    rows has no head. ``steps`` jobs at most, after one that counts. Log
    variances start at ln 2, as the uncertainty loss has them. With too small a
    ``reg`` a task whose classes separate has no least objective: its loss
    and variance fall as long as steps are left."""
    ship_package(features.sparkSession)
    rows = features.select(
        F.col("task_id").cast("int").alias("task_id"),
        F.col("target").cast("long").alias("target"),
        F.col(x).cast("array<double>").alias("x")).where(
        "task_id is not null and target is not null and x is not null "
        "and not exists(x, v -> v is null)").persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        # One row for each task.
        known = rows.groupBy("task_id").agg(
            F.count("*").alias("n"), F.max("target").alias("top"),
            F.min("target").alias("least"), F.min(F.size("x")).alias("short"),
            F.max(F.size("x")).alias("long")).orderBy("task_id").collect()
        dims = {d for r in known for d in (r.short, r.long)}
        if len(dims) != 1 or any(r.least < 0 for r in known):
            raise ValueError("joint fit: features of one length and targets "
                             "from 0 are needed")
        shape = Shape(dims.pop(), hidden, {r.task_id: r.top + 1
                                           for r in known})
        if shape.values > MAX_VALUES:
            raise ValueError(f"joint fit: {shape.values} parameters; up to "
                             f"{MAX_VALUES} travel with the tasks")
        at = np.zeros(shape.values)
        at[shape.values - len(known):] = math.log(2.0)
        if hidden:
            rng = np.random.default_rng(seed)
            for own in shape.views(at).values():
                own[0][...] = rng.normal(0, shape.dim ** -0.5,
                                         own[0].shape)
        objective = _Objective(rows, shape, np.array(
            [r.n for r in known], np.float64), reg)
        value, g, loss = objective(at)
        past: deque = deque(maxlen=MEMORY)
        way, size = _direction(g, past), 1 / max(1.0, np.linalg.norm(g))
        while objective.jobs < steps and np.abs(g).max() > tolerance:
            to = at + size * way
            new, slope, losses = objective(to)
            if not new <= value + 1e-4 * size * (way @ g):
                size /= 2
                if size < 1e-10:
                    break
                continue
            if (to - at) @ (slope - g) > 1e-12:
                past.append((to - at, slope - g))
            at, value, g, loss = to, new, slope, losses
            way, size = _direction(g, past), 1.0
        return JointHeads(shape, at, value, dict(zip(
            shape.classes, loss.tolist(), strict=True)), objective.jobs)
    finally:
        rows.unpersist()
