"""Scoring heads (H1-H8): batch inference with broadcast weights.

Each row is scored only by its own task's head. Linear heads are array
expressions over a per-task weight table joined on ``task_id``: broadcast
when its measured size allows, otherwise joined on salted keys, since a task
is a hot key. MLP, experts and gates run as numpy matrix products on Arrow
batches (``mapInArrow``) with weights in a broadcast variable.

A row whose task has no head, or whose sizes don't fit its head, is an error.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weight tables up to this many values are broadcast (32 MB of doubles).
BROADCAST_VALUES = 4 << 20
SALTS = 64


def _dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0),
                       lambda acc, v: acc + v)


def matvec(W: Column, x: Column, b: Column | None = None) -> Column:
    """``W x (+ b)`` for W as array of rows."""
    if b is None:
        return F.transform(W, lambda w: _dot(w, x))
    return F.transform(W, lambda w, i: _dot(w, x) + F.element_at(b, i + 1))


def head_table(heads: DataFrame) -> DataFrame:
    """(task_id, cls, w array, b) rows -> (task_id, W, b) one row per task."""
    g = heads.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct("cls", "w", "b"))).alias("_h"))
    return g.select("task_id", F.col("_h.w").alias("W"),
                    F.col("_h.b").alias("bias"))


def _attach(features: DataFrame, heads: DataFrame, x: str,
            on: str | None = "task_id") -> DataFrame:
    """Each row with its weights ``W`` and ``bias``: its task's, or with
    ``on=None`` those of the one head. All rows stay; ``W`` is NULL
    where there are none. The values are counted in the rows of ``heads``
    before they are grouped, so the count shuffles nothing but its sums."""
    table = head_table(heads)
    table = table if on else table.drop("task_id")
    n = heads.agg(F.sum(F.size("w") + 1)).first()[0] or 0
    small = n <= BROADCAST_VALUES
    if small and on:
        return features.join(F.broadcast(table), on, "left")
    many = table.withColumn("_salt", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return features.withColumn("_salt", F.pmod(
        F.xxhash64(x), F.lit(SALTS))).join(
            F.broadcast(many) if small else many,
            ["_salt", *([on] if on else [])], "left").drop("_salt")


def _checked(x: str) -> Column:
    """Logits of an attached row; an error for a missing or unfit head."""
    task = F.coalesce(F.col("task_id").cast("string"), F.lit("NULL"))
    fits = F.forall("W", lambda w: F.size(w) == F.size(x))
    return F.when(F.col("W").isNull(), F.raise_error(F.concat(
        F.lit("no head for task "), task))
        .cast("array<double>")).when(
            ~fits, F.raise_error(F.concat(
                F.lit("head and feature sizes differ in task "),
                task)).cast("array<double>")
    ).otherwise(matvec(F.col("W"), F.col(x), F.col("bias")))


def linear_head(features: DataFrame, heads: DataFrame,
                x: str = "feature") -> DataFrame:
    """H1/H2: ``logits = W_task x + b_task`` (hard sharing: one linear layer
    per task over a shared feature)."""
    j = _attach(features, heads, x)
    return j.withColumn("logits", _checked(x)).drop("W", "bias")


def single_linear_head(features: DataFrame, head: DataFrame,
                       x: str = "feature") -> DataFrame:
    """H1: one linear head for every row."""
    one = head.select(F.lit(0).alias("task_id"), "cls", "w", "b")
    j = _attach(features, one, x, on=None)
    return j.withColumn("logits", _checked(x)).drop("W", "bias")


def hard_plus_head(features: DataFrame, hidden: DataFrame, heads: DataFrame,
                   x: str = "feature") -> DataFrame:
    """H3: linear -> tanh -> linear, per task. ``hidden`` has the same
    layout as ``heads`` (rows = hidden units)."""
    j = _attach(features, hidden, x)
    j = j.withColumn("_hid", F.transform(_checked(x), lambda v: F.tanh(v)))
    return linear_head(j.drop("W", "bias"), heads, "_hid").drop("_hid")


# ---------------------------------------------------------------- numpy heads

def _mlp(x: np.ndarray, layers) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=-1, keepdims=True)


def score_numpy(features: DataFrame, model: Mapping, arch: str,
                x: str = "feature") -> DataFrame:
    """H4-H6 on Arrow batches (``mapInArrow``).

    ``model``:
      ``towers``: {task: [(W, b), ...]} final per-task linear layers
      (H4 uses ``expert`` = [(W, b), ...] a shared MLP before them: ReLU
      between its layers, none after the last);
      ``experts``: [[(W, b), ...], ...] and ``gate`` (W, b) for ``moe``;
      ``gates``: {task: (W, b)} for ``mmoe``.
    Dropout is the identity at inference. Features of one batch become one
    (rows x dim) matrix from the flat Arrow values; logits of all rows are
    written into one flat array by per-task offsets, so there is no Python
    work per row.
    """
    sc = features.sparkSession.sparkContext
    bm = sc.broadcast(model)
    keep = [f.name for f in features.schema.fields if f.name != x]

    def run(batches):
        m = bm.value
        n_out = {int(t): tw[-1][0].shape[1] for t, tw in m["towers"].items()}
        for bt in batches:
            n = bt.num_rows
            col = bt.column(x)
            X = (col.flatten().to_numpy(zero_copy_only=False)
                 .astype(np.float64).reshape(n, -1) if n else
                 np.zeros((0, 0)))
            tasks = bt.column("task_id").to_numpy(zero_copy_only=False)
            known, which = np.unique(tasks, return_inverse=True)
            missing = [t for t in known.tolist() if int(t) not in n_out]
            if missing:
                raise ValueError(f"no tower for tasks {missing}")
            width = np.array([n_out[int(t)] for t in known], np.int64)[which]
            offs = np.zeros(n + 1, np.int64)
            np.cumsum(width, out=offs[1:])
            vals = np.empty(offs[-1], np.float64)
            if arch == "expert":
                shared = _mlp(X, m["expert"])
            elif arch in ("moe", "mmoe"):
                E = np.stack([_mlp(X, ex) for ex in m["experts"]], axis=1)
            for t in known:
                idx = np.nonzero(tasks == t)[0]
                if arch == "expert":
                    h = shared[idx]
                else:
                    gw, gb = m["gate"] if arch == "moe" else m["gates"][int(t)]
                    g = _softmax(X[idx] @ gw + gb)
                    h = np.einsum("ne,ned->nd", g, E[idx])
                lg = _mlp(h, m["towers"][int(t)])
                vals[offs[idx][:, None] + np.arange(lg.shape[1])] = lg
            logits = pa.ListArray.from_arrays(
                pa.array(offs.astype(np.int32), pa.int32()),
                pa.array(vals, pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [bt.column(c) for c in keep] + [logits],
                names=keep + ["logits"])

    fields = [f for f in features.schema.fields if f.name != x]
    schema = T.StructType(fields + [T.StructField(
        "logits", T.ArrayType(T.DoubleType()))])
    return features.mapInArrow(run, schema)


def score(features: DataFrame, arch: str, heads: DataFrame | None = None,
          hidden: DataFrame | None = None, model: Mapping | None = None,
          x: str = "feature") -> DataFrame:
    """H7: architecture dispatch (``hard``/``single``, ``hard_plus``,
    ``expert``, ``moe``, ``mmoe``)."""
    if arch == "hard":
        return linear_head(features, heads, x)
    if arch == "single":
        return single_linear_head(features, heads, x)
    if arch == "hard_plus":
        return hard_plus_head(features, hidden, heads, x)
    if arch in ("expert", "moe", "mmoe"):
        return score_numpy(features, model, arch, x)
    raise ValueError(f"unknown head architecture: {arch!r}")


def fit_linear_heads(features: DataFrame, x: str = "feature",
                     task_weights: Mapping[int, float] | None = None,
                     max_iter: int = 100, reg: float = 1e-4) -> dict:
    """H8: the heads that minimise, over all tasks together, the weighted
    mean of the tasks' mean cross-entropies plus ``reg`` / 2 times the sum of
    squared weights. Returns {task: model}.

    Tasks share no head parameter, so the joint objective falls apart: a
    task with share ``s`` of the weights minimises its own mean cross-entropy
    with ``reg / s``. Each is one multinomial logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    tasks = sorted(r[0] for r in features.select("task_id").distinct()
                   .collect())
    weight = {t: float((task_weights or {}).get(t, 1.0)) for t in tasks}
    if any(w <= 0 for w in weight.values()):
        raise ValueError("task weights must be positive")
    models = {}
    for t in tasks:
        d = features.where(F.col("task_id") == t).select(
            array_to_vector(x).alias("features"),
            F.col("target").cast("double").alias("label"))
        lr = LogisticRegression(
            family="multinomial", maxIter=max_iter, standardization=False,
            regParam=reg * sum(weight.values()) / weight[t])
        models[int(t)] = lr.fit(d)
    return models
