"""Feature pooling over long token tables (F1-F8).

Input ``tokens(id, pos, vec array<double>[, mask boolean])``. Pooling is a
group-by on the sequence id, of partial results that combine before the
shuffle: running maxima and means of vectors (``pyspark.ml.stat.Summarizer``),
and for attention a running maximum, rescaled sum and weighted vector. No
task holds a sequence, however long. First/last token are
``where``/``max_by``.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masked(tokens: DataFrame, include_padding: bool) -> DataFrame:
    if include_padding or "mask" not in tokens.columns:
        return tokens
    return tokens.where(F.col("mask"))


def _fold(vecs, op):
    """Elementwise fold of a non-empty array of equal-length vectors."""
    first = F.element_at(vecs, 1)
    rest = F.slice(vecs, 2, F.size(vecs) - 1)
    return F.aggregate(rest, first, lambda acc, v: F.zip_with(acc, v, op))


def _summary(tokens: DataFrame, metric) -> DataFrame:
    rows = tokens.where(F.col("vec").isNotNull()).select(
        "id", array_to_vector("vec").alias("_v"))
    return rows.groupBy("id").agg(vector_to_array(metric(F.col("_v")))
                                  .alias("feature"))


def max_pool(tokens: DataFrame, include_padding: bool = False) -> DataFrame:
    """per-dimension max over positions (pads excluded by default)."""
    return _summary(_masked(tokens, include_padding), Summarizer.max)


def mean_pool(tokens: DataFrame, include_padding: bool = False) -> DataFrame:
    """per-dimension mean over positions."""
    return _summary(_masked(tokens, include_padding), Summarizer.mean)


def first_token(tokens: DataFrame) -> DataFrame:
    """the state at position 0 (narrow: no shuffle)."""
    return tokens.where(F.col("pos") == 0).select(
        "id", F.col("vec").alias("feature"))


def last_token(tokens: DataFrame, include_padding: bool = False) -> DataFrame:
    """the state at the last (unpadded) position."""
    t = _masked(tokens, include_padding)
    return t.groupBy("id").agg(F.max_by("vec", "pos").alias("feature"))


def layer_select(layers: DataFrame, layer: int) -> DataFrame:
    """F5 (``inter``): first-token state of one layer."""
    return layers.where(F.col("layer") == layer).select(
        "id", F.col("vec").alias("feature"))


# Bound for broadcasting the (task, layer, weight) table of F6.
MIXTURE_BROADCAST_ROWS = 100_000


def layer_mixture(layers: DataFrame, scores: DataFrame,
                  task_of: DataFrame) -> DataFrame:
    """per task, softmax over its layer scores (layers >= 1; the
    embedding layer 0 is excluded), weighted sum of first-token states.

    ``scores(task_id, layer, score)`` is tasks x layers rows (broadcast
    after a row-count check); ``task_of(id, task_id)``.
    """
    s = scores.where(F.col("layer") >= 1)
    mx = F.max("score").over(_w("task_id"))
    e = s.withColumn("_e", F.exp(F.col("score") - mx))
    w = e.withColumn("w", F.col("_e") / F.sum("_e").over(_w("task_id"))) \
        .select("task_id", "layer", "w")
    lt = layers.where(F.col("layer") >= 1).join(task_of, "id")
    # Broadcast behind a row-count check (tasks x layers is model config,
    # but it is checked rather than assumed). Beyond it a join on salted
    # keys: a task and layer is a hot key.
    if w.limit(MIXTURE_BROADCAST_ROWS + 1).count() <= MIXTURE_BROADCAST_ROWS:
        j = lt.join(F.broadcast(w), ["task_id", "layer"])
    else:
        many = w.withColumn("_salt", F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(63).cast("long"))))
        j = lt.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).join(
            many, ["task_id", "layer", "_salt"])
    g = j.groupBy("id").agg(F.collect_list(F.transform(
        "vec", lambda x: x * F.col("w"))).alias("_v"))
    return g.select("id", _fold(F.col("_v"), lambda a, b: a + b)
                    .alias("feature"))


def _w(key):
    from pyspark.sql import Window
    return Window.partitionBy(key)


def pooler_output(df: DataFrame, col: str = "pooled") -> DataFrame:
    """F8 (``origin``): a supplied pooled vector."""
    return df.select("id", F.col(col).alias("feature"))


def _attend_batches(weights, n_heads: int):
    """A row for each sequence of a batch: per head the largest score, the
    sum of exponentials above it and the mean vector with these weights."""
    def run(batches):
        own = weights.value
        wk, wv = own["wk"], own["wv"]
        query = own["task_embedding"] @ own["wq"]       # tasks x d
        d = query.shape[1]
        dh = d // n_heads
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            order = np.argsort(batch.column("id").to_numpy(
                zero_copy_only=False), kind="stable")
            ids = batch.column("id").to_numpy(zero_copy_only=False)[order]
            x = batch.column("vec").flatten().to_numpy(
                zero_copy_only=False).astype(np.float64).reshape(
                -1, wk.shape[0])[order]
            on = batch.column("mask").to_numpy(
                zero_copy_only=False).astype(bool)[order]
            task = batch.column("task_id").to_numpy(
                zero_copy_only=False).astype(np.int64)[order]
            score = ((x @ wk) * query[task]).reshape(-1, n_heads, dh).sum(
                axis=2) / np.sqrt(dh)
            score = np.where(on[:, None], score, -np.inf)
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            size = np.diff(np.r_[start, n])
            top = np.maximum.reduceat(score, start, axis=0)
            with np.errstate(invalid="ignore"):
                e = np.where(on[:, None], np.exp(
                    score - np.repeat(top, size, 0)), 0.0)
            total = np.add.reduceat(e, start, axis=0)
            share = e / np.repeat(np.where(total > 0, total, 1.0), size, 0)
            mean = np.add.reduceat(np.repeat(share, dh, axis=1) * (x @ wv),
                                   start, axis=0)

            def rows(values, width):
                return pa.ListArray.from_arrays(
                    pa.array((np.arange(len(start) + 1) * width).astype(
                        np.int32)), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[start]), rows(top, n_heads),
                 rows(total, n_heads), rows(mean, d)],
                names=["id", "top", "total", "mean"])
    return run


_PARTIAL = ("id long, top array<double>, total array<double>, "
            "mean array<double>")


def attention_pool(tokens: DataFrame, task_of: DataFrame,
                   weights: Mapping[str, np.ndarray], n_heads: int = 1
                   ) -> DataFrame:
    """task-query attention pooling.

    For each head: q = task_embedding[task] @ Wq, k = x @ Wk, v = x @ Wv;
    softmax(q.k / sqrt(d_head)) over the unmasked positions; weighted sum
    of v; heads concatenated. ``weights``: ``task_embedding`` (tasks x d),
    ``wq``, ``wk``, ``wv`` (d x d). A sequence without unmasked positions
    gives zeros.

    Every Arrow batch reduces its part of a sequence to one row; parts meet
    as means weighted with ``total * exp(top - largest top)``."""
    sc = tokens.sparkSession.sparkContext
    own = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}
    width = own["wv"].shape[1] // n_heads
    t = tokens if "mask" in tokens.columns else tokens.withColumn(
        "mask", F.lit(True))
    parts = t.join(task_of, "id").select("id", "task_id", "vec", F.coalesce(
        "mask", F.lit(False)).alias("mask")).mapInArrow(
        _attend_batches(sc.broadcast(own), n_heads), _PARTIAL)

    def of(name: str, h: int) -> Column:
        return F.element_at(name, h + 1)
    best = parts.select("*", *[F.max(of("top", h)).over(W.partitionBy("id"))
                               .alias(f"_top{h}") for h in range(n_heads)])
    nothing = F.lit(float("-inf"))

    def head(h: int) -> Column:
        top = F.col(f"_top{h}")
        weight = F.when(top == nothing, 1.0).otherwise(
            of("total", h) * F.exp(of("top", h) - top))
        return vector_to_array(Summarizer.mean(array_to_vector(F.slice(
            "mean", h * width + 1, width)), weight))
    return best.groupBy("id").agg(F.concat(*map(head, range(n_heads)))
                                  .alias("feature"))


def pool(method: str, tokens: DataFrame | None = None,
         layers: DataFrame | None = None, pooled: DataFrame | None = None,
         task_of: DataFrame | None = None, **options) -> DataFrame:
    """(id, feature) by the configured method name: ``max``, ``mean``,
    ``first``, ``last`` and ``attn`` over token vectors, ``mol`` and
    ``inter`` over layer states, ``origin`` for a supplied vector. Other
    options go to the method."""
    over_tokens = {"max": max_pool, "mean": mean_pool, "first": first_token,
                   "last": last_token}
    if method in over_tokens:
        return over_tokens[method](tokens, **options)
    if method == "attn":
        return attention_pool(tokens, task_of, **options)
    if method == "mol":
        return layer_mixture(layers, task_of=task_of, **options)
    if method == "inter":
        return layer_select(layers, **options)
    if method == "origin":
        return pooler_output(pooled, **options)
    raise ValueError(f"unknown pooling method: {method!r}")
