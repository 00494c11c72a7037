"""Splits and sampling (K1-K6), reproducible across engines.

Randomness comes from ``md5(seed:...)`` so that DuckDB gives the same draws;
an md5 number is its first 15 hex digits as a bigint (60 bits). Every ordering runs
through the two-level rank, so no window holds a whole label or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklane.plans.rank import (hex_bucket, position_buckets,
                                 two_level_rank)

SEED = 606
N_FOLDS = 5


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def md5_number(hex_col) -> Column:
    """First 15 hex digits of an md5 as a bigint in [0, 2^60): far more
    than any task has rows, so each row can be drawn and the modulo is
    even."""
    return F.conv(F.substring(_c(hex_col), 1, 15), 16, 10).cast("long")


def stratified_folds(df: DataFrame, id_col: str, label: str,
                     k: int = N_FOLDS, seed: int = SEED,
                     out: str = "fold") -> DataFrame:
    """K1: shuffled stratified k-fold. Rank rows inside their label by
    ``md5(seed:id)``; fold = rank mod k. Per-label fold sizes differ by <= 1.
    """
    if k < 2:
        return df.withColumn(out, F.lit(0))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    tagged = df.withColumn("_sf_key", key)
    ranked = two_level_rank(tagged, order=["_sf_key", id_col],
                            buckets=[hex_bucket("_sf_key")], groups=[label],
                            out="_sf_rank")
    return (ranked.withColumn(out, (F.col("_sf_rank") % k).cast("int"))
            .drop("_sf_key", "_sf_rank"))


def fold_select(df: DataFrame, fold: int, split: str,
                col: str = "fold") -> DataFrame:
    """K2/K3: train = other folds, val = this fold, trainval/test = all."""
    if split == "train":
        return df.where(F.col(col) != fold)
    if split == "val":
        return df.where(F.col(col) == fold)
    if split in ("trainval", "test"):
        return df
    raise ValueError(f"unknown split {split!r}")


def oversample(df: DataFrame, task: str = "task_id", id_col: str = "id",
               seed: int = SEED, chunk: int = 1 << 16) -> DataFrame:
    """K4: every task is topped up to the largest task's size by draws with
    replacement. Adds ``draw`` (NULL for original rows, j for the j-th draw).

    Draw j of task t picks the row whose rank in t is
    ``md5_number(md5(seed:t:j)) mod n_t``. Draw rows are generated in chunks
    of ``chunk`` so a large top-up spreads over many tasks; the draws meet
    the rows through an equi-join on (task, rank).
    """
    ranked = two_level_rank(df, order=[id_col],
                            buckets=position_buckets(id_col),
                            groups=[task], out="_os_rank")
    counts = df.groupBy(task).agg(F.count(F.lit(1)).alias("_os_n"))
    extra = counts.withColumn(
        "_os_extra", F.max("_os_n").over(Window.partitionBy()) - F.col("_os_n"))
    chunks = (extra.where(F.col("_os_extra") > 0)
              .withColumn("_os_c", F.explode(F.sequence(
                  F.lit(0), F.floor((F.col("_os_extra") - 1) / chunk)
                  .cast("long"))))
              .repartition(task, "_os_c"))
    draws = chunks.select(
        task, "_os_n",
        F.explode(F.sequence(
            F.col("_os_c") * chunk,
            F.least((F.col("_os_c") + 1) * chunk, F.col("_os_extra")) - 1))
        .alias("draw"))
    draws = draws.withColumn(
        "_os_rank",
        md5_number(F.md5(F.concat_ws(":", F.lit(str(seed)),
                                     F.col(task).cast("string"),
                                     F.col("draw").cast("string"))))
        % F.col("_os_n")).drop("_os_n")
    picked = ranked.join(draws, [task, "_os_rank"], "inner")
    base = ranked.withColumn("draw", F.lit(None).cast("long"))
    return base.unionByName(picked).drop("_os_rank")


def shuffle_order(df: DataFrame, id_col: str, seed: int = SEED,
                  epoch: int = 0, out: str = "order") -> DataFrame:
    """K5: seeded shuffle; ``out`` = position 0..n-1 under md5(seed:epoch:id)."""
    key = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"),
                         F.col(id_col).cast("string")))
    tagged = df.withColumn("_so_key", key)
    return two_level_rank(tagged, order=["_so_key", id_col],
                          buckets=[hex_bucket("_so_key")],
                          out=out).drop("_so_key")


def assign_batches(df: DataFrame, order: str, batch_size: int = 32,
                   accumulation: int = 8) -> DataFrame:
    """K6: micro-batch = batch_size / accumulation rows in ``order``; a step
    is ``accumulation`` consecutive micro-batches."""
    if batch_size % accumulation:
        raise ValueError("batch_size must be divisible by accumulation")
    micro = batch_size // accumulation
    return (df.withColumn("batch_id", F.floor(F.col(order) / micro)
                          .cast("long"))
            .withColumn("step", F.floor(F.col("batch_id") / accumulation)
                        .cast("long")))
