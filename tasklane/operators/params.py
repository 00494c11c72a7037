"""Parameter-table operators (A1-A3).

A model is rows ``(model_id, ord, name, vals array<double>)``; a large
tensor is held as several rows with a ``chunk`` column, so no row grows
with the model. Averaging groups by ``(name, chunk)``: each group holds one
array per model (a handful), summed with ``zip_with`` - no explode.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: parameters whose name contains this are taken from the last
# model instead of being averaged.
KEEP_LAST = "position_ids"


def chunk_params(params: DataFrame, size: int = 1 << 16,
                 chunk_len: int | None = None) -> DataFrame:
    """Split every tensor into rows of at most ``size`` values.

    An already chunked table (``chunk`` column, ``chunk_len`` values per
    chunk except the last) is split further: piece j of chunk c becomes
    chunk ``c * ceil(chunk_len / size) + j``, so chunk order is kept.
    """
    n = F.size("vals")
    sub = F.explode(F.sequence(
        F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int")))
    if "chunk" in params.columns:
        if not chunk_len:
            raise ValueError("chunk_len is required for a chunked table")
        per = -(-chunk_len // size)
        return (params.withColumn("_cp_sub", sub)
                .withColumn("vals", F.slice("vals", F.col("_cp_sub") * size + 1,
                                            F.lit(size)))
                .withColumn("chunk", (F.col("chunk") * per + F.col("_cp_sub"))
                            .cast("int"))
                .drop("_cp_sub"))
    return (params.withColumn("chunk", sub)
            .withColumn("vals", F.slice("vals", F.col("chunk") * size + 1,
                                        F.lit(size))))


def average_params(params: DataFrame, chunked: bool = False) -> DataFrame:
    """A1 + A2: elementwise mean of same-named tensors over models; names
    seen once are copied; ``position_ids`` names come from the model with
    the highest ``ord`` (last wins). Output (name, [chunk,] vals, n_models).
    Sizes that differ (see ``shape_conflicts``) are an error.
    """
    keys = ["name", "chunk"] if chunked else ["name"]
    last = F.col("name").contains(KEEP_LAST)
    # A vector has one place at least: one more is added, and cut off below.
    vector = array_to_vector(F.concat(F.col("vals").cast("array<double>"),
                                      F.array(F.lit(0.0))))
    # A3: tensors of one name that are averaged must have one size, so there
    # is one row for each name and chunk already, or an error.
    by_size = params.where(F.col("vals").isNotNull()).groupBy(
        *keys, F.size("vals").alias("_ap_size")).agg(
        Summarizer.mean(vector).alias("_ap_mean"),
        F.max_by(F.when(last, F.col("vals")), "ord").alias("_ap_last"),
        F.max("ord").alias("_ap_ord"), F.count(F.lit(1)).alias("_ap_n"))
    one = by_size.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_ap_sizes"),
        F.max_by("_ap_last", "_ap_ord").alias("_ap_last"),
        F.max_by("_ap_mean", "_ap_ord").alias("_ap_mean"),
        F.max_by("_ap_size", "_ap_ord").alias("_ap_size"),
        F.sum("_ap_n").alias("_ap_n"))
    mean = F.slice(vector_to_array("_ap_mean"), F.lit(1), F.col("_ap_size"))
    return one.select(
        *keys, F.when(last, F.col("_ap_last")).when(
            F.col("_ap_sizes") == 1, mean).otherwise(F.raise_error(F.concat(
                F.lit("sizes differ between models: "), F.col("name")))
            .cast("array<double>")).alias("vals"),
        F.when(last, F.lit(1)).otherwise(F.col("_ap_n")).cast("int")
        .alias("n_models"))


def shape_conflicts(params: DataFrame) -> DataFrame:
    """A3: names whose tensors disagree in size across models (should be
    empty). A chunked tensor's size is the sum over its chunks."""
    if "chunk" in params.columns:
        params = params.groupBy("model_id", "name").agg(
            F.sum(F.size("vals")).alias("_sc_n"))
        n = F.col("_sc_n")
    else:
        n = F.size("vals")
    return (params.groupBy("name").agg(F.count_distinct(n).alias("n_shapes"))
            .where(F.col("n_shapes") > 1))
