"""Task parallelism for CPU-heavy narrow stages.

A scan yields one task per file split; a handful of large files (or files
written as one row group, as the supplied tables are) would leave per-row
work such as encoding or text cleaning on a few cores. ``spread`` adds a
round-robin exchange only when the planned input has fewer partitions than
the cluster has cores; on a large multi-file input it is a no-op, so no
shuffle is added where the scan already fans out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def spread(df: DataFrame, min_partitions: int | None = None,
           keys: Sequence[Column] | None = None) -> DataFrame:
    """Fan ``df`` out to at least ``min_partitions`` (default: the session's
    parallelism) when it has fewer partitions.

    ``keys``: deterministic, content-independent columns to hash on (for a
    file scan: file path and row index), so a recomputed task after executor
    loss sends every row to the same partition and hot values do not pile
    up. Without keys: round-robin, made deterministic by Spark's local sort
    before repartition (slower).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    if keys:
        return df.repartition(target, *keys)
    return df.repartition(target)
