"""Ordered affine scan: ``r_i = a_i * r_{i-1} + b_i`` per group, distributed.

The running KPI of dynamic task priority (and its streaming twin) is such a
recurrence. Affine maps compose associatively, so the scan is done in
levels: inside chunks of ``width`` consecutive indices a sorted array of at
most ``width`` maps is folded in order (``aggregate``), the chunk totals form
a table ``width`` times smaller, which is scanned the same way, and each
element's exclusive prefix is the chunk prefix followed by its local prefix.
No group ever holds more than ``width`` elements below the top level; the
top level holds ``n / width**levels`` (1 for n < width**levels).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OUT = T.ArrayType(T.StructType([
    T.StructField("i", T.LongType()),
    T.StructField("pa", T.DoubleType()),
    T.StructField("pb", T.DoubleType())]))


def _exclusive_prefix(df: DataFrame, groups: list[str], idx: str, a: str,
                      b: str, width: int, depth: int) -> DataFrame:
    """(groups, idx, pa, pb): composition of all maps before ``idx``."""
    top = depth == 0
    g = df.select(*groups, F.col(idx).alias("_i"), F.col(a).alias("_a"),
                  F.col(b).alias("_b"))
    if not top:
        g = g.withColumn("_ch", F.floor(F.col("_i") / width).cast("long"))
    by = groups if top else groups + ["_ch"]
    arr = g.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("_i", "_a", "_b"))).alias("_arr"))
    init = F.struct(F.lit(1.0).alias("A"), F.lit(0.0).alias("B"),
                    F.array().cast(_OUT).alias("out"))

    def step(acc, e):
        return F.struct(
            (e["_a"] * acc["A"]).alias("A"),
            (e["_a"] * acc["B"] + e["_b"]).alias("B"),
            F.concat(acc["out"], F.array(F.struct(
                e["_i"].alias("i"), acc["A"].alias("pa"),
                acc["B"].alias("pb")))).alias("out"))

    folded = arr.select(*by, F.aggregate("_arr", init, step).alias("_f"))
    local = folded.select(*by, F.inline("_f.out"))
    if top:
        return local.select(*groups, F.col("i").alias(idx), "pa", "pb")
    chunks = folded.select(*groups, F.col("_ch").alias("_ci"),
                           F.col("_f.A").alias("_ca"),
                           F.col("_f.B").alias("_cb"))
    cpref = _exclusive_prefix(chunks, groups, "_ci", "_ca", "_cb", width,
                              depth - 1)
    cpref = cpref.select(*groups, F.col("_ci").alias("_ch"),
                         F.col("pa").alias("_cpa"), F.col("pb").alias("_cpb"))
    joined = local.join(cpref, groups + ["_ch"], "inner")
    return joined.select(*groups, F.col("i").alias(idx),
                         (F.col("pa") * F.col("_cpa")).alias("pa"),
                         (F.col("pa") * F.col("_cpb") + F.col("pb"))
                         .alias("pb"))


def scan_levels(max_idx: int, width: int = 256) -> int:
    """Fewest levels whose top group holds at most ``width`` elements."""
    levels, span = 1, width
    while max_idx >= span:
        levels, span = levels + 1, span * width
    return levels


def affine_scan(df: DataFrame, groups: Sequence[str], idx: str, a: str,
                b: str, r0: float | Column, out: str = "r",
                width: int = 256, levels: int = 3) -> DataFrame:
    """Add ``out`` = r after applying maps 0..idx (inclusive) to ``r0``.

    ``r0`` is a number or a column of ``df``, constant within a group.
    ``idx`` holds distinct integers increasing in the order within each
    group; they need not be dense (a chunk of ``width`` consecutive values
    holds at most ``width`` elements). The top level holds at most
    ``max(idx) / width**(levels-1) + 1`` elements per group.
    """
    groups = list(groups)
    pref = _exclusive_prefix(df, groups, idx, a, b, width, levels - 1)
    j = df.join(pref, groups + [idx], "inner")
    start = r0 if isinstance(r0, Column) else F.lit(r0)
    return j.withColumn(out, F.col(a) * (F.col("pa") * start + F.col("pb"))
                        + F.col(b)).drop("pa", "pb")
