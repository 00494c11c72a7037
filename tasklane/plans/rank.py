"""Rank by levels: a global ``row_number`` without a single-task window.

A window with no partition key (or keyed by a handful of labels) sends every
row to one task. Instead the caller names *buckets*, nested from coarse to
fine and never decreasing along the ordering (parts of a position, a hash
prefix, ...). Rows are counted per finest bucket; at each level a running sum
within the parent bucket gives the offset of a bucket in its parent, and the
final ``row_number`` runs inside the finest bucket. The heavy sort is spread
over as many tasks as there are buckets, and no window at any level holds
more than the children of one bucket, however sparse the positions are.
Whether an offset table is broadcast is decided by AQE from its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def position_buckets(pos) -> list[Column]:
    """Nested buckets of an integral ordering column: its upper three groups
    of 16 bits. 65,536 consecutive positions share a finest bucket, and no
    bucket has more than 65,536 children."""
    p = _as_col(pos).cast("long")
    return [F.shiftright(p, 48),
            F.shiftright(p, 32).bitwiseAND(F.lit(0xFFFF)),
            F.shiftright(p, 16).bitwiseAND(F.lit(0xFFFF))]


def hex_bucket(hex_col, digits: int = 4) -> Column:
    """Bucket for an ordering by a hex digest: its first ``digits`` digits.
    Four digits give 65,536 buckets: about 1.5 M rows per window partition
    at 10^11 rows, and a count table of at most 65,536 rows per group."""
    return F.substring(_as_col(hex_col), 1, digits)


def _offsets(counts: DataFrame, groups: list[str], bnames: list[str]
             ) -> DataFrame:
    """Rows of the group before each bucket, from the counts of the finest
    buckets: the offset in the parent, plus the parent's."""
    parent = groups + bnames[:-1]
    running = Window.partitionBy(*parent).orderBy(bnames[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    own = counts.select(*parent, bnames[-1], F.coalesce(
        F.sum("_tl_n").over(running), F.lit(0)).alias("_tl_off"))
    if len(bnames) == 1:
        return own
    up = _offsets(counts.groupBy(*parent).agg(F.sum("_tl_n").alias("_tl_n")),
                  groups, bnames[:-1])
    up = up.select(*[F.col(k).alias(f"_tl_p_{k}") for k in parent],
                   F.col("_tl_off").alias("_tl_up"))
    cond = F.lit(True)
    for k in parent:
        cond = cond & own[k].eqNullSafe(up[f"_tl_p_{k}"])
    return own.join(up, cond).select(
        *parent, bnames[-1], (F.col("_tl_off") + F.col("_tl_up"))
        .alias("_tl_off"))


def block_rank(df: DataFrame, blocks: Sequence[str], row: str,
               groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Add ``out`` = position of the row within ``groups`` by (blocks, row),
    for rows that lie in blocks already: among the rows of a group in a block
    ``row`` counts up by one. No row moves: one row per block (an input split
    or a sorted partition) is aggregated and sent to the tasks."""
    keys = [*groups, *blocks]
    own = df.groupBy(*keys).agg(F.min(row).alias("_br_first"),
                                F.count(F.lit(1)).alias("_br_n"))
    before = Window.partitionBy(*groups).orderBy(*blocks).rowsBetween(
        Window.unboundedPreceding, -1)
    shift = own.select(*[F.col(k).alias(f"_br_k_{k}") for k in keys], (
        F.coalesce(F.sum("_br_n").over(before), F.lit(0))
        - F.col("_br_first")).alias("_br_shift"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(shift[f"_br_k_{k}"])
    return df.join(F.broadcast(shift), cond).withColumn(
        out, F.col(row) + F.col("_br_shift")).drop(
        "_br_shift", *[f"_br_k_{k}" for k in keys])


def two_level_rank(df: DataFrame, order: Sequence, buckets: Sequence,
                   groups: Sequence[str] = (), out: str = "rank",
                   base: int = 0) -> DataFrame:
    """Add ``out`` = position of the row within ``groups`` under ``order``.

    ``order`` must be a total order (ties make the result arbitrary).
    ``buckets`` are expressions, coarse to fine, that together never
    decrease along ``order``.
    The rank starts at ``base`` and is a ``long``.
    """
    groups = list(groups)
    bnames = [f"_tl_b{i}" for i in range(len(buckets))]
    tagged = df.withColumns({n: _as_col(b) for n, b in zip(bnames, buckets)})
    keys = groups + bnames

    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tl_n"))
    found = _offsets(counts, groups, bnames)
    offsets = found.select(*[F.col(k).alias(f"_tl_o_{k}") for k in keys],
                           "_tl_off")

    cond = None
    for k in keys:
        c = tagged[k].eqNullSafe(offsets[f"_tl_o_{k}"])
        cond = c if cond is None else cond & c
    joined = tagged.join(offsets, cond, "inner").drop(
        *[f"_tl_o_{k}" for k in keys])

    inner = Window.partitionBy(*keys).orderBy(*[_as_col(o) for o in order])
    ranked = joined.withColumn(
        out, (F.col("_tl_off") + F.row_number().over(inner) - 1 + base)
        .cast("long"))
    return ranked.drop("_tl_off", *bnames)
