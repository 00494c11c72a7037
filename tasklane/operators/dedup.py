"""Unions and deduplication.

Dedup is an aggregate, never ``dropDuplicates`` (which keeps an arbitrary
row) and never a window over the text (one hot text would sit in one task):
``min(struct(prio, pos, ...))`` has map-side partial aggregation, so a text
repeated a billion times leaves each map task as one row.
Grouping is on ``(xxhash64(key), key)``: the sort compares the 8-byte hash
first and touches the full text only on equal hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklane.plans.rank import position_buckets, two_level_rank


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ordered_union(frames: Sequence[DataFrame], pos: str = "pos",
                  src: str = "src", id_col: str = "id",
                  allow_missing: bool = False) -> DataFrame:
    """Union in the given order and number the rows 0..n-1 by
    (source order, position). ``pos`` must be unique within a source."""
    tagged = [f.withColumn(src, F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return two_level_rank(out, order=[src, pos],
                          buckets=[F.col(src), *position_buckets(pos)],
                          out=id_col)


def keep_first(df: DataFrame, key, pos: str = "pos",
               payload: Sequence[str] = ()) -> DataFrame:
    """One row per distinct key, the one with the smallest ``pos``."""
    return priority_dedup(df.withColumn("_kf_prio", F.lit(0)), key,
                          "_kf_prio", pos, payload).drop("_kf_prio")


# (prio, pos) as one decimal keeps the aggregation buffer fixed-width, so
# Spark plans a hash aggregate (a struct minimum forces a sort aggregate that
# sorts every text twice). The step between two priorities exceeds the range
# of a 64-bit position, so any position and any 32-bit priority fit.
_STEP = 20_000_000_000_000_000_000
_SHIFT = 1 << 63


def _wide(c, value: int | None = None) -> Column:
    return (F.lit(str(value)) if c is None else F.col(c)).cast("decimal(38,0)")


def _packed(prio: str, pos: str) -> Column:
    return (F.col(prio).cast("decimal(11,0)")
            * F.lit(str(_STEP)).cast("decimal(20,0)")
            + _wide(pos) + _wide(None, _SHIFT)).cast("decimal(38,0)")


def _unpacked(packed: str) -> tuple[Column, Column]:
    step = F.lit(str(_STEP)).cast("decimal(20,0)")
    within = F.pmod(F.col(packed), step)
    return ((F.col(packed) - within) / step,
            within - F.lit(str(_SHIFT)).cast("decimal(20,0)"))


def priority_dedup(df: DataFrame, key, prio: str = "prio", pos: str = "pos",
                   payload: Sequence[str] = (), key_name: str = "key"
                   ) -> DataFrame:
    """D3: first occurrence under (prio, pos) survives, one row per key.

    Returns ``key_name, prio, pos, *payload``. NULL keys form one group, as
    pandas does. Without payload the winner is ``min`` of (prio, pos) packed
    in a decimal (hash aggregate with map-side partials); with payload it is
    ``min(struct(prio, pos, *payload))``. Any 64-bit position is accepted by
    both; ``prio`` is a 32-bit integer.
    """
    fields = [prio, pos, *payload]
    keyed = df.select(_c(key).alias(key_name), *fields)
    grp = keyed.groupBy(F.xxhash64(key_name).alias("_pd_h"), key_name)
    if not payload:
        best = grp.agg(F.min(_packed(prio, pos)).alias("_pd_m"))
        types = dict(df.select(prio, pos).dtypes)
        p, n = _unpacked("_pd_m")
        return best.select(key_name, p.cast(types[prio]).alias(prio),
                           n.cast(types[pos]).alias(pos))
    best = grp.agg(F.min(F.struct(*[F.col(f) for f in fields])).alias("_pd_w"))
    return best.select(key_name, *[F.col(f"_pd_w.{f}").alias(f)
                                   for f in fields])


def dense_ids_per_source(df: DataFrame, prio: str = "prio",
                         pos: str = "pos", out: str = "id") -> DataFrame:
    """P7 after D3: ids 0..n-1 per source in position order."""
    return two_level_rank(df, order=[pos], buckets=position_buckets(pos),
                          groups=[prio], out=out)


def subtract_earlier(df: DataFrame, key, prio: str = "prio") -> DataFrame:
    """Each source loses rows whose key occurs in an earlier source.

    ``min(prio)`` per key is a fixed-width hash aggregate; the rows are then
    kept where their source is that minimum (equi-join, skew split by AQE).
    """
    k = _c(key)
    tagged = df.withColumn("_sd_k", k)
    first = (tagged.groupBy("_sd_k").agg(F.min(prio).alias("_sd_p")))
    cond = tagged["_sd_k"].eqNullSafe(first["_sd_k"]) & (
        tagged[prio] == first["_sd_p"])
    return (tagged.join(first, cond, "left_semi").drop("_sd_k"))


def overlap_audit(df: DataFrame, key, src: str = "src") -> DataFrame:
    """Keys present in more than one source (empty when decontaminated).
    One shuffle: a key's set of sources is combined before it."""
    sources = F.collect_set(F.coalesce(F.col(src).cast("string"), F.lit("")))
    return (df.select(_c(key).alias("key"), F.col(src)).groupBy("key")
            .agg(F.size(sources).cast("long").alias("n_sources"))
            .where(F.col("n_sources") > 1))
