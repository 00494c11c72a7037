"""D2 and D3 with bitmaps instead of shuffled texts.

Bitmaps are Spark's own (``bitmap_construct_agg``, ``bitmap_or_agg``): 32,768
bits in 4 KB, merged by aggregates. ``subtract_filtered`` keeps a blocked
Bloom filter of each source's earlier keys, so that only rows it can't rule
out meet an exact join. ``dedup_late_texts`` lets 128-bit digests carry the
aggregate, keeps the winners as one bit per position and reads the texts once
more where they lie. A table of bitmaps is broadcast only if its counted size
is under ``max_bytes``; beyond it both fall back to joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklane.operators import dedup
from tasklane.plans.rank import _offsets
from tasklane.session import cut_lineage

MAX_BYTES = 32 << 20        # bound on a broadcast table of bitmaps
BLOCK_BITS = 32768          # of one bitmap, fixed by Spark
BLOCK_BYTES = BLOCK_BITS // 8
BITS_PER_KEY = 12
PROBES = 4                  # bits set for a key, 15 bits of one hash each
MAX_SOURCES = 256


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _byte(bitmap: str, bit: Column) -> Column:
    at = F.shiftright(bit, 3).cast("int")
    return F.conv(F.hex(F.substr(F.col(bitmap), at + 1, F.lit(1))), 16,
                  10).cast("int")


def _is_set(bitmap: str, bit: Column) -> Column:
    return F.getbit(_byte(bitmap, bit), F.pmod(bit, F.lit(8)).cast(
        "int")) == 1


def _set_before(bitmap: str, bit: Column) -> Column:
    """How many bits below ``bit`` are set."""
    whole = F.bitmap_count(F.substr(
        F.col(bitmap), F.lit(1), F.shiftright(bit, 3).cast("int")))
    low = F.pmod(_byte(bitmap, bit), F.pow(
        F.lit(2), F.pmod(bit, F.lit(8))).cast("int"))
    return whole + F.bit_count(low)


# ------------------------------------------------------------------- D2

def _hashed(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """``_bf_b``, the block of a key, and ``_bf_h``, the hash whose parts are
    its bits there."""
    return df.withColumns({
        "_bf_b": F.pmod(F.xxhash64(key), F.lit(blocks)),
        "_bf_h": F.xxhash64(key, F.lit(1))})


def _bits() -> list[Column]:
    return [F.shiftright("_bf_h", 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1))
            for i in range(PROBES)]


def _filter(hashed: DataFrame, by: list[str]) -> DataFrame:
    return hashed.select(*by, "_bf_b", F.explode(F.array(*_bits())).alias(
        "_bf_bit")).groupBy(*by, "_bf_b").agg(
            F.bitmap_construct_agg("_bf_bit").alias("_bf_map"))


def _tested(hashed: DataFrame, filters: DataFrame, on: dict) -> DataFrame:
    """``_bf_hit``: whether the filter may hold the row's key."""
    names = {c: f"_bf_f{i}" for i, c in enumerate([*on, "_bf_b"])}
    f = filters.withColumnsRenamed({on.get(c, c): n
                                    for c, n in names.items()})
    cond = reduce(lambda a, b: a & b, [hashed[c] == f[n]
                                       for c, n in names.items()])
    hit = reduce(lambda a, b: a & b, [_is_set("_bf_map", b)
                                      for b in _bits()])
    return hashed.join(F.broadcast(f), cond, "left").withColumn(
        "_bf_hit", F.col("_bf_map").isNotNull() & hit).drop(
            "_bf_map", *names.values())


def subtract_filtered(df: DataFrame, key, prio: str = "prio",
                      max_bytes: int = MAX_BYTES) -> DataFrame:
    """D2 by Bloom filters: the rows of ``subtract_earlier``.

    A first pass estimates the distinct keys of each source, a second sets
    their bits; each source's filter is the union of all earlier ones. Rows
    that it rules out stay where they are. The others (about 0.7 % of a source
    without overlap, at 12 bits a key) are written once and meet, in an exact
    join on the key, the earlier rows that a second filter, of these rows,
    lets through. So a text moves only if its key may occur twice, at the
    price of reading the keys five times.

    NULL keys are equal to each other. If the filters would need more than
    ``max_bytes`` or there are over ``MAX_SOURCES`` sources, or only one,
    ``subtract_earlier`` does the work. ``prio`` must not be NULL.
    """
    k = _c(key)
    sizes = df.groupBy(prio).agg(F.approx_count_distinct(
        F.xxhash64(k)).alias("n")).limit(MAX_SOURCES + 1).collect()
    prios = sorted(r[0] for r in sizes)
    if not 1 < len(prios) <= MAX_SOURCES:
        return dedup.subtract_earlier(df, key, prio)
    total = sum(r.n for r in sizes if r[0] != prios[-1])
    blocks = max(1, -(-total * BITS_PER_KEY // BLOCK_BITS))
    if (len(prios) - 1) * blocks * BLOCK_BYTES > max_bytes:
        return dedup.subtract_earlier(df, key, prio)
    hashed = _hashed(df.withColumn("_bf_k", k), F.col("_bf_k"), blocks)
    earlier = hashed.where(F.col(prio) < F.lit(prios[-1]))
    later = F.filter(F.array(*[F.lit(p) for p in prios]),
                     lambda p: p > F.col("_bf_p"))
    filters = cut_lineage(
        _filter(earlier.withColumn("_bf_p", F.col(prio)), ["_bf_p"])
        .withColumn("_bf_q", F.explode(later))
        .groupBy("_bf_q", "_bf_b").agg(
            F.bitmap_or_agg("_bf_map").alias("_bf_map")))
    tested = _tested(hashed, filters, {prio: "_bf_q"})
    kept = tested.where(~F.col("_bf_hit")).select(*df.columns)
    maybe = cut_lineage(tested.where("_bf_hit").drop("_bf_hit"))
    again = cut_lineage(_filter(maybe, []))
    first = _tested(earlier, again, {}).where("_bf_hit").groupBy(
        F.xxhash64("_bf_k").alias("_bf_x"), "_bf_k").agg(
            F.min(prio).alias("_bf_first"))
    cond = ((F.xxhash64(maybe["_bf_k"]) == first["_bf_x"])
            & maybe["_bf_k"].eqNullSafe(first["_bf_k"])
            & (first["_bf_first"] < maybe[prio]))
    return kept.unionByName(maybe.join(first, cond, "left_anti").select(
        *df.columns))


# ------------------------------------------------------------------- D3

def _winners(df: DataFrame, key: Column, prio: str, pos: str) -> DataFrame:
    """(prio, pos) of the first row of each key, found on digests. A second
    hash of the texts behind a digest must be one value."""
    digest = F.coalesce(F.unhex(F.md5(key)), F.lit(b""))
    check = F.xxhash64(key)
    best = df.select(digest.alias("_lt_d"), check.alias("_lt_x"), prio,
                     pos).groupBy("_lt_d").agg(
        F.min(dedup._packed(prio, pos)).alias("_lt_m"),
        F.min("_lt_x").alias("_lt_lo"), F.max("_lt_x").alias("_lt_hi"))
    sure = best.withColumn("_lt_m", F.when(
        F.col("_lt_lo") == F.col("_lt_hi"), F.col("_lt_m")).otherwise(
        F.raise_error(F.lit("two texts share an MD5 digest"))
        .cast("decimal(38,0)")))
    types = dict(df.select(prio, pos).dtypes)
    p, n = dedup._unpacked("_lt_m")
    return sure.select(p.cast(types[prio]).alias(prio),
                       n.cast(types[pos]).alias(pos))


def dedup_late_texts(df: DataFrame, key, prio: str = "prio",
                     pos: str = "pos", key_name: str = "key",
                     max_bytes: int = MAX_BYTES) -> DataFrame:
    """``key_name, prio, pos, id`` of the first row of each key
    under (prio, pos), with dense ids per source, as ``priority_dedup`` and
    ``dense_ids_per_source`` give.

    Only digests, priorities and positions are shuffled. The winners become a
    bitmap for each 32,768 positions with the number of winners before it; a
    second read of the rows keeps those whose bit is set, and a row's id is
    that number plus the bits set below its own: no window, and no text moves.
    If the bitmaps exceed ``max_bytes`` (sparse positions do), the winners'
    ids are joined to the rows instead: one shuffle of the texts.

    (prio, pos) must be unique, as a file and a row number are. NULL keys form
    one group.
    """
    k = _c(key)
    won = cut_lineage(_winners(df, k, prio, pos))
    bucket = F.shiftright(F.col(pos).cast("long"), 15)
    tagged = won.select(prio, F.shiftright(bucket, 16).alias("_lt_b0"),
                        bucket.alias("_lt_b1"),
                        F.col(pos).cast("long").bitwiseAND(
                            F.lit(BLOCK_BITS - 1)).alias("_lt_bit"))
    counts = tagged.groupBy(prio, "_lt_b0", "_lt_b1").agg(
        F.count(F.lit(1)).alias("_tl_n"))
    rows = df.select(k.alias(key_name), prio, pos)
    if counts.count() * BLOCK_BYTES > max_bytes:
        ids = dedup.dense_ids_per_source(won, prio, pos)
        return rows.join(ids, [prio, pos]).select(key_name, prio, pos, "id")
    offsets = _offsets(counts, [prio], ["_lt_b0", "_lt_b1"])
    maps = cut_lineage(tagged.groupBy(prio, "_lt_b0", "_lt_b1").agg(
        F.bitmap_construct_agg("_lt_bit").alias("_lt_map")).join(
            offsets, [prio, "_lt_b0", "_lt_b1"]).select(
                F.col(prio).alias("_lt_p"), "_lt_b1", "_lt_map", "_tl_off"))
    bit = F.col(pos).cast("long").bitwiseAND(F.lit(BLOCK_BITS - 1))
    near = rows.join(F.broadcast(maps), (rows[prio] == maps["_lt_p"])
                     & (bucket == F.col("_lt_b1")))
    return near.where(_is_set("_lt_map", bit)).select(
        key_name, prio, pos, (F.col("_tl_off") + _set_before("_lt_map", bit))
        .cast("long").alias("id"))
