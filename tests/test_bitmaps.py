"""D2 and D3 by bitmaps against plain Python, and what their plans move."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tasklane.operators import bitmaps as B
from tasklane.operators import dedup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _table(spark, seed=5, n=4000, sources=4):
    rng = random.Random(seed)
    rows = [(p, i * rng.choice((1, 1, 97)) + i, None if rng.random() < 0.01
             else f"text {rng.randrange(n)} 中") for p in range(sources)
            for i in range(n // sources)]
    seen, unique = set(), []
    for p, q, k in rows:
        if (p, q) not in seen:
            seen.add((p, q))
            unique.append((p, q, k))
    return unique, spark.createDataFrame(
        unique, "prio int, pos long, k string").repartition(7)


def _subtracted(rows):
    first = {}
    for p, _, k in rows:
        first[k] = min(first.get(k, p), p)
    return sorted([r for r in rows if first[r[2]] == r[0]], key=str)


@pytest.mark.parametrize("max_bytes", [B.MAX_BYTES, 0])
def test_subtract_filtered(spark, max_bytes):
    rows, df = _table(spark)
    got = B.subtract_filtered(df, "k", max_bytes=max_bytes)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == _subtracted(rows)


def test_subtract_filtered_crowded(spark, monkeypatch):
    """A filter so full that it lets everything through loses nothing."""
    monkeypatch.setattr(B, "BITS_PER_KEY", 1)
    rows, df = _table(spark, n=40_000)
    got = B.subtract_filtered(df, "k")
    assert sorted(map(tuple, got.collect()), key=str) == _subtracted(rows)


def test_subtract_filtered_edges(spark):
    schema = "prio int, k string"
    for rows, want in (
            ([], []), ([(3, "a"), (3, "a")], [(3, "a"), (3, "a")]),
            ([(0, None), (1, None), (1, ""), (7, "")],
             [(0, None), (1, "")]),
            ([(0, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c")],
             [(0, "a"), (1, "b"), (1, "b"), (2, "c")])):
        df = spark.createDataFrame(rows, schema)
        got = sorted(map(tuple, B.subtract_filtered(df, "k").collect()),
                     key=str)
        assert got == sorted(want, key=str)


def test_rows_without_overlap_stay(spark):
    """Two sources that share nothing: the part that the filters pass moves
    no row, and the others are false positives, under 2 %."""
    df = spark.range(40_000, numPartitions=8).select(
        (F.col("id") % 2).cast("int").alias("prio"),
        F.concat(F.lit("text "), "id").alias("k"))
    got = B.subtract_filtered(df, "k")
    assert got.count() == 40_000
    hashed = B._hashed(df.withColumn("_bf_k", F.col("k")), F.col("_bf_k"), 8)
    filters = B._filter(hashed.where("prio = 0").withColumn(
        "_bf_q", F.lit(1)), ["_bf_q"])
    tested = B._tested(hashed, filters, {"prio": "_bf_q"})
    # 20,000 keys in 8 blocks of 32,768 bits are 13 bits for each
    assert tested.where("prio = 1 AND _bf_hit").count() < 0.02 * 20_000
    # only the second source's filter exists: the first one passes whole
    assert tested.where("prio = 0 AND _bf_hit").count() == 0
    first = _plan(got).split("Union")[1].split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in first


def _brute(rows):
    first = {}
    for p, q, k in sorted(rows, key=lambda r: r[:2]):
        first.setdefault(k, (p, q))
    out, n = [], {}
    for p, q, k in sorted([(p, q, k) for k, (p, q) in first.items()],
                          key=lambda r: r[:2]):
        out.append((k, p, q, n.get(p, 0)))
        n[p] = n.get(p, 0) + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bytes", [B.MAX_BYTES, 0])
def test_dedup_late_texts(spark, max_bytes):
    rows, df = _table(spark)
    got = B.dedup_late_texts(df, "k", key_name="k", max_bytes=max_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_dedup_late_texts_positions(spark):
    edge = [(p, q, f"{p}{q % 3}") for p in (-5, 0, 2 ** 31 - 1)
            for q in (-2 ** 63, -32769, -1, 0, 7, 8, 32767, 32768, 2 ** 41,
                      2 ** 63 - 1)] + [(1, 4, None), (2, 4, None)]
    df = spark.createDataFrame(edge, "prio int, pos long, k string")
    got = B.dedup_late_texts(df, "k", key_name="k")
    assert sorted(map(tuple, got.collect()), key=str) == _brute(edge)
    assert B.dedup_late_texts(df.limit(0), "k").collect() == []


def test_late_texts_do_not_move(spark, tmp_out):
    """The plan that returns the texts shuffles nothing, and agrees with the
    aggregate."""
    spark.range(50_000, numPartitions=8).select(
        (F.col("id") % 3).cast("int").alias("prio"),
        F.col("id").alias("pos"), F.repeat(F.concat(
            F.lit("long text "), (F.col("id") % 20_011).cast("string")), 20)
        .alias("k")).write.mode("overwrite").parquet(tmp_out)
    df = spark.read.parquet(tmp_out)
    got = B.dedup_late_texts(df, "k")
    assert "Exchange hashpartitioning" not in _plan(got)
    want = dedup.dense_ids_per_source(dedup.priority_dedup(
        df, "k", key_name="key"))
    cols = ["prio", "pos", "id", "key"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == want.count() == 20_011
