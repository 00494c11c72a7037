"""Pooling and averaging by mergeable partial results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasklane.operators import params as A
from tasklane.operators import pooling as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def long_sequence(spark):
    """One sequence of a million positions on many partitions, another of
    three, and one that is masked as a whole."""
    long = spark.range(1_000_000, numPartitions=16).select(
        F.lit(1).cast("long").alias("id"), F.col("id").alias("pos"),
        F.array((F.col("id") % 1000) / 100, -F.col("id") / 1e6,
                F.lit(1.0), F.lit(0.5)).alias("vec"),
        (F.col("id") % 4 != 3).alias("mask"))
    few = spark.createDataFrame(
        [(2, 0, [1.0, 2.0, -3.0, 0.0], True), (2, 1, [3.0, 0.0, -5.0, 0.0],
                                               True),
         (2, 2, [9.0, 9.0, 9.0, 9.0], False),
         (3, 0, [1.0, 1.0, 1.0, 1.0], False)],
        "id long, pos long, vec array<double>, mask boolean")
    return long.unionByName(few)


def _numpy(n=1_000_000):
    i = np.arange(n)
    x = np.stack([(i % 1000) / 100, -i / 1e6, np.ones(n), np.full(n, 0.5)], 1)
    return x[i % 4 != 3]


def test_max_and_mean_of_a_long_sequence(spark, long_sequence):
    x = _numpy()
    for pool, want, few in ((P.max_pool, x.max(0), [3.0, 2.0, -3.0, 0.0]),
                            (P.mean_pool, x.mean(0), [2.0, 1.0, -4.0, 0.0])):
        df = pool(long_sequence)
        assert "collect_list" not in _plan(df)
        assert "partial_aggregate_metrics" in _plan(df)
        got = {r.id: r.feature for r in df.collect()}
        assert set(got) == {1, 2}
        assert got[1] == pytest.approx(want.tolist()) and got[2] == few


def test_attention_over_a_long_sequence(spark, long_sequence):
    rng = np.random.default_rng(3)
    w = {k: rng.normal(size=(4, 4)) for k in ("wq", "wk", "wv")}
    w["task_embedding"] = rng.normal(size=(3, 4)) * 20
    task_of = spark.createDataFrame([(1, 2), (2, 0), (3, 1)],
                                    "id long, task_id int")
    df = P.attention_pool(long_sequence, task_of, w, n_heads=2)
    assert "collect_list" not in _plan(df)
    got = {r.id: r.feature for r in df.collect()}
    q = w["task_embedding"] @ w["wq"]
    for key, x in ((1, _numpy()), (2, np.array([[1.0, 2, -3, 0],
                                               [3.0, 0, -5, 0]]))):
        k, v = x @ w["wk"], x @ w["wv"]
        want = []
        for h in (slice(0, 2), slice(2, 4)):
            s = k[:, h] @ q[{1: 2, 2: 0}[key]][h] / np.sqrt(2)
            e = np.exp(s - s.max())
            want += (e / e.sum() @ v[:, h]).tolist()
        assert got[key] == pytest.approx(want)
    assert got[3] == [0.0] * 4


def test_average_of_a_thousand_models(spark):
    df = spark.range(1000, numPartitions=8).select(
        F.col("id").cast("int").alias("model_id"),
        F.col("id").cast("int").alias("ord"), F.explode(F.array(
            F.lit("w"), F.lit("x.position_ids"), F.lit("none"))).alias(
            "name")).withColumn("vals", F.when(
                F.col("name") == "none", F.array().cast("array<double>"))
            .otherwise(F.transform(F.sequence(F.lit(1), F.lit(50)),
                                   lambda i: i * F.col("ord") + 0.5)))
    avg = A.average_params(df)
    assert "collect_list" not in _plan(avg)
    got = {r.name: r for r in avg.collect()}
    assert got["w"].vals == pytest.approx(
        [i * 499.5 + 0.5 for i in range(1, 51)])
    assert got["w"].n_models == 1000 and got["none"].vals == []
    assert got["x.position_ids"].vals == [i * 999 + 0.5
                                          for i in range(1, 51)]
    assert got["x.position_ids"].n_models == 1
