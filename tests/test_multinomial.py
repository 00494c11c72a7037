"""K4 by multinomial splitting: totals, reruns and distribution."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasklane.operators import multinomial as M
from tasklane.plans.rank import position_buckets, two_level_rank


@pytest.fixture(scope="module")
def tasks(spark):
    """Tasks of 9,000, 3,000, 1,024, 1 and (NULL) 500 rows, ids sparse."""
    parts = [spark.range(n).select(F.lit(t).cast("string").alias("t"),
                                   (F.col("id") * 70_001 - 5).alias("id"))
             for t, n in (("a", 9000), ("b", 3000), ("c", 1024), ("d", 1),
                          (None, 500))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _copies(df, **kw):
    got = M.oversample_split(df, "t", "id", **kw).groupBy("t", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("copy").alias("lo"),
        F.max("copy").alias("hi")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in got)
    return {(r.t, r.id): r.n - 1 for r in got}


def test_totals_and_reruns(tasks):
    got = _copies(tasks)
    per = {}
    for (t, _), n in got.items():
        per.setdefault(t, []).append(n)
    assert {t: (len(v), sum(v)) for t, v in per.items()} == {
        "a": (9000, 0), "b": (3000, 6000), "c": (1024, 7976),
        "d": (1, 8999), None: (500, 8500)}
    assert _copies(tasks.repartition(13)) == got
    assert _copies(tasks, seed=1) != got


def test_one_rank_no_draw_rows(tasks):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    rank = plan(two_level_rank(tasks, ["id"], position_buckets("id"), ["t"]))
    split = plan(M.oversample_split(tasks, "t", "id"))
    # the only joins are those of the rank's own offsets
    assert split.count("Join") == rank.count("Join")
    assert split.count("row_number()") == rank.count("row_number()") == 1


def test_heavy_row_is_dealt_out(spark, tasks, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 1000)
    assert _copies(tasks)[("d", -5)] == 8999


def test_empty_and_even(spark, tasks):
    assert M.oversample_split(tasks.limit(0), "t", "id").count() == 0
    assert set(_copies(tasks.where("t = 'b'")).values()) == {0}


def test_distribution():
    """Over many seeds a rank's copies have the multinomial's mean, variance
    and (negative) covariance, also across blocks."""
    n, e = 2500, 5000
    import pandas as pd
    t, rank = pd.Series(["x"] * n), pd.Series(np.arange(n))
    draws = np.stack([M.Splitter(s, {"x": (n, e)}).copies(t, rank).to_numpy()
                      for s in range(400)])
    assert (draws.sum(1) == e).all()
    assert abs(draws.mean() - 2) < 1e-9
    assert np.abs(draws.mean(0) - 2).max() < 5 * np.sqrt(2 / 400)
    assert abs(draws.var(0).mean() - 2 * (1 - 1 / n)) < 0.02
    for lo, hi in ((0, 1024), (1024, 2048), (2048, 2500), (100, 1400)):
        p = (hi - lo) / n
        total = draws[:, lo:hi].sum(1)
        assert abs(total.mean() - e * p) < 5 * np.sqrt(e * p * (1 - p) / 400)
        assert 0.75 < total.var() / (e * p * (1 - p)) < 1.3


def test_order_of_rows_in_a_batch():
    import pandas as pd
    s = M.Splitter(9, {"x": (3000, 100_000), None: (10, 7)})
    t = pd.Series(["x"] * 3000 + [None] * 10)
    rank = pd.Series(np.r_[np.arange(3000), np.arange(10)])
    whole = s.copies(t, rank).to_numpy()
    assert whole[:3000].sum() == 100_000 and whole[3000:].sum() == 7
    mix = np.random.default_rng(0).permutation(3010)
    for part in np.array_split(mix, 5):
        got = s.copies(t.iloc[part].reset_index(drop=True),
                       rank.iloc[part].reset_index(drop=True))
        assert (got.to_numpy() == whole[part]).all()
    assert len(s.copies(t.iloc[:0], rank.iloc[:0])) == 0
