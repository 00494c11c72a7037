"""Open batches with a deadline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tasklane.operators import losses as LS
from tasklane.plans import fixtures as fx
from tasklane.streaming import deadline as D
from tasklane.streaming import kpi


def _kpi(df):
    return {(r.batch_id, r.task_id): (r.kpi, r.r) for r in df.collect()}


def test_a_lost_row_ends_with_its_deadline_and_leaves_no_state(spark):
    s = fx.scored(spark, SF_SMALL)
    lost = F.col("id").isin(40, 41, 333)
    query, base = D.replay_lossy(spark, s, lost, n_files=2)
    got = _kpi(kpi.read_output(spark, base))
    want = _kpi(LS.running_kpi(s.where(~lost)))
    assert got.keys() == want.keys() and len(got) > 20
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
    assert sorted(map(tuple, D.read_incomplete(spark, base).collect())) == [
        (1, 30, 32), (10, 31, 32)]
    assert kpi.read_late(spark, base).count() == 0
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 0
    last = max(p["batchId"] for p in query.recentProgress)
    for name in ("counts", "open"):
        assert spark.read.parquet(f"{base}/state/{last}/{name}").count() == 0
    assert D.dropped_rows(query) == 0


def test_without_lost_rows_equal_to_the_batch_scan(spark):
    s = fx.scored(spark, SF_SMALL)
    query, base = D.replay(spark, kpi.with_batch_rows(s), n_files=1)
    got, want = _kpi(kpi.read_output(spark, base)), _kpi(LS.running_kpi(s))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    assert D.read_incomplete(spark, base).count() == 0
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_late_rows_are_counted_before_and_after_the_deadline(spark, tmp_out):
    rows = kpi.with_batch_rows(fx.scored(spark, SF_SMALL)).where(
        "batch_id < 12").cache()
    src, base = f"{tmp_out}/in", f"{tmp_out}/st1"

    def commit(df):
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        query = D.running_kpi_deadline(stream, base, 4)
        query.awaitTermination()
        return query
    half = F.col("id") % 2 == 0
    commit(rows.where((F.col("batch_id") == 0) & half))
    assert kpi.read_output(spark, base).count() == 0
    commit(rows.where(F.col("batch_id").isin(1, 2, 3)))
    assert kpi.read_output(spark, base).count() == 0     # 0 is open
    commit(rows.where((F.col("batch_id") == 0) & ~half))
    assert set(_kpi(kpi.read_output(spark, base))) == {
        (b, t) for b in range(4) for t in range(3)}
    # Rows of a closed batch again, and one that was overtaken.
    commit(rows.where("batch_id = 3"))
    assert {r.batch_id: r.n for r in kpi.read_late(
        spark, base).collect()} == {3: 32}
    commit(rows.where("batch_id in (5, 6)"))
    commit(rows.where("batch_id = 4"))
    assert {r.batch_id: r.n for r in kpi.read_late(
        spark, base).collect()} == {3: 32, 4: 32}
    commit(rows.where((F.col("batch_id") == 7) & half))  # misses half
    commit(rows.where("batch_id in (8, 9, 11)"))
    assert max(_kpi(kpi.read_output(spark, base)))[0] == 6
    commit(D.end_of_stream(spark, rows.schema, 11, 4))
    assert max(_kpi(kpi.read_output(spark, base)))[0] == 11
    assert [tuple(r) for r in D.read_incomplete(spark, base).collect()] == [
        (7, 16, 32)]
    query = commit(rows.where((F.col("batch_id") == 7) & ~half))
    assert D.dropped_rows(query) == 16
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    rows.unpersist()


def test_a_repeated_trigger_changes_nothing(spark, tmp_out):
    said = "batch_id long, kind int, n long, batch_rows long, task_id int, " \
        "cls int, tp double, fp double, fn double"
    step = D._Ordered(f"{tmp_out}/x", 0.05, 1.0, 1.0, 0.5)
    first = spark.createDataFrame(
        [(0, D.OPEN, 1, 2, -1, -1, 0.0, 0.0, 0.0),
         (1, D.COMPLETE, 2, 2, 0, 0, 1.0, 0.0, 1.0)], said)
    step(first, 0)
    step(first, 0)
    assert not _kpi(kpi.read_output(spark, step.base))
    then = spark.createDataFrame(
        [(0, D.INCOMPLETE, 1, 2, 0, 0, 1.0, 0.0, 0.0)], said)
    step(then, 1)
    step(then, 1)
    assert set(_kpi(kpi.read_output(spark, step.base))) == {(0, 0), (1, 0)}
    assert D.read_incomplete(spark, step.base).count() == 1
