"""Idempotent sinks: killed, repeated and racing writes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tasklane.sources import commits as C
from tasklane.sources import io


@pytest.fixture()
def wide(spark):
    return spark.createDataFrame([(0.5, 7)], "loss double, n int")


def _metrics(spark, root):
    return sorted(map(tuple, C.read_metrics(spark, root).collect()))


def test_repeated_metrics_count_once(spark, tmp_out, wide):
    root = f"{tmp_out}/log"
    assert _metrics(spark, root) == []
    assert C.commit_metrics(wide, root, "r", 1)
    assert not C.commit_metrics(wide, root, "r", 1)
    assert C.commit_metrics(wide, root, "r", 2)
    assert C.commit_metrics(wide, root, 'r"/..', 1)
    assert _metrics(spark, root) == sorted(
        (r, t, s, v) for r, s in (("r", 1), ("r", 2), ('r"/..', 1))
        for t, v in (("loss", 0.5), ("n", 7.0)))


def test_killed_write_is_not_read(spark, tmp_out, wide):
    root = f"{tmp_out}/log"

    def die(df, path):
        io.append_metrics(df, path, "r")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        C.stage(wide.withColumn("step", F.lit(1)), root, die)
    assert len(os.listdir(f"{root}/data")) == 1
    assert _metrics(spark, root) == []
    assert C.commit_metrics(wide, root, "r", 1)
    assert len(_metrics(spark, root)) == 2
    # killed between the draft of a manifest and its rename
    with open(f"{root}/commits/_draft", "w") as f:
        f.write('{"key": "other", "version": 0, "folder": "data/none"}')
    assert len(_metrics(spark, root)) == 2


def test_late_second_writer_loses(spark, tmp_out, wide):
    """Both writers staged before either published."""
    root = f"{tmp_out}/log"
    rows = wide.withColumn("step", F.lit(1))
    a, b = (C.stage(rows, root, lambda d, p: io.append_metrics(d, p, "r"))
            for _ in range(2))
    assert C.publish(spark, root, "k", a) and not C.publish(
        spark, root, "k", b)
    assert C.committed(spark, root) == [f"{root}/{a}"]


def test_tasks_of_predictions_appear_together(spark, tmp_out):
    root = f"{tmp_out}/pred"

    def frame(tag):
        return spark.createDataFrame(
            [(i, f"{tag}{i}", t) for i in range(3) for t in ("x", "y", "z")],
            "id long, label string, task string")

    def labels():
        got = C.read_predictions(spark, root).collect()
        return {r.task for r in got}, {r.label[0] for r in got}, len(got)

    assert labels() == (set(), set(), 0)
    C.commit_predictions(frame("a"), root)
    assert labels() == ({"x", "y", "z"}, {"a"}, 9)
    # a second export died after one task's folder was there
    C.stage(frame("b").where("task = 'x'"), root, io.write_predictions)
    assert labels() == ({"x", "y", "z"}, {"a"}, 9)
    C.commit_predictions(frame("c"), root)
    assert labels() == ({"x", "y", "z"}, {"c"}, 9)
