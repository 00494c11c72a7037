"""Joint fit of all heads with learned log variances."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasklane.operators import heads as H
from tasklane.operators import joint_fit as J
from tasklane.operators import losses as LS


def _rows(n=240, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t, x = i % 3, rng.normal(size=dim)
        y = int((x[:t + 2] + rng.normal(scale=1 + 0.3 * t, size=t + 2)
                 ).argmax())
        out.append((t, y, x.tolist()))
    return out


SCHEMA = "task_id int, target int, feature array<double>"


@pytest.fixture(scope="module")
def features(spark):
    extra = [(0, None, [0.0] * 5), (1, 0, None), (None, 0, [0.0] * 5),
             (2, 1, [1.0, None, 0.0, 0.0, 0.0])]
    return spark.createDataFrame(_rows() + extra, SCHEMA).repartition(6)


@pytest.mark.parametrize("hidden", [0, 3])
def test_gradient_is_that_of_finite_differences(spark, features, hidden):
    shape = J.Shape(5, hidden, {0: 2, 1: 3, 2: 4})
    rows = spark.createDataFrame(_rows(60), SCHEMA).select(
        "task_id", F.col("target").cast("long").alias("target"),
        F.col("feature").alias("x")).repartition(3)
    f = J._Objective(rows, shape, np.array([20.0] * 3), 0.01)
    at = np.random.default_rng(2).normal(size=shape.values)
    _, g, _ = f(at)
    for i in [*range(0, shape.values, 7), *range(shape.values - 3,
                                                 shape.values)]:
        step = np.zeros(shape.values)
        step[i] = 1e-5
        slope = (f(at + step)[0] - f(at - step)[0]) / 2e-5
        assert slope == pytest.approx(g[i], rel=1e-5, abs=1e-7)


def test_one_job_for_each_iteration(spark, features):
    sc = spark.sparkContext
    done = []
    for steps in (4, 9):
        sc.setJobGroup(f"joint-fit-{steps}", "")
        try:
            assert J.fit_jointly(features, hidden=3, steps=steps
                                 ).jobs == steps
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        done.append(len(sc.statusTracker().getJobIdsForGroup(
            f"joint-fit-{steps}")))
    assert done[1] - done[0] == 5


def test_objective_is_the_uncertainty_loss_and_below_separate_fits(spark,
                                                                  features):
    fit = J.fit_jointly(features, hidden=4, steps=60, reg=0.01)
    rows = features.where("target is not null and task_id is not null and "
                          "feature is not null and not exists(feature, "
                          "v -> v is null)")
    hidden, heads = fit.tables(spark)
    scored = H.score(rows, "hard_plus", heads, hidden)
    per = LS.sample_loss(scored, [], "ce")
    assert {r.task_id: r.loss for r in per.collect()} == pytest.approx(
        fit.losses)
    value = LS.uncertainty_loss(per, log_variance=fit.log_variance
                                ).first().loss
    held = sum(float((v ** 2).sum()) for own in fit.shape.views(
        fit.packed).values() for v in own if v.ndim == 2)
    assert value + 0.01 / 2 * held == pytest.approx(fit.objective)
    for t, s in fit.log_variance.items():        # the least of L e^-s + s/2
        assert s == pytest.approx(math.log(2 * fit.losses[t]), abs=0.05)
    apart = []
    for t, m in H.fit_linear_heads(rows, max_iter=fit.jobs,
                                    reg=0.01).items():
        apart += [(t, i, w.tolist(), float(b)) for i, (w, b) in enumerate(
            zip(m.coefficientMatrix.toArray(), m.interceptVector))]
    theirs = LS.uncertainty_loss(LS.sample_loss(H.linear_head(
        rows, spark.createDataFrame(
            apart, "task_id int, cls int, w array<double>, b double")),
        [], "ce")).first().loss
    assert value < theirs


def test_linear_heads_and_repeated_runs(spark, features):
    a, b = (J.fit_jointly(features.repartition(n), steps=30, reg=0.01)
            for n in (2, 9))
    assert a.packed == pytest.approx(b.packed, abs=1e-4)
    assert a.tables(spark)[0] is None and a.objective < J.fit_jointly(
        features, steps=3, reg=0.01).objective


def test_unfit_rows_are_errors(spark):
    for rows in ([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], [(0, -1, [1.0])]):
        with pytest.raises(ValueError, match="one length"):
            J.fit_jointly(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(ValueError, match="one length"):
        J.fit_jointly(spark.createDataFrame([], SCHEMA))
    with pytest.raises(ValueError, match="parameters"):
        J.fit_jointly(spark.createDataFrame([(0, 3_999_999, [1.0])], SCHEMA))
