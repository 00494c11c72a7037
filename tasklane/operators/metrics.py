"""Metrics over a scored table.

Input ``scored(id, task_id, target, logits array<double>[, batch_id])``.
Every metric is a two-level aggregate: per-row contributions are summed per
``(groups, task, class)`` with map-side partials (the shuffle carries a few
rows per map task), then combined per task. Nothing row-scale reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklane.functions.metrics import (EPS, argmax, cross_entropy, focal,
                                        softmax)
from tasklane.operators.labels import TASKS


def class_counts(scored: DataFrame, groups: Sequence[str] = (),
                 soft: bool = False, task: str = "task_id",
                 target: str = "target", logits: str = "logits"
                 ) -> DataFrame:
    """Per (groups, task, class) tp/fp/fn over all C classes.

    ``soft``: probabilities (soft-F1), else one-hot argmax (KPI).
    """
    groups = list(groups)
    if soft:
        score = softmax(logits)
    else:
        pred = argmax(logits)
        score = F.transform(F.col(logits), lambda _, i: F.when(
            i == pred, F.lit(1.0)).otherwise(F.lit(0.0)))
    ex = scored.select(*groups, task, target,
                       F.posexplode(score).alias("cls", "p"))
    y = F.when(F.col("cls") == F.col(target), F.lit(1.0)).otherwise(0.0)
    return ex.groupBy(*groups, task, "cls").agg(
        F.sum(y * F.col("p")).alias("tp"),
        F.sum((F.lit(1.0) - y) * F.col("p")).alias("fp"),
        F.sum(y * (F.lit(1.0) - F.col("p"))).alias("fn"))


def f1_from_counts(counts: DataFrame, groups: Sequence[str] = (),
                   average: str = "macro", eps: float = EPS,
                   task: str = "task_id", out: str = "f1") -> DataFrame:
    groups = list(groups)
    if average == "macro":
        f1 = F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fn") + F.col("fp")
                                + F.lit(eps))
        return counts.groupBy(*groups, task).agg(F.avg(f1).alias(out))
    if average == "micro":
        tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
        return counts.groupBy(*groups, task).agg(
            (tp * 2 / (tp * 2 + fn + fp + F.lit(eps))).alias(out))
    raise ValueError(f"unknown average: {average!r}")


def soft_f1_loss(scored: DataFrame, groups: Sequence[str] = (),
                 average: str = "macro", eps: float = EPS) -> DataFrame:
    """M5: ``1 - soft F1`` per (groups, task)."""
    f = f1_from_counts(class_counts(scored, groups, soft=True), groups,
                       average, eps)
    return f.select(*groups, "task_id", (F.lit(1.0) - F.col("f1"))
                    .alias("loss"))


def hard_f1(scored: DataFrame, groups: Sequence[str] = (),
            average: str = "macro", eps: float = EPS) -> DataFrame:
    """M6: KPI F1 over all C classes (absent classes count as 0)."""
    return f1_from_counts(class_counts(scored, groups, soft=False), groups,
                          average, eps, out="kpi")


def _report_rows(scored: DataFrame, groups, row_loss: Column | None = None):
    """Per-row contributions for M7 (and the loss of M16) in one scan."""
    pred = argmax("logits")
    hit = (F.col("target") == pred).cast("double")
    miss = F.lit(1.0) - hit
    loss = F.lit(0.0) if row_loss is None else row_loss
    rows = F.array(
        F.struct(F.col("target").alias("cls"), hit.alias("tp"),
                 F.lit(0.0).alias("fp"), miss.alias("fn"),
                 loss.alias("loss"), F.lit(1).alias("n")),
        F.struct(pred.alias("cls"), F.lit(0.0).alias("tp"), miss.alias("fp"),
                 F.lit(0.0).alias("fn"), F.lit(0.0).alias("loss"),
                 F.lit(0).alias("n")))
    ex = scored.select(*groups, "task_id", F.inline(rows))
    per_cls = ex.groupBy(*groups, "task_id", "cls").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"), F.sum("loss").alias("loss"),
        F.sum("n").alias("n"))
    f1 = F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    return per_cls.groupBy(*groups, "task_id").agg(
        F.avg(f1).alias("f1"),
        (F.sum("loss") / F.sum("n")).alias("loss"),
        F.sum("n").alias("n"))


def macro_f1(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """M7: per-task macro-F1 over classes present in target or prediction."""
    return _report_rows(scored, list(groups)).select(
        *groups, "task_id", "f1")


def _task_columns(per_task: DataFrame, metric: str, prefix: str,
                  tasks: Mapping[str, int], groups, fill):
    return [F.coalesce(F.max(F.when(F.col("task_id") == t, F.col(metric))),
                       F.lit(fill)).alias(f"{prefix}{name}")
            for name, t in tasks.items()]


def report(scored: DataFrame, tasks: Mapping[str, int] = None,
           groups: Sequence[str] = ()) -> DataFrame:
    """M8/M9: one row per group: ``f1_<task>`` and ``competition_score``
    (mean of the task F1s; a task without rows scores 0)."""
    tasks = tasks or TASKS
    groups = list(groups)
    per = macro_f1(scored, groups)
    cols = _task_columns(per, "f1", "f1_", tasks, groups, 0.0)
    out = per.groupBy(*groups).agg(*cols)
    return out.withColumn("competition_score", sum(
        F.col(f"f1_{n}") for n in tasks) / F.lit(float(len(tasks))))


def evaluate(scored: DataFrame, tasks: Mapping[str, int] = None,
             groups: Sequence[str] = (), sample: str = "ce",
             alpha: float = 1.0, gamma: float = 1.0,
             average: str = "macro") -> DataFrame:
    """Validation losses and report.

    ``loss_<task>`` is the task's configured sample loss (``ce``, ``focal``
    or ``f1``), ``val_loss`` their uniform mean over tasks whose loss is a
    positive number. With ``f1`` a task without rows has loss 1 and counts,
    as in training. Row-wise losses take one scan of ``scored``.
    """
    tasks = tasks or TASKS
    groups = list(groups)
    if sample == "f1":
        from tasklane.operators.losses import f1_empty_counts
        per = f1_empty_counts(soft_f1_loss(scored, groups, average), groups,
                              tasks)
        per = per.join(macro_f1(scored, groups), [*groups, "task_id"], "left")
    elif sample in ("ce", "focal"):
        per = _report_rows(scored, groups, cross_entropy("logits", "target")
                           if sample == "ce" else
                           focal("logits", "target", alpha, gamma))
    else:
        raise ValueError(f"unknown sample loss: {sample!r}")
    f1s = _task_columns(per, "f1", "f1_", tasks, groups, 0.0)
    losses = [F.max(F.when(F.col("task_id") == t, F.col("loss")))
              .alias(f"loss_{n}") for n, t in tasks.items()]
    ok = F.col("loss") > 0
    out = per.groupBy(*groups).agg(
        *losses,
        F.try_divide(F.sum(F.when(ok, F.col("loss"))),
                     F.sum(F.when(ok, F.lit(1.0)))).alias("val_loss"),
        *f1s)
    return out.withColumn("competition_score", sum(
        F.col(f"f1_{n}") for n in tasks) / F.lit(float(len(tasks))))


def best_checkpoint(log: DataFrame, run: str = "run_id", step: str = "step",
                    score: str = "score") -> DataFrame:
    """The step with the highest score per run; the earliest such step
    wins (a later equal score does not replace it)."""
    # Hash aggregates only: the best score per run (one row per run, joined
    # back by run), then the earliest step reaching it. Null-safe, so a run
    # whose scores are all NULL keeps its earliest step.
    best = log.groupBy(run).agg(F.max(score).alias("best_score"))
    hit = log.join(best, run).where(F.col(score).eqNullSafe(F.col("best_score")))
    return hit.groupBy(run).agg(F.min(step).alias("best_step"),
                                F.first("best_score").alias("best_score"))
