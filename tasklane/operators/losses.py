"""Multi-task losses over a scored table.

Per-(batch, task) sample losses are one partial aggregate; task weighting
is a second aggregate over that small table. A task without rows in a batch
simply has no row (the reference's NaN), except soft-F1 whose empty-task
value 1.0 is counted by the reference (``f1_empty_counts``, quirk Q9).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklane.functions.metrics import cross_entropy, focal
from tasklane.operators import metrics as M
from tasklane.operators.labels import TASKS
from tasklane.plans.scan import affine_scan, scan_levels
from tasklane.session import cut_lineage


def sample_loss(scored: DataFrame, groups: Sequence[str] = (),
                kind: str = "ce", alpha: float = 1.0, gamma: float = 1.0,
                average: str = "macro", reduction: str = "mean") -> DataFrame:
    """Per (groups, task) sample loss: ``ce`` (M3), ``focal`` (M4) or
    ``f1`` (M5, soft-F1)."""
    groups = list(groups)
    if kind == "ce":
        return scored.groupBy(*groups, "task_id").agg(
            F.avg(cross_entropy("logits", "target")).alias("loss"))
    if kind == "focal":
        row = focal("logits", "target", alpha, gamma)
        agg = {"mean": F.avg, "sum": F.sum}.get(reduction)
        if agg is None:
            raise ValueError(f"unknown reduction: {reduction!r}")
        return scored.groupBy(*groups, "task_id").agg(agg(row).alias("loss"))
    if kind == "f1":
        return M.soft_f1_loss(scored, groups, average)
    raise ValueError(f"unknown sample loss: {kind!r}")


def f1_empty_counts(losses: DataFrame, groups: Sequence[str],
                    tasks: Mapping[str, int]) -> DataFrame:
    """Quirk Q9 parity: soft-F1 of an absent task is 1.0 and is counted.
    The (group, task) grid comes from exploding the fixed task list per
    group key, then a left join brings the losses."""
    groups = list(groups)
    all_tasks = F.array(*[F.lit(int(t)) for t in tasks.values()])
    if groups:
        grid = losses.select(*groups).distinct().select(
            *groups, F.explode(all_tasks).alias("task_id"))
    else:
        grid = losses.groupBy().agg(F.count(F.lit(1)).alias("_n")).select(
            F.explode(all_tasks).alias("task_id"))
    return grid.join(losses, groups + ["task_id"], "left").select(
        *groups, "task_id", F.coalesce("loss", F.lit(1.0)).alias("loss"))


def weighted_loss(losses: DataFrame, groups: Sequence[str] = (),
                  weights: Mapping[int, float] | None = None) -> DataFrame:
    """``sum(w L) / sum(w)`` over tasks whose loss is a positive number;
    NULL when no task qualifies (quirk Q10)."""
    groups = list(groups)
    w = F.lit(1.0)
    if weights:
        w = None
        for t, v in weights.items():
            w = (F.when(F.col("task_id") == t, F.lit(float(v))) if w is None
                 else w.when(F.col("task_id") == t, F.lit(float(v))))
        w = w.otherwise(F.lit(1.0))
    ok = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.col("loss") > 0)
    return losses.groupBy(*groups).agg(F.try_divide(
        F.sum(F.when(ok, w * F.col("loss"))),
        F.sum(F.when(ok, w))).alias("loss"))


def uncertainty_loss(losses: DataFrame, groups: Sequence[str] = (),
                     log_variance: Mapping[int, float] | None = None
                     ) -> DataFrame:
    """``sum(L e^{-s} + s/2)`` over tasks with a loss; s per task
    (initial value ln 2), matched by task id (quirk Q17)."""
    groups = list(groups)
    s = None
    for t in TASKS.values():
        v = float((log_variance or {}).get(t, math.log(2.0)))
        s = (F.when(F.col("task_id") == t, F.lit(v)) if s is None
             else s.when(F.col("task_id") == t, F.lit(v)))
    s = s.otherwise(F.lit(math.log(2.0)))
    ok = F.col("loss").isNotNull() & ~F.isnan("loss")
    term = F.col("loss") * F.exp(-s) + s / 2
    return losses.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(ok, term)), F.lit(0.0)).alias("loss"))


def _loss_and_kpi(scored: DataFrame, batch: str, sample: str,
                  eps: float = M.EPS, **loss_options) -> DataFrame:
    """Per (batch, task): mean sample loss (ce) and hard macro-F1 over all
    C classes, in one scan and one partial aggregate: each row explodes to
    its C one-hot entries and carries its loss (and count) on class 0."""
    if sample != "ce":
        per = sample_loss(scored, [batch], sample, **loss_options)
        kpi = M.hard_f1(scored, [batch])
        return per.join(kpi, [batch, "task_id"], "inner")
    from tasklane.functions.metrics import argmax
    pred = argmax("logits")
    loss = cross_entropy("logits", "target")
    ex = scored.select(batch, "task_id", "target", loss.alias("_l"),
                       F.posexplode(F.transform(
                           "logits", lambda _, i: (i == pred).cast("double")))
                       .alias("cls", "p"))
    y = (F.col("cls") == F.col("target")).cast("double")
    first = F.col("cls") == 0
    per_cls = ex.groupBy(batch, "task_id", "cls").agg(
        F.sum(y * F.col("p")).alias("tp"),
        F.sum((F.lit(1.0) - y) * F.col("p")).alias("fp"),
        F.sum(y * (F.lit(1.0) - F.col("p"))).alias("fn"),
        F.sum(F.when(first, F.col("_l"))).alias("_ls"),
        F.sum(F.when(first, F.lit(1))).alias("_n"))
    f1 = F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fn") + F.col("fp")
                            + F.lit(eps))
    return per_cls.groupBy(batch, "task_id").agg(
        (F.sum("_ls") / F.sum("_n")).alias("loss"), F.avg(f1).alias("kpi"))


def running_kpi(scored: DataFrame, running_alpha: float = 0.05,
                task_alpha: float = 1.0, task_gamma: float = 1.0,
                batch: str = "batch_id", sample: str = "ce",
                r0: float = 0.5, levels: int | None = None,
                **loss_options) -> DataFrame:
    """M12 state: per (batch, task) with rows: loss, kpi (hard macro-F1),
    running KPI ``r`` and priority weight ``w = -alpha (1-r)^gamma ln r``.

    ``r`` follows batches in order within each task, starting from ``r0``;
    computed by the distributed affine scan indexed by the (increasing,
    not necessarily dense) batch id. ``levels=None`` sizes the scan from
    the largest batch id. ``loss_options`` go to ``sample_loss``.

    The (batch, task) table is read once per level, so it is checkpointed:
    the samples are scanned once.
    """
    bt = cut_lineage(_loss_and_kpi(scored, batch, sample, **loss_options))
    if levels is None:
        mx = bt.agg(F.max(batch)).first()[0]
        levels = scan_levels(mx or 0)
    seq = (bt.withColumn("_a", F.lit(1.0 - running_alpha))
           .withColumn("_b", F.lit(running_alpha) * F.col("kpi")))
    r = affine_scan(seq, ["task_id"], batch, "_a", "_b", r0, out="r",
                    levels=levels)
    w = (-F.lit(task_alpha) * F.pow(F.lit(1.0) - F.col("r"), F.lit(task_gamma))
         * F.log("r"))
    return r.select(batch, "task_id", "loss", "kpi", "r", w.alias("w"))


def dtp_loss(scored: DataFrame, batch: str = "batch_id", **kw) -> DataFrame:
    """Batch loss ``sum(w L) / sum(w)`` over the tasks in the batch."""
    st = running_kpi(scored, batch=batch, **kw)
    return st.groupBy(batch).agg(F.try_divide(
        F.sum(F.col("w") * F.col("loss")), F.sum("w")).alias("loss"))


def multi_task_loss(scored: DataFrame, sample: str = "ce",
                    weighting="uni", split: str = "train",
                    batch: str = "batch_id", alpha: float = 1.0,
                    gamma: float = 1.0, average: str = "macro",
                    running_alpha: float = 0.05, task_alpha: float = 1.0,
                    task_gamma: float = 1.0,
                    log_variance: Mapping[int, float] | None = None,
                    f1_parity: bool = True) -> DataFrame:
    """Loss selector. ``split='train'`` -> one row per batch;
    ``split='val'`` -> per-task losses and uniform ``val_loss`` over the
    whole split (validation always weighs tasks uniformly)."""
    if split not in ("train", "val"):
        raise ValueError(f"unknown split: {split!r}")
    if not (weighting in ("uni", "uct", "dtp") or isinstance(weighting, dict)):
        raise ValueError(f"unknown task weighting: {weighting!r}")
    groups = [batch] if split == "train" else []
    losses = sample_loss(scored, groups, sample, alpha, gamma, average)
    if sample == "f1" and f1_parity:
        losses = f1_empty_counts(losses, groups, TASKS)
    if split == "val":
        ok = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.col("loss") > 0)
        return losses.groupBy().agg(*[
            F.max(F.when(F.col("task_id") == t, F.col("loss")))
            .alias(f"loss_{n}") for n, t in TASKS.items()],
            F.try_divide(F.sum(F.when(ok, F.col("loss"))),
                         F.sum(F.when(ok, F.lit(1.0)))).alias("val_loss"))
    if weighting == "uni":
        return weighted_loss(losses, groups)
    if isinstance(weighting, dict):
        return weighted_loss(losses, groups, weighting)
    if weighting == "uct":
        return uncertainty_loss(losses, groups, log_variance)
    return dtp_loss(scored, batch=batch, running_alpha=running_alpha,
                    task_alpha=task_alpha, task_gamma=task_gamma,
                    sample=sample, alpha=alpha, gamma=gamma, average=average)


def step_loss(batch_losses: DataFrame, accumulation: int,
              batch: str = "batch_id") -> DataFrame:
    """Per optimizer step, the sum of its micro-batch losses / accum."""
    step = F.floor(F.col(batch) / accumulation).cast("long")
    return batch_losses.groupBy(step.alias("step")).agg(
        (F.sum("loss") / F.lit(float(accumulation))).alias("loss"))
