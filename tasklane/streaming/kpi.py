"""ST1: running task KPI over a stream of scored batches.

Training consumes mini-batches in order and carries a running KPI per task
(dynamic task priority). Scored rows arrive in files; the rows of a batch may
be spread over several files and triggers, and each says how many rows its
batch has (``batch_rows``). Every trigger

* counts its rows per (batch, task, class) with a partial aggregate,
* adds the counts of batches that aren't complete yet,
* emits the complete batches below the first incomplete one, in order: their
  KPI from the counts, and the recurrence by the distributed affine scan,
* counts rows of batches that were already passed as late.

State is the counts of open batches and one number per task, written as
Parquet for each trigger; a repeated trigger reads the state before it and
writes its own again, so output is exactly once. No task holds all rows of
a task, a batch or a trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tasklane.operators import metrics as M
from tasklane.plans.scan import affine_scan, scan_levels
from tasklane.session import checkpoint_dir, cut_lineage

_COUNTS = ("batch_id long, task_id int, cls int, tp double, fp double, "
           "fn double")
_ROWS = "batch_id long, n long, batch_rows long"
_TASKS = "task_id int, r double, last_batch long"
OUT_SCHEMA = "batch_id long, task_id int, kpi double, r double, w double"
LATE_SCHEMA = "batch_id long, n long"


class _Step:
    """One trigger: state of the trigger before in, output and state out."""

    def __init__(self, base: str, running_alpha: float, task_alpha: float,
                 task_gamma: float, r0: float):
        self.base, self.r0 = base, r0
        self.running_alpha = running_alpha
        self.task_alpha, self.task_gamma = task_alpha, task_gamma

    def _state(self, spark: SparkSession, epoch: int, name: str,
               schema: str) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(
            f"{self.base}/state/{epoch}/{name}")

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        counts0, rows0, tasks0 = (
            self._state(spark, epoch - 1, name, schema) for name, schema in (
                ("counts", _COUNTS), ("rows", _ROWS), ("tasks", _TASKS)))
        # One row per task: the last batch emitted.
        last = tasks0.agg(F.max("last_batch")).first()[0]
        passed = F.col("batch_id") <= (-1 if last is None else last)
        arrived = cut_lineage(rows.groupBy("batch_id").agg(
            F.count("*").alias("n"),
            F.max("batch_rows").cast("long").alias("batch_rows")))
        have = cut_lineage(rows0.unionByName(arrived.where(~passed)).groupBy(
            "batch_id").agg(F.sum("n").alias("n"),
                            F.max("batch_rows").alias("batch_rows")))
        counts = cut_lineage(counts0.unionByName(M.class_counts(
            rows.where(~passed), ["batch_id"], soft=False).select(
                "batch_id", F.col("task_id").cast("int").alias("task_id"),
                F.col("cls").cast("int").alias("cls"), "tp", "fp", "fn"))
            .groupBy("batch_id", "task_id", "cls").agg(
                F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                F.sum("fn").alias("fn")))
        first_open = have.where("n < batch_rows").agg(
            F.min("batch_id")).first()[0]
        ready = F.lit(True) if first_open is None else \
            F.col("batch_id") < first_open
        tasks = self._emit(counts.where(ready), tasks0, epoch)
        arrived.where(passed).select("batch_id", "n").write.mode(
            "overwrite").parquet(f"{self.base}/late/epoch={epoch}")
        for name, df in (("counts", counts.where(~ready)),
                         ("rows", have.where(~ready)), ("tasks", tasks)):
            df.write.mode("overwrite").parquet(
                f"{self.base}/state/{epoch}/{name}")

    def _emit(self, counts: DataFrame, tasks0: DataFrame, epoch: int
              ) -> DataFrame:
        """Write the output of whole batches, all below any later one; the
        tasks' state after them."""
        kpi = M.f1_from_counts(counts, ["batch_id"], "macro", M.EPS,
                               out="kpi")
        seq = kpi.join(tasks0.select("task_id", F.col("r").alias("_r0")),
                       "task_id", "left").select(
            "batch_id", "task_id", "kpi",
            F.coalesce("_r0", F.lit(self.r0)).alias("_r0"),
            F.lit(1.0 - self.running_alpha).alias("_a"),
            (F.col("kpi") * self.running_alpha).alias("_b"))
        seq = cut_lineage(seq)
        top = seq.agg(F.max("batch_id")).first()[0]
        if top is None:                    # nothing leaves
            spark = counts.sparkSession
            spark.createDataFrame([], OUT_SCHEMA).write.mode(
                "overwrite").parquet(f"{self.base}/out/epoch={epoch}")
            return tasks0
        out = affine_scan(seq, ["task_id"], "batch_id", "_a", "_b",
                          F.col("_r0"), levels=scan_levels(top))
        out = cut_lineage(out.select(
            "batch_id", "task_id", "kpi", "r",
            (-F.lit(self.task_alpha) * F.pow(1.0 - F.col("r"), F.lit(
                self.task_gamma)) * F.log("r")).alias("w")))
        out.write.mode("overwrite").parquet(f"{self.base}/out/epoch={epoch}")
        tasks = out.groupBy("task_id").agg(
            F.max_by("r", "batch_id").alias("r"),
            F.max("batch_id").alias("last_batch")).unionByName(tasks0)
        return tasks.groupBy("task_id").agg(
            F.max_by("r", "last_batch").alias("r"),
            F.max("last_batch").alias("last_batch"))


def running_kpi_stream(stream: DataFrame, base: str,
                       running_alpha: float = 0.05, task_alpha: float = 1.0,
                       task_gamma: float = 1.0, r0: float = 0.5,
                       trigger: dict | None = None) -> StreamingQuery:
    """Start the stream of (batch_id, task_id, target, logits, batch_rows);
    ``base`` is a folder on a shared store. ``read_output`` and ``read_late``
    give its tables. A batch first seen after a later one was emitted is
    late; its rows are counted, not lost silently."""
    step = _Step(base, running_alpha, task_alpha, task_gamma, r0)
    return (stream.writeStream.foreachBatch(step)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_output(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(OUT_SCHEMA).parquet(f"{base}/out").select(
        "batch_id", "task_id", "kpi", "r", "w")


def read_late(spark: SparkSession, base: str) -> DataFrame:
    """Rows that came too late, per batch."""
    return spark.read.schema(LATE_SCHEMA).parquet(f"{base}/late").groupBy(
        "batch_id").agg(F.sum("n").alias("n"))


def with_batch_rows(scored: DataFrame) -> DataFrame:
    """What the producer of a batch knows: how many rows it has."""
    size = scored.groupBy("batch_id").agg(F.count("*").alias("batch_rows"))
    return scored.join(size, "batch_id")


def run_to_table(spark: SparkSession, scored: DataFrame, n_files: int = 4,
                 **kw) -> DataFrame:
    """Replay ``scored`` as a file stream and return its output table. Each
    of ``n_files`` ranges of batches is committed in two halves, one trigger
    each, so every batch is spread over triggers."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/st1-{uuid.uuid4().hex}"
    src = f"{base}/in"
    rows = with_batch_rows(scored)
    top = scored.agg({"batch_id": "max"}).first()[0] or 0
    step = int(top) // n_files + 1
    for i in range(n_files):
        for half in (0, 1):
            rows.where((F.col("batch_id") >= i * step)
                       & (F.col("batch_id") < (i + 1) * step)
                       & (F.pmod(F.xxhash64("id"), F.lit(2)) == half)
                       ).write.mode("append").parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    stream = (spark.readStream.schema(rows.schema)
              .option("maxFilesPerTrigger", -(-files // (2 * n_files)))
              .parquet(src))
    running_kpi_stream(stream, base, **kw).awaitTermination()
    return read_output(spark, base)
