"""ST1 with a deadline: open batches as keyed state with timers.

As in ``kpi``, scored rows of a batch arrive in any files and triggers, and
the running KPI needs batches in order. There, a batch that misses a row
holds back all later output for ever. Here each batch is a key of a stateful
operator (``applyInPandasWithState``): its state is the counts so far and the
number of rows, and an event-time timer ends it. Event time is the batch's
number (0 or more), in seconds; the watermark trails the latest batch by
``deadline`` batches.

* All rows there: the batch closes, complete.
* The watermark passes it first: the timer closes it, incomplete, with the
  rows it has; ``read_incomplete`` tells how many it misses.
* Until its deadline a closed batch's key stays to count further rows as late
  (``read_late``); after it, Spark drops them (``dropped_rows``).

The sink puts closed batches in order: those below the first open one leave,
by the same distributed scan. After ``end_of_stream`` no state is left. The
operator's state lives in Spark's state store and the sink's as Parquet for
each trigger, so a repeated trigger gives the same output once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tasklane.functions.metrics import argmax
from tasklane.session import checkpoint_dir, cut_lineage, ship_package
from tasklane.streaming.kpi import _COUNTS, _Step, with_batch_rows

OPEN, COMPLETE, INCOMPLETE, LATE = range(4)
_SAID = ("batch_id long, kind int, n long, batch_rows long, task_id int, "
         "cls int, tp double, fp double, fn double")
_KEY_STATE = "n long, batch_rows long, closed boolean, counts string"
INCOMPLETE_SCHEMA = "batch_id long, n long, batch_rows long"
_OPEN_BATCHES = "batch_id long"


def _add(counts: dict, rows: pd.DataFrame) -> None:
    """Right, wrong and missed answers of each class of each task."""
    for (task, classes, pred, target), n in rows.groupby(
            ["task_id", "n_cls", "pred", "target"], dropna=False
            ).size().items():
        own = counts.setdefault(str(int(task)), [])
        own += [[0, 0, 0] for _ in range(int(classes) - len(own))]
        if pred == target:
            own[int(pred)][0] += int(n)
        else:
            own[int(pred)][1] += int(n)
            if target == target and 0 <= target < len(own):
                own[int(target)][2] += int(n)


def _said(batch: int, kind: int, n: int, rows: int, counts: dict
          ) -> pd.DataFrame:
    out = [(batch, kind, n, rows, int(task), c, float(tp), float(fp),
            float(fn)) for task, own in counts.items()
           for c, (tp, fp, fn) in enumerate(own)]
    out = out or [(batch, kind, n, rows, -1, -1, 0.0, 0.0, 0.0)]
    return pd.DataFrame(out, columns=[c.split()[0]
                                      for c in _SAID.split(", ")])


def follow_batch(key: tuple, frames: Iterator[pd.DataFrame],
                 state: GroupState) -> Iterator[pd.DataFrame]:
    """What a trigger says about one batch."""
    batch = int(key[0])
    if state.hasTimedOut:
        n, rows, closed, counts = state.get
        state.remove()
        if not closed:
            yield _said(batch, INCOMPLETE, n, rows, json.loads(counts))
        return
    new = not state.exists
    n, rows, closed, counts = (0, 0, False, "{}") if new else state.get
    counts, late = json.loads(counts), 0
    for frame in frames:
        if closed:
            late += len(frame)
            continue
        rows = max(rows, int(frame["batch_rows"].max()))
        if rows == 0:                      # the end of the stream
            return
        n += len(frame)
        _add(counts, frame)
    if closed:
        yield _said(batch, LATE, late, rows, {})
    elif n >= rows:
        closed = True
        yield _said(batch, COMPLETE, n, rows, counts)
        counts = {}
    elif new:
        yield _said(batch, OPEN, n, rows, {})
    state.update((n, rows, closed, json.dumps(counts)))
    state.setTimeoutTimestamp((batch + 1) * 1000)


class _Ordered(_Step):
    """The sink: closed batches in order."""

    def __call__(self, said: DataFrame, epoch: int) -> None:
        spark = said.sparkSession
        said = cut_lineage(said)           # the stateful operator runs once
        counts0, open0, tasks0 = (
            self._state(spark, epoch - 1, name, schema) for name, schema in (
                ("counts", _COUNTS), ("open", _OPEN_BATCHES),
                ("tasks", "task_id int, r double, last_batch long")))
        # One row per task: the last batch that left.
        last = tasks0.agg(F.max("last_batch")).first()[0]
        passed = F.col("batch_id") <= (-1 if last is None else last)
        closes = F.col("kind").isin(COMPLETE, INCOMPLETE)
        still = cut_lineage(open0.unionByName(said.where(
            (F.col("kind") == OPEN) & ~passed).select("batch_id")).join(
            said.where(closes).select("batch_id").distinct(), "batch_id",
            "left_anti"))
        first_open = still.agg(F.min("batch_id")).first()[0]
        ready = F.lit(True) if first_open is None else \
            F.col("batch_id") < first_open
        counts = counts0.unionByName(said.where(
            closes & ~passed & (F.col("task_id") >= 0)).select(
            "batch_id", "task_id", "cls", "tp", "fp", "fn"))
        tasks = self._emit(counts.where(ready), tasks0, epoch)
        once = said.dropDuplicates(["batch_id", "kind"])
        once.where((F.col("kind") == LATE) | closes & passed).select(
            "batch_id", "n").write.mode("overwrite").parquet(
            f"{self.base}/late/epoch={epoch}")
        once.where(F.col("kind") == INCOMPLETE).select(
            "batch_id", "n", "batch_rows").write.mode("overwrite").parquet(
            f"{self.base}/incomplete/epoch={epoch}")
        for name, df in (("counts", counts.where(~ready)), ("open", still),
                         ("tasks", tasks)):
            df.write.mode("overwrite").parquet(
                f"{self.base}/state/{epoch}/{name}")


def batches(stream: DataFrame, deadline: int) -> DataFrame:
    """Opened, closed and late batches of a stream of (batch_id, task_id,
    target, logits, batch_rows); closed ones with their counts."""
    ship_package(stream.sparkSession)
    rows = stream.where("batch_id is not null").select(
        F.col("batch_id").cast("long").alias("batch_id"), "task_id",
        F.col("target").cast("int").alias("target"),
        argmax("logits").cast("int").alias("pred"),
        F.size("logits").alias("n_cls"),
        F.col("batch_rows").cast("long").alias("batch_rows"),
        F.timestamp_seconds(F.col("batch_id") + 1).alias("at"))
    return rows.withWatermark("at", f"{deadline} seconds").groupBy(
        "batch_id").applyInPandasWithState(
        follow_batch, _SAID, _KEY_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def running_kpi_deadline(stream: DataFrame, base: str, deadline: int,
                         running_alpha: float = 0.05, task_alpha: float = 1.0,
                         task_gamma: float = 1.0, r0: float = 0.5,
                         trigger: dict | None = None) -> StreamingQuery:
    """Start the stream; ``base`` is a folder on a shared store. ``kpi``'s
    ``read_output`` and ``read_late`` and ``read_incomplete`` give its
    tables."""
    step = _Ordered(base, running_alpha, task_alpha, task_gamma, r0)
    return (batches(stream, deadline).writeStream.outputMode("append")
            .foreachBatch(step)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def end_of_stream(spark: SparkSession, schema, last_batch: int,
                  deadline: int) -> DataFrame:
    """A row of ``schema`` that says no batch after ``last_batch`` will come:
    it moves the watermark past all of them."""
    row = spark.range(1).select(
        F.lit(last_batch + deadline + 2).alias("batch_id"),
        F.lit(0).alias("batch_rows"))
    return row.select(*[
        (F.col(f.name) if f.name in row.columns else F.lit(None)).cast(
            f.dataType).alias(f.name) for f in schema])


def read_incomplete(spark: SparkSession, base: str) -> DataFrame:
    """Batches closed by their deadline: rows there, rows expected."""
    return spark.read.schema(INCOMPLETE_SCHEMA).parquet(
        f"{base}/incomplete").select("batch_id", "n", "batch_rows")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after their batch's deadline, of the triggers that the
    query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
               for op in p["stateOperators"])


def replay(spark: SparkSession, rows: DataFrame, deadline: int | None = None,
           n_files: int = 4, **kw) -> tuple[StreamingQuery, str]:
    """Replay rows with ``batch_rows`` as a file stream to its end, each of
    ``n_files`` ranges of batches in two halves, one trigger each; returns
    the query and its folder. ``deadline``: by default a range."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/st1-{uuid.uuid4().hex}"
    src = f"{base}/in"
    top = int(rows.agg({"batch_id": "max"}).first()[0] or 0)
    step = top // n_files + 1
    deadline = step if deadline is None else deadline
    for i in range(n_files):
        for half in (0, 1):
            rows.where((F.col("batch_id") >= i * step)
                       & (F.col("batch_id") < (i + 1) * step)
                       & (F.pmod(F.xxhash64("id"), F.lit(2)) == half)
                       ).coalesce(1).write.mode("append").parquet(src)
    end_of_stream(spark, rows.schema, top, deadline).coalesce(1).write.mode(
        "append").parquet(src)
    stream = (spark.readStream.schema(rows.schema)
              .option("maxFilesPerTrigger", 1).parquet(src))
    query = running_kpi_deadline(stream, base, deadline, **kw)
    query.awaitTermination()
    return query, base


def replay_lossy(spark: SparkSession, scored: DataFrame, lost,
                 **kw) -> tuple[StreamingQuery, str]:
    """``replay`` without the rows for which ``lost`` holds, which their
    batches still expect."""
    return replay(spark, with_batch_rows(scored).where(~lost), **kw)
