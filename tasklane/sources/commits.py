"""Idempotent sinks (W3, W4): staged folders and manifests.

A write goes to a folder of its own below ``data``; it counts only once its
manifest, a one-line file below ``commits``, has been renamed into place.
Readers follow the manifests, so a write that was killed leaves nothing to be
read, all folders of a write appear together, and a repeated write with the
key of an earlier one adds nothing. A rename decides who wins where the file
system's is atomic (HDFS and local disks; an object store needs a committer
of its own).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.sources import io

_MANIFEST = "key string, version long, folder string"


def _files(spark: SparkSession, root: str):
    """File system and path maker of ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, path


def stage(df: DataFrame, root: str, write: Callable[[DataFrame, str], None]
          ) -> str:
    """Write ``df`` into a new folder; its name, relative to ``root``."""
    folder = f"data/{uuid.uuid4().hex}"
    write(df, f"{root}/{folder}")
    return folder


def publish(spark: SparkSession, root: str, key: str, folder: str,
            replace: bool = False) -> bool:
    """Make a staged folder the content of ``key``. Without ``replace`` the
    first one stays and False tells that the key was there already; with it
    the folder becomes the key's next version."""
    fs, path = _files(spark, root)
    name = hashlib.sha256(key.encode()).hexdigest()[:32]
    commits = path(f"{root}/commits")
    fs.mkdirs(commits)
    version = 0
    while True:
        target = path(f"{root}/commits/{name}-{version:010d}.json")
        if not fs.exists(target):
            draft = path(f"{root}/commits/_{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps(
                {"key": key, "version": version, "folder": folder}).encode()))
            out.close()
            if not fs.exists(target) and fs.rename(draft, target):
                return True
            fs.delete(draft, False)
        if not replace:
            return False
        version += 1


def committed(spark: SparkSession, root: str) -> list[str]:
    """Folders that count: the last version of each key, one row of metadata
    for each commit."""
    fs, path = _files(spark, root)
    if not fs.exists(path(f"{root}/commits")):
        return []
    last = spark.read.schema(_MANIFEST).json(f"{root}/commits").groupBy(
        "key").agg(F.max_by("folder", "version").alias("folder"))
    return [f"{root}/{r.folder}" for r in last.orderBy("key").collect()]


def commit_metrics(df: DataFrame, root: str, run_id: str, step: int) -> bool:
    """W4, once for each (run, step): the rows of ``append_metrics`` for the
    wide frame ``df``. A repeated call for the same run and step adds nothing
    and returns False; it doesn't write if it sees the first one's commit."""
    spark = df.sparkSession
    key = json.dumps(["metrics", run_id, int(step)])
    fs, path = _files(spark, root)
    name = hashlib.sha256(key.encode()).hexdigest()[:32]
    if fs.exists(path(f"{root}/commits/{name}-{0:010d}.json")):
        return False
    rows = df.withColumn("step", F.lit(int(step)).cast("long"))
    folder = stage(rows, root, lambda d, p: io.append_metrics(d, p, run_id))
    return publish(spark, root, key, folder)


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The committed (run_id, tag, step, value) rows."""
    found = committed(spark, root)
    if not found:
        return spark.createDataFrame([], io.METRICS_SCHEMA)
    return spark.read.schema(io.METRICS_SCHEMA).parquet(*found)


def commit_predictions(df: DataFrame, root: str, task: str = "task") -> None:
    """The JSON lines of all tasks, replaced together: readers see those
    of one call or of another, never some of each."""
    folder = stage(df, root, lambda d, p: io.write_predictions(d, p, task))
    publish(df.sparkSession, root, "predictions", folder, replace=True)


def read_predictions(spark: SparkSession, root: str, task: str = "task"
                     ) -> DataFrame:
    """``id``, ``label`` and the task of the predictions committed last."""
    schema = f"id string, label string, `{task}` string"
    found = committed(spark, root)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(*found)
