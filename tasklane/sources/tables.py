"""Parquet table access for the supplied tables.

Scans are lazy: Catalyst prunes columns and pushes filters into the parquet
reader, so a caller selecting two columns reads two columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


_SCHEMAS: dict = {}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def _changed(spark: SparkSession, path: str) -> int:
    """When the file or folder last changed, on any store of Hadoop's."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(where).getModificationTime()


def read_table(spark: SparkSession, sf_dir: str, name: str,
               spread: bool = False) -> DataFrame:
    """Scan a supplied table. ``spread=True`` (for tables feeding CPU-heavy
    per-row work) fans a scan with fewer partitions than cores out by a hash
    of (file path, row index in file); Catalyst still prunes columns and
    pushes filters below that exchange into the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = table_path(sf_dir, name)
    key = (spark.sparkContext.applicationId, path, _changed(spark, path))
    schema = _SCHEMAS.get(key)
    if schema is None:
        # First read of a table infers its schema from the footers (a small
        # job); later reads of the same files declare it and skip that job.
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
    else:
        df = spark.read.schema(schema).parquet(path)
    if spread:
        from tasklane.plans.parallel import spread as _spread
        df = _spread(df, keys=[F.col("_metadata.file_path"),
                               F.col("_metadata.row_index")])
    return df
