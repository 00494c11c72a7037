"""Session preparation and Arrow plumbing shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tasklane.session import checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """The session has its shared folder and the workers the package."""
    checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table, read by Spark (any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` with ``fn(batches, arrow_schema)``."""
    out = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: fn(batches, out), schema)


_BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch",
               "spark.sql.parquet.columnarReaderBatchSize")


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile reads Parquet and gets Arrow batches by at most
    ``rows`` rows: an executor holds whole batches, in its heap and beside it,
    several times. A session that has smaller ones keeps them."""
    own = {name: spark.conf.get(name, None) for name in _BATCH_ROWS}
    own = {name: value for name, value in own.items()
           if value is None or not 0 < int(value) <= rows}
    try:
        for name in own:
            spark.conf.set(name, str(rows))
        yield
    finally:
        for name, value in own.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
